"""Spark operators for measuring how online communities change over time."""
