"""Who holds the hubs: degree inequality, hub shares and degree shares by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.operators import graph
from tideline.operators.ranking import numbered_rows
from tideline.operators.rollups import weighted_mean
from tideline.session import cut_lineage

# Metrics of a month that are averaged with the number of nodes as weight.
WEIGHTED_DYNAMICS = (
    "newcomer_gini",
    "existing_gini",
    "newcomer_hub_rate",
    "newcomer_degree_share",
    "newcomer_pop_share",
    "degree_share_ratio",
    "mean_newcomer_degree",
    "mean_existing_degree",
)


def degree_dynamics(pairs: DataFrame, labelled_nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Degree inequality within newcomers and existing users, and the newcomers' part of the whole.

    ``labelled_nodes`` has ``degree`` and ``label``. Beyond the count per label and degree nothing
    is read again.
    """
    keys = list(keys)
    histogram = graph.degree_histogram(labelled_nodes, [*keys, "label"])
    is_new = F.col("label") == "newcomer"
    n, degree = F.col("n"), F.col("degree")
    n_new, n_old = F.sum(F.when(is_new, n).otherwise(0)), F.sum(F.when(is_new, 0).otherwise(n))
    held_new = F.sum(F.when(is_new, n * degree).otherwise(0))
    held_old = F.sum(F.when(is_new, 0).otherwise(n * degree))
    totals = histogram.groupBy(*keys).agg(
        F.sum("n").alias("n_nodes"),
        n_new.alias("n_newcomers"),
        n_old.alias("n_existing"),
        held_new.alias("_held_new"),
        held_old.alias("_held_old"),
        F.percentile(F.when(~is_new, degree), F.lit(0.9), F.when(is_new, 0).otherwise(n)).alias("_p90"),
    )
    spread = graph.gini(histogram, [*keys, "label"]).groupBy(*keys).agg(
        F.max(F.when(is_new, F.col("gini"))).alias("newcomer_gini"),
        F.max(F.when(~is_new, F.col("gini"))).alias("existing_gini"),
    )
    above = (
        histogram.where(is_new)
        .join(totals.select(*keys, "_p90"), keys)
        .groupBy(*keys)
        .agg(ratio(F.sum(F.when(degree > F.col("_p90"), n).otherwise(0)), F.sum("n")).alias("_rate"))
    )
    edges = pairs.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    both = (F.col("n_newcomers") > 0) & (F.col("n_existing") > 0)
    held, people = F.col("_held_new") + F.col("_held_old"), F.col("n_nodes")
    degree_share, pop_share = ratio(F.col("_held_new"), held), ratio(F.col("n_newcomers"), people)
    joined = totals.join(edges, keys).join(spread, keys, "left").join(above, keys, "left")
    return joined.select(
        *keys,
        "n_nodes",
        "n_edges",
        "n_newcomers",
        "n_existing",
        "newcomer_gini",
        "existing_gini",
        F.when(both, F.col("_p90")).alias("hub_threshold_p90"),
        F.when(both, F.col("_rate")).alias("newcomer_hub_rate"),
        degree_share.alias("newcomer_degree_share"),
        pop_share.alias("newcomer_pop_share"),
        ratio(degree_share, pop_share).alias("degree_share_ratio"),
        ratio(F.col("_held_new"), F.col("n_newcomers")).alias("mean_newcomer_degree"),
        ratio(F.col("_held_old"), F.col("n_existing")).alias("mean_existing_degree"),
    )


def global_weighted_dynamics(dynamics: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Communities together: counts summed, other metrics weighted by nodes where they exist.

    The ratio of shares is then taken anew from the averaged shares.
    """
    weight = F.col("n_nodes")
    summed = dynamics.where(weight > 0).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_nodes", "n_edges", "n_newcomers", "n_existing")],
        *[weighted_mean(F.col(c), weight).alias(c) for c in WEIGHTED_DYNAMICS],
    )
    share = F.col("newcomer_pop_share")
    return summed.withColumn(
        "degree_share_ratio",
        F.when(share > 0, F.col("newcomer_degree_share") / share).otherwise(F.col("degree_share_ratio")),
    )


def hub_threshold_sensitivity(
    labelled_nodes: DataFrame, keys: Sequence[str], fractions: Sequence[float] = (0.05, 0.1, 0.2)
) -> DataFrame:
    """Newcomers among hubs for several definitions of a hub, one row per snapshot and fraction.

    Hubs have at least the quantile over all nodes; the rate against existing users counts
    newcomers above, not at, the quantile over existing users.
    """
    keys = list(keys)
    histogram = graph.degree_histogram(labelled_nodes, [*keys, "label"])
    is_new = F.col("label") == "newcomer"
    n, degree = F.col("n"), F.col("degree")
    ranks = F.array(*[F.lit(1.0 - f) for f in fractions])
    thresholds = histogram.groupBy(*keys).agg(
        F.percentile(degree, ranks, n).alias("_all"),
        F.percentile(F.when(~is_new, degree), ranks, F.when(is_new, 0).otherwise(n)).alias("_old"),
    )
    shares = F.array(*[F.lit(float(f)) for f in fractions])
    long = thresholds.select(
        *keys, "_old", F.posexplode(F.arrays_zip(shares.alias("fraction"), F.col("_all").alias("threshold"))).alias("_p", "_t")
    ).select(
        *keys,
        F.col("_t.fraction").alias("hub_fraction"),
        F.col("_t.threshold").alias("hub_threshold"),
        F.col("_old")[F.col("_p")].alias("_existing"),
    )
    hub, above = degree >= F.col("hub_threshold"), degree > F.col("_existing")

    def people(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    grouped = histogram.join(long, keys).groupBy(*keys, "hub_fraction").agg(
        F.max("hub_threshold").alias("hub_threshold"),
        people(hub).alias("n_hubs"),
        people(hub & is_new).alias("_new_hubs"),
        people(is_new).alias("n_newcomers"),
        people(~is_new).alias("_n_old"),
        F.max("_existing").alias("_existing"),
        people(is_new & above).alias("_new_above"),
    )
    both = (F.col("n_newcomers") > 0) & (F.col("_n_old") > 0)
    return grouped.select(
        *keys,
        "hub_fraction",
        "hub_threshold",
        "n_hubs",
        "n_newcomers",
        ratio(F.col("_new_hubs"), F.col("n_hubs")).alias("newcomer_hub_share"),
        F.when(F.col("n_hubs") > 0, ratio(F.col("_new_hubs"), F.col("n_newcomers"))).alias("newcomer_hub_rate"),
        F.when(both, F.col("_existing")).alias("existing_threshold"),
        F.when(both, ratio(F.col("_new_above"), F.col("n_newcomers"))).alias("newcomer_hub_rate_vs_existing"),
    )


def hub_sensitivity_summary(sensitivity: DataFrame, keys: Sequence[str] = ("community",)) -> DataFrame:
    """Largest and median shares and rates over months."""

    def median(c: str):
        return F.percentile(c, F.lit(0.5))

    return sensitivity.groupBy(*keys, "hub_fraction").agg(
        F.max("newcomer_hub_share").alias("max_hub_share"),
        median("newcomer_hub_share").alias("median_hub_share"),
        F.max("newcomer_hub_rate").alias("max_hub_rate"),
        median("newcomer_hub_rate_vs_existing").alias("median_rate_vs_existing"),
        F.max("newcomer_hub_rate_vs_existing").alias("max_rate_vs_existing"),
    )


def top_fraction_hubs(nodes: DataFrame, keys: Sequence[str], fractions: Sequence[float] = (0.05, 0.1, 0.2)) -> DataFrame:
    """The ``max(1, ceil(n * fraction))`` nodes of highest degree per snapshot and fraction.

    The histogram tells the degree at which a snapshot's quota runs out. Only the nodes of that
    degree compete by name, and only they are numbered.
    """
    keys = list(keys)
    nodes = cut_lineage(nodes.select(*keys, "node", "degree"))
    histogram = graph.degree_histogram(nodes, keys)
    higher = Window.partitionBy(*keys).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.select(
        *keys,
        "degree",
        "n",
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_above"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("_size"),
    )
    # A step of its own: windows beside an explode would count the exploded rows.
    placed = placed.withColumn("hub_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    # The product is rounded first so that 10 * 0.1 does not exceed 1.
    quota = F.greatest(F.lit(1), F.ceil(F.round(F.col("_size") * F.col("hub_fraction"), 9))).cast("bigint")
    placed = placed.withColumn("_left", quota - F.col("_above")).where(F.col("_left") > 0)
    whole = placed.where(F.col("_left") >= F.col("n")).select(*keys, "degree", "hub_fraction")
    contested = placed.where(F.col("_left") < F.col("n")).select(*keys, "degree", "hub_fraction", "_left")
    all_in = nodes.join(whole, [*keys, "degree"]).select(*keys, "node", "degree", "hub_fraction")
    rivals = nodes.join(contested.select(*keys, "degree").distinct(), [*keys, "degree"], "left_semi")
    ranked = numbered_rows(rivals.select(*keys, "node", "degree"), [*keys, "degree"], [F.col("node")], "_rank")
    some_in = (
        ranked.join(contested, [*keys, "degree"])
        .where(F.col("_rank") <= F.col("_left"))
        .select(*keys, "node", "degree", "hub_fraction")
    )
    return all_in.unionByName(some_in)


def cohort_degree_share(nodes: DataFrame, keys: Sequence[str], cohort: str = "fixed_cohort") -> DataFrame:
    """Active nodes, share of people, share of degrees and their ratio per cohort."""
    keys = list(keys)
    groups = nodes.groupBy(*keys, cohort).agg(
        F.count("*").alias("cohort_active_nodes"), F.sum("degree").alias("_held")
    )
    whole = Window.partitionBy(*keys)
    pop = ratio(F.col("cohort_active_nodes"), F.sum("cohort_active_nodes").over(whole))
    held = ratio(F.col("_held"), F.sum("_held").over(whole))
    shares = groups.withColumn("cohort_pop_share", pop).withColumn("cohort_degree_share", held)
    return shares.withColumn(
        "degree_share_ratio", ratio(F.col("cohort_degree_share"), F.col("cohort_pop_share"))
    ).drop("_held")


def ever_hub(
    hubs: DataFrame, users: Sequence[str] = ("community", "node"), fractions: Sequence[float] = (0.05, 0.1, 0.2)
) -> DataFrame:
    """Users that were a hub in some snapshot, one flag per fraction."""
    return hubs.groupBy(*users).agg(
        *[
            F.bool_or(F.abs(F.col("hub_fraction") - f) < 1e-9).alias(f"ever_hub_top{round(f * 100)}")
            for f in fractions
        ]
    )


def join_hub_flags(users: DataFrame, flags: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach hub flags; users that never were in a network have false."""
    names = [c for c in flags.columns if c.startswith("ever_hub_")]
    joined = users.join(flags, list(on), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in names})
