"""Fixed-effect panels of communities and months with cluster-robust errors.

Community effects are removed by taking values relative to the community's mean, which gives the
same slopes and errors as one dummy column per community, and leaves four columns however many
communities there are. Spark sums the products; the driver solves the four-by-four system of each
outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import timeparts
from tideline.functions.stats import normal_two_sided_p
from tideline.session import cut_lineage

TERMS = ("newcomer_pop_share", "post_event", "newcomer_x_post", "time_index")
_PAIRS = list(combinations_with_replacement(range(len(TERMS)), 2))


def panel_rows(panel: DataFrame, outcomes: Sequence[str], cutoff: str, cluster: str = "community") -> DataFrame:
    """One row per outcome, community and month that has the outcome and the newcomer share."""
    doubles = panel.select(
        cluster, "month", F.col("newcomer_pop_share").cast("double").alias("newcomer_pop_share"),
        *[F.col(o).cast("double").alias(o) for o in outcomes],
    )
    long = doubles.unpivot([cluster, "month", "newcomer_pop_share"], list(outcomes), "outcome", "y")
    known = long.where(F.col("y").isNotNull() & F.col("newcomer_pop_share").isNotNull())
    post = (timeparts.month_start(F.col("month")) >= F.lit(cutoff).cast("timestamp")).cast("double")
    return known.select(
        "outcome",
        F.col(cluster).alias("cluster"),
        "month",
        "y",
        "newcomer_pop_share",
        post.alias("post_event"),
        (F.col("newcomer_pop_share") * post).alias("newcomer_x_post"),
        timeparts.month_index(F.col("month")).cast("double").alias("time_index"),
    )


def _cluster_sums(rows: DataFrame) -> DataFrame:
    """Products of values relative to their cluster's means, summed per cluster."""
    means = rows.groupBy("outcome", "cluster").agg(
        F.avg("y").alias("_y"), *[F.avg(t).alias(f"_m{i}") for i, t in enumerate(TERMS)]
    )
    joined = rows.join(means, ["outcome", "cluster"])
    z = [F.col(t) - F.col(f"_m{i}") for i, t in enumerate(TERMS)]
    y = F.col("y") - F.col("_y")
    return joined.groupBy("outcome", "cluster").agg(
        F.count("*").alias("n"),
        F.sum(y * y).alias("yy"),
        F.first("_y").alias("y_mean"),
        *[F.first(f"_m{i}").alias(f"m{i}") for i in range(len(TERMS))],
        *[F.sum(z[i] * z[j]).alias(f"g{i}{j}") for i, j in _PAIRS],
        *[F.sum(z[i] * y).alias(f"h{i}") for i in range(len(TERMS))],
    )


def _square(row, stem: str) -> np.ndarray:
    out = np.zeros((len(TERMS), len(TERMS)))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = row[f"{stem}{i}{j}"]
    return out


def _pick(by_outcome: dict[str, float]) -> Column:
    """A literal that depends on the outcome; outcomes are a parameter, so few."""
    chain = None
    for name, value in by_outcome.items():
        test = F.col("outcome") == name
        literal = F.lit(float(value))
        chain = F.when(test, literal) if chain is None else chain.when(test, literal)
    return chain


class PanelFit:
    """Solved slopes of every outcome, and the tables that follow from them."""

    def __init__(self, panel: DataFrame, outcomes: Sequence[str], cutoff: str, cluster: str = "community"):
        # Community-months are few next to what they were made from, which is not read again.
        self.rows = cut_lineage(panel_rows(panel, outcomes, cutoff, cluster))
        self.clusters = cut_lineage(_cluster_sums(self.rows))
        totals = self.clusters.groupBy("outcome").agg(
            F.sum("n").alias("n"),
            F.count("*").alias("g"),
            F.sum("yy").alias("yy"),
            *[F.sum(f"g{i}{j}").alias(f"g{i}{j}") for i, j in _PAIRS],
            *[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(TERMS))],
        )
        spread = self.rows.groupBy("outcome").agg((F.var_pop("y") * F.count("y")).alias("total"))
        # One row per outcome.
        self.solved = {row["outcome"]: row for row in totals.join(spread, "outcome").collect()}
        self.inverse = {o: np.linalg.pinv(_square(r, "g")) for o, r in self.solved.items()}
        self.beta = {
            o: self.inverse[o] @ np.array([r[f"h{i}"] for i in range(len(TERMS))]) for o, r in self.solved.items()
        }
        self.variance = self._cluster_variance()

    def _cluster_variance(self) -> dict[str, np.ndarray]:
        """Sandwich of the clusters' scores, which Spark sums with the slopes as literals."""
        if not self.solved:
            return {}
        gram = {(i, j): F.col(f"g{min(i, j)}{max(i, j)}") for i in range(len(TERMS)) for j in range(len(TERMS))}
        beta = [_pick({o: b[j] for o, b in self.beta.items()}) for j in range(len(TERMS))]
        scores = [
            (F.col(f"h{i}") - sum((gram[i, j] * beta[j] for j in range(len(TERMS))), F.lit(0.0))).alias(f"s{i}")
            for i in range(len(TERMS))
        ]
        scored = self.clusters.select("outcome", *scores)
        meat = scored.groupBy("outcome").agg(
            *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}") for i, j in _PAIRS]
        )
        out = {}
        for row in meat.collect():
            o = row["outcome"]
            n, g = self.solved[o]["n"], self.solved[o]["g"]
            k = len(TERMS) + g
            v = self.inverse[o] @ _square(row, "m") @ self.inverse[o]
            if g > 1 and n > k + 1:
                v = v * (g / (g - 1)) * ((n - 1) / (n - k))
            out[o] = v
        return out

    def _with_tests(self, table: DataFrame) -> DataFrame:
        t = F.try_divide("coef", "se_cluster")
        return table.withColumn("t_stat", t).withColumn("p_value_norm", normal_two_sided_p(F.col("t_stat")))

    def coefficients(self) -> DataFrame:
        """Slopes with errors, one row per outcome and term."""
        rows = []
        for o, r in sorted(self.solved.items()):
            residual = r["yy"] - float(self.beta[o] @ np.array([r[f"h{i}"] for i in range(len(TERMS))]))
            r2 = 1 - residual / r["total"] if r["total"] > 0 else None
            for i, term in enumerate(TERMS):
                error = float(np.sqrt(max(self.variance[o][i, i], 0.0)))
                rows.append((o, term, float(self.beta[o][i]), error, r2, int(r["n"]), int(r["g"])))
        schema = "outcome string, term string, coef double, se_cluster double, r2 double, n_obs bigint, n_clusters bigint"
        return self._with_tests(self.rows.sparkSession.createDataFrame(rows, schema))

    def community_effects(self) -> DataFrame:
        """Intercept of the first community and every other community's distance from it.

        Residuals of a community sum to zero, so these vary with the slopes alone: their variance
        is that of the slopes at the difference of the communities' means.
        """
        first_time = self.rows.groupBy("outcome").agg(F.min("time_index").alias("_t0"))
        at_zero = self.clusters.join(first_time, "outcome").withColumn("m3", F.col("m3") - F.col("_t0"))
        base = at_zero.groupBy("outcome").agg(
            F.min_by(F.struct("cluster", "y_mean", *[f"m{i}" for i in range(len(TERMS))]), "cluster").alias("_b")
        )
        joined = at_zero.join(base, "outcome")
        is_base = F.col("cluster") == F.col("_b.cluster")

        def relative(c: str) -> Column:
            return F.col(c) - F.when(is_base, 0.0).otherwise(F.col(f"_b.{c}"))

        d = [relative(f"m{i}") for i in range(len(TERMS))]
        beta = [_pick({o: b[i] for o, b in self.beta.items()}) for i in range(len(TERMS))]
        coef = relative("y_mean") - sum((beta[i] * d[i] for i in range(len(TERMS))), F.lit(0.0))
        variance = sum(
            (
                _pick({o: v[i, j] for o, v in self.variance.items()}) * d[i] * d[j]
                for i in range(len(TERMS))
                for j in range(len(TERMS))
            ),
            F.lit(0.0),
        )
        table = joined.select(
            "outcome",
            F.when(is_base, F.lit("intercept")).otherwise(F.concat(F.lit("fe_"), "cluster")).alias("term"),
            coef.alias("coef"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se_cluster"),
        )
        return self._with_tests(table)

    def descriptives(self) -> DataFrame:
        """Means before and after the cutoff, and the implied effect of newcomers on either side."""
        post = F.col("post_event") == 1
        means = self.rows.groupBy("outcome").agg(
            F.avg(F.when(~post, F.col("y"))).alias("pre_outcome_mean"),
            F.avg(F.when(post, F.col("y"))).alias("post_outcome_mean"),
            F.avg(F.when(~post, F.col("newcomer_pop_share"))).alias("pre_share_mean"),
            F.avg(F.when(post, F.col("newcomer_pop_share"))).alias("post_share_mean"),
        )
        return means.withColumns({
            "implied_effect_pre": _pick({o: b[0] for o, b in self.beta.items()}),
            "implied_effect_post": _pick({o: b[0] + b[2] for o, b in self.beta.items()}),
        })


def panel_fe_cluster_ols(
    panel: DataFrame, outcome: str, cutoff: str, cluster: str = "community"
) -> DataFrame:
    """Outcome on newcomer share, period, their product and time, with community effects."""
    return PanelFit(panel, [outcome], cutoff, cluster).coefficients()


def panel_models(panel: DataFrame, outcomes: Sequence[str], cutoff: str, cluster: str = "community") -> DataFrame:
    """The same model for several outcomes, with descriptive means beside the slopes."""
    fit = PanelFit(panel, outcomes, cutoff, cluster)
    return fit.coefficients().join(fit.descriptives(), "outcome")


def multi_outcome_terms(panel: DataFrame, outcomes: Sequence[str], cutoff: str, cluster: str = "community") -> DataFrame:
    """All terms of every outcome's model, community effects included."""
    fit = PanelFit(panel, outcomes, cutoff, cluster)
    return fit.coefficients().unionByName(fit.community_effects(), allowMissingColumns=True)
