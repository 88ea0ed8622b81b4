"""Average linkage over distance tables, for many groups at once.

The state is one row per pair of leaves with the clusters both are in. The distance of two clusters is the mean over
their pairs, so a step is an aggregate, the nearest pair of each group, and a join that renames one cluster to the
other; the pairs that a step brings together get its distance as their height. A group of n leaves takes n - 1 steps,
all groups take them together, and a group that is done is only carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: digits of a mean distance that decide which clusters are nearest; ties go to the smaller names
DIGITS = 12


def cophenetic_heights(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pairs`` (keys, a, b, d; a < b, every pair of a group once) with ``height``, where average linkage joins a and b."""
    keys = list(keys)
    if not keys:
        raise ValueError("groups need a key")
    state = cut_lineage(pairs.select(*keys, "a", "b", "d", F.col("a").alias("_ca"), F.col("b").alias("_cb"), F.lit(None).cast("double").alias("height")))
    while True:
        open_ = state.where("_ca <> _cb")
        low, high = F.least("_ca", "_cb"), F.greatest("_ca", "_cb")
        between = open_.groupBy(*keys, low.alias("_low"), high.alias("_high")).agg(F.avg("d").alias("_mean"))
        order = F.struct(F.round("_mean", DIGITS), F.col("_low"), F.col("_high"))
        step = between.groupBy(*keys).agg(F.min_by(F.struct("_low", "_high", "_mean"), order).alias("_step"))
        step = cut_lineage(step.select(*keys, "_step.*"))
        if step.isEmpty():
            return state.select(*keys, "a", "b", "d", "height")
        met = state.join(step, keys, "left")
        names = {c: F.when(F.col(c) == F.col("_high"), F.col("_low")).otherwise(F.col(c)) for c in ("_ca", "_cb")}
        moved = met.select(*keys, "a", "b", "d", *[e.alias(c) for c, e in names.items()], "height", "_mean")
        now = F.when(F.col("height").isNull() & (F.col("_ca") == F.col("_cb")), F.col("_mean")).otherwise(F.col("height"))
        state = cut_lineage(moved.withColumn("height", now).drop("_mean"))


def consensus_quality(consensus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cophenetic, dispersion) of consensus tables (keys, a, b, c; a < b), c the share of runs that put a and b together.

    Dispersion is 1 for shares of 0 and 1 only. The cophenetic correlation needs three members; where all shares are
    equal it has none, and the dispersion decides: 1 if they all are nearly 0 or 1, 0 if they all are nearly a half.
    """
    keys = list(keys)
    rows = cut_lineage(consensus.select(*keys, "a", "b", "c", (1 - F.col("c")).alias("d")))
    reduced = rows.groupBy(*keys).agg(
        F.count("*").alias("_pairs"), F.avg(4 * (F.col("c") - 0.5) * (F.col("c") - 0.5)).alias("dispersion"), F.stddev_pop("d").alias("_sd"))
    uneven = reduced.where("_pairs >= 3 AND _sd >= 1e-12").select(*keys)
    heights = cophenetic_heights(rows.join(uneven, keys, "left_semi").select(*keys, "a", "b", "d"), keys)
    fit = heights.groupBy(*keys).agg(F.corr("d", "height").alias("_corr"))
    # three members have three pairs
    value = (F.when(F.col("_pairs") < 3, None).when(F.col("_sd") >= 1e-12, F.nullif(F.col("_corr"), F.lit(float("nan"))))
             .when(F.col("dispersion") > 0.95, 1.0).when(F.col("dispersion") < 0.05, 0.0))
    return reduced.join(fit, keys, "left").select(*keys, value.alias("cophenetic"), "dispersion")
