"""Exact linear-interpolated quantiles and robust screening for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Steps per factor e of the value scale: a bucket spans 1/65536 of its value.
BUCKETS_PER_EFOLD = 65536
MAD_TO_SD = 1.4826


def _bucket(value: Column) -> Column:
    """Order-preserving logarithmic bucket; only its monotonicity matters for correctness."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) * 1e6) * BUCKETS_PER_EFOLD)).cast("bigint")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], small_groups: bool = False) -> DataFrame:
    """Per-key exact quantiles, one output column per entry of ``probs``.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here a first pass counts values per (key, bucket), which combines on
    the map side; the buckets holding the wanted ranks are then the only ones
    whose values are looked at. A hot key therefore spreads over all tasks.
    ``small_groups`` states that every group is known to be short (the strides
    of a trial) and uses the built-in aggregate.
    """
    if small_groups:
        v = F.col(value).cast("double")
        return df.where(v.isNotNull()).groupBy(*keys).agg(
            *[F.percentile(v, float(p)).alias(n) for n, p in probs.items()])
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v")).withColumn("_b", _bucket(F.col("_v")))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.select(
        *keys, "_b", "_n", (F.sum("_n").over(ordered) - F.col("_n")).alias("_skip"),
        F.sum("_n").over(whole).alias("_total"))
    # floating rank position per quantile, and the two integer ranks around it
    positions = [(F.lit(p) * (F.col("_total") - 1)) for p in probs.values()]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in positions for f in (F.floor, F.ceil)]))
    # a few rows per key: the buckets a wanted rank falls into
    wanted = ranked.where(F.exists(ranks, lambda r: (r >= F.col("_skip")) & (r < F.col("_skip") + F.col("_n")))).select(
        *keys, "_b", "_skip", "_total")
    values = rows.join(wanted, [*keys, "_b"]).groupBy(*keys, "_b", "_skip", "_total", "_v").agg(
        F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_upto", F.col("_skip") + F.sum("_n").over(inside))
    hits = placed.select(*keys, "_total", "_v", F.explode(F.filter(
        ranks, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))).alias("_rank"))
    picked = hits.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def result(p: float) -> Column:
        pos = F.lit(p) * (F.col("_total") - 1)
        lo = F.try_element_at("_at", F.floor(pos).cast("bigint"))
        hi = F.try_element_at("_at", F.ceil(pos).cast("bigint"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    return picked.select(*keys, *[result(p).alias(n) for n, p in probs.items()])


def median_and_scale(df: DataFrame, keys: Sequence[str], value: str, small_groups: bool = False) -> DataFrame:
    """Per-key median and scaled median absolute deviation."""
    # a few numbers per key, used by both passes that follow
    med = cut_lineage(exact_quantiles(df, keys, value, {"med": 0.5}, small_groups))
    spread = df.where(F.col(value).isNotNull()).join(med, list(keys)).select(
        *keys, F.abs(F.col(value) - F.col("med")).alias("_dev"))
    mad = exact_quantiles(spread, keys, "_dev", {"_mad": 0.5}, small_groups)
    return med.join(mad, list(keys)).select(
        *keys, "med", (F.lit(MAD_TO_SD) * F.col("_mad")).alias("mad_scaled"))


def duration_bounds(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float,
                    mad_k: float, small_groups: bool = False) -> DataFrame:
    """Per-key acceptance range: the fixed range cut by ``mad_k`` robust deviations."""
    stats = median_and_scale(df, keys, value, small_groups)
    reach = F.lit(float(mad_k)) * F.col("mad_scaled")
    return stats.select(
        *keys, "med", "mad_scaled",
        F.greatest(F.lit(float(lo)), F.col("med") - reach).alias("lo"),
        F.least(F.lit(float(hi)), F.col("med") + reach).alias("hi"))


def duration_screen(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float,
                    mad_k: float, small_groups: bool = False) -> DataFrame:
    """Rows whose value lies inside their key's acceptance range, ends included."""
    bounds = duration_bounds(df, keys, value, lo, hi, mad_k, small_groups).select(*keys, "lo", "hi")
    return (df.join(bounds, list(keys))
            .where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))).drop("lo", "hi"))


def robust_outliers(df: DataFrame, keys: Sequence[str], value: str, z_max: float,
                    small_groups: bool = False) -> DataFrame:
    """Add ``z`` and ``outlier``: robust z-score against the key's median.

    A zero spread divides by 1e-12, so any departure from the median is an outlier.
    """
    stats = median_and_scale(df, keys, value, small_groups)
    scale = F.when(F.col("mad_scaled") > 0, F.col("mad_scaled")).otherwise(F.lit(1e-12))
    return (df.join(stats, list(keys))
            .withColumn("z", F.abs(F.col(value) - F.col("med")) / scale)
            .withColumn("outlier", F.col("z") > F.lit(float(z_max))))


def drift_union(df: DataFrame, unit: Sequence[str], channel: str, stride: str, value: str,
                z_max: float = 3.0, fail_fraction: float = 0.20,
                small_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Baseline drift over all channels of a unit.

    Returns the strides that are no outlier in any channel, and per channel the
    outlier share with its failure flag. Failed channels still count in the union.
    """
    marked = robust_outliers(df, [*unit, channel], value, z_max, small_groups)
    kept = (marked.groupBy(*unit, stride).agg(F.bool_or("outlier").alias("_bad"))
            .where(~F.col("_bad")).drop("_bad"))
    channels = marked.groupBy(*unit, channel).agg(
        F.first("med").alias("baseline_med"), F.first("mad_scaled").alias("baseline_mad_scaled"),
        F.avg(F.col("outlier").cast("double")).alias("outlier_frac"),
    ).withColumn("drift_fail", F.col("outlier_frac") > fail_fraction)
    return kept, channels


def summarise(df: DataFrame, keys: Sequence[str], value: str, prob: float = 0.10) -> DataFrame:
    """Finite-only mean, quantile, minimum, maximum and count per key."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("n"))
    return stats.join(exact_quantiles(df, keys, value, {"q": prob}), list(keys), "left")
