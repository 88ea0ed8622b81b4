"""Change between adjacent conditions, beyond within-condition reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_floats, pace, require_columns, speed_key
from ..operators import statistics
from ..operators.joins import with_partner
from ..operators.selection import complete_pivot
from ..operators.selection import max_transition as largest

GROUP = ["dataset", "subject", "trial"]
# Adjacent speeds from fast to slow.
ADJACENT = ((5.0, 4.0), (4.0, 3.33), (3.33, 3.0), (3.0, 2.78))


def transitions(spark, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    rows = [(i, f"{a}->{b}", a, b, round(a * 100), round(b * 100)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "transition_order int, transition string, speed_fast_mps double, "
                                       "speed_slow_mps double, fast_key int, slow_key int").select(
        "*", pace("speed_fast_mps").alias("pace_fast_min_per_km"), pace("speed_slow_mps").alias("pace_slow_min_per_km"))


def _single(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with exactly one row; anything else has no usable value."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values]).where("_n = 1").drop("_n")


def transition_drops(within: DataFrame, pairwise: DataFrame, dataset: str | None = None,
                     pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    """Per subject and adjacent pair: within-speed reliability, cross-speed fidelity and their gap.

    The pair table is a literal of a few rows and is broadcast; both measure
    tables are read once each and reduced to one row per (subject, speeds).
    """
    require_columns(within, [*GROUP, "speed_mps", "within_fid_mean", "within_fid_q10"], "within")
    require_columns(pairwise, [*GROUP, "speed_a_mps", "speed_b_mps", "fidelity_a_to_b"], "pairwise")
    within, pairwise = clean_floats(within), clean_floats(pairwise)
    if dataset is not None:
        within, pairwise = within.where(F.col("dataset") == dataset), pairwise.where(F.col("dataset") == dataset)
    within = within.dropna("any", subset=["within_fid_mean", "within_fid_q10"])
    plan = transitions(within.sparkSession, pairs)
    labels = [c for c in plan.columns if c not in ("fast_key", "slow_key")]
    # each transition once per end and once per direction, so both joins are equi-joins on a literal table
    ends = F.explode(F.array(F.struct(F.col("fast_key").alias("key"), F.lit(True).alias("is_fast")),
                             F.struct(F.col("slow_key").alias("key"), F.lit(False).alias("is_fast"))))
    by_end = F.broadcast(plan.select(*labels, ends.alias("_e")).select(*labels, "_e.*"))
    ways = F.explode(F.array(
        F.struct(F.col("fast_key").alias("a"), F.col("slow_key").alias("b"), F.lit(True).alias("is_down")),
        F.struct(F.col("slow_key").alias("a"), F.col("fast_key").alias("b"), F.lit(False).alias("is_down"))))
    by_way = F.broadcast(plan.select("transition", ways.alias("_w")).select("transition", "_w.*"))
    w = _single(with_partner(within, pairwise, GROUP).withColumn("key", speed_key("speed_mps")), [*GROUP, "key"],
                ["within_fid_mean", "within_fid_q10"])
    fast, down = F.col("is_fast"), F.col("is_down")
    sides = w.join(by_end, "key").groupBy(*GROUP, *labels).agg(
        F.max(F.when(fast, F.col("within_fid_mean"))).alias("within_fidelity_fast"),
        F.max(F.when(~fast, F.col("within_fid_mean"))).alias("within_fidelity_slow"),
        F.max(F.when(fast, F.col("within_fid_q10"))).alias("within_q10_fast"),
        F.max(F.when(~fast, F.col("within_fid_q10"))).alias("within_q10_slow"))
    p = _single(pairwise.select(*GROUP, speed_key("speed_a_mps").alias("a"), speed_key("speed_b_mps").alias("b"),
                                "fidelity_a_to_b"), [*GROUP, "a", "b"], ["fidelity_a_to_b"])
    cross = p.join(by_way, ["a", "b"]).groupBy(*GROUP, "transition").agg(
        F.max(F.when(down, F.col("fidelity_a_to_b"))).alias("cross_fidelity_fast_to_slow"),
        F.max(F.when(~down, F.col("fidelity_a_to_b"))).alias("cross_fidelity_slow_to_fast"))
    rows = sides.join(cross, [*GROUP, "transition"]).dropna("any", subset=[
        "within_fidelity_fast", "within_fidelity_slow", "within_q10_fast", "within_q10_slow",
        "cross_fidelity_fast_to_slow", "cross_fidelity_slow_to_fast"])
    c = F.col
    rows = (rows.withColumn("within_fidelity_avg", 0.5 * (c("within_fidelity_fast") + c("within_fidelity_slow")))
            .withColumn("within_q10_threshold", 0.5 * (c("within_q10_fast") + c("within_q10_slow")))
            .withColumn("cross_fidelity_avg", 0.5 * (c("cross_fidelity_fast_to_slow") + c("cross_fidelity_slow_to_fast")))
            .withColumn("drop", c("within_fidelity_avg") - c("cross_fidelity_avg"))
            .withColumn("drop_beyond", F.greatest(F.lit(0.0), c("within_q10_threshold") - c("cross_fidelity_avg")))
            .withColumn("pass_within_q10", c("cross_fidelity_avg") >= c("within_q10_threshold")))
    return rows.select(
        *GROUP, "transition", "transition_order", "speed_fast_mps", "speed_slow_mps", "pace_fast_min_per_km",
        "pace_slow_min_per_km", "within_fidelity_fast", "within_fidelity_slow", "within_fidelity_avg", "within_q10_fast",
        "within_q10_slow", "within_q10_threshold", "cross_fidelity_fast_to_slow", "cross_fidelity_slow_to_fast",
        "cross_fidelity_avg", "drop", "drop_beyond", "pass_within_q10")


def max_reorganisation(drops: DataFrame) -> DataFrame:
    """Each subject's transition with the largest drop beyond its bounds; the earliest wins ties."""
    top = largest(drops, GROUP, "drop_beyond", "transition_order")
    names = {"transition": "max_reorg_transition", "speed_fast_mps": "max_reorg_speed_fast",
             "speed_slow_mps": "max_reorg_speed_slow", "drop_beyond": "max_drop_beyond",
             "cross_fidelity_avg": "cross_fidelity_avg_at_max", "within_q10_threshold": "within_q10_threshold_at_max",
             "drop": "drop_mean_at_max"}
    return top.select(*GROUP, *[F.col(a).alias(b) for a, b in names.items()])


def group_summary(drops: DataFrame, maxima: DataFrame, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    labels = transitions(drops.sparkSession, pairs).drop("fast_key", "slow_key")
    out = statistics.group_summary(drops, "transition", "drop", labels, "transition_order", maxima, "max_reorg_transition")
    return out.orderBy("transition_order").select(
        "transition", "speed_fast_mps", "speed_slow_mps", "pace_fast_min_per_km", "pace_slow_min_per_km", "drop_mean",
        "drop_sd", "n", F.col("n_max_here").alias("n_subjects_max_here"),
        F.col("pct_max_here").alias("pct_subjects_max_here"), F.col("ratio_to_first").alias("ratio_vs_5_to_4"))


def complete_subjects(drops: DataFrame, measure: str, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    return complete_pivot(drops, GROUP, "transition", [f"{a}->{b}" for a, b in pairs], measure)


def transition_tests(drops: DataFrame, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    """Paired tests between all transitions with Holm adjustment and effect-size intervals."""
    names = [f"{a}->{b}" for a, b in pairs]
    tests = statistics.paired_tests(complete_subjects(drops, "drop", pairs), names)
    tests = statistics.effect_interval(statistics.holm(tests, "p_uncorrected", tie=["_ord"]))
    return tests.orderBy("p_uncorrected", "_ord").select(
        "comparison", "n", "df", "mean_drop_a", "mean_drop_b", "mean_difference", "t_statistic", "p_uncorrected", "dz",
        "dz_ci_low", "dz_ci_high", "p_holm", (F.col("p_holm") < 0.05).alias("significant_holm_0p05"))


def friedman_test(drops: DataFrame, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    names = [f"{a}->{b}" for a, b in pairs]
    wide = complete_subjects(drops, "drop", pairs)
    long = wide.unpivot(GROUP, [f"`{n}`" for n in names], "transition", "drop")
    return statistics.friedman(long, GROUP, "transition", "drop")


def beyond_matrix(drops: DataFrame, pairs: Sequence[tuple[float, float]] = ADJACENT) -> DataFrame:
    """Subjects by transitions, gaps left empty."""
    names = [f"{a}->{b}" for a, b in pairs]
    return drops.groupBy(*GROUP).pivot("transition", names).agg(F.first("drop_beyond")).orderBy(*GROUP)
