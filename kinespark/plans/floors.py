"""Sequential gates and floors: slowest tested speed before the first failed gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_floats, require_columns, speed_key
from ..operators.joins import assert_unique
from ..operators.selection import floors as reduce_floors
from ..operators.selection import sequential_gates

KEYS = ["dataset", "subject", "trial"]
# Reference speed, and the tested speeds from fast to slow.
REFERENCE_SPEED = 5.0
TEST_ORDER = (4.0, 3.33, 3.0, 2.78)
PRIMARY = ["g1", "g2"]
ALL_GATES = ["g1", "g2", "g3", "g4", "g5", "g6", "g7"]
BOUNDS = ["L_ref_fidelity", "L_ref_cosine_median", "U_ref_dtw_mean", "U_ref_principal_angle_max_deg"]
MARGINS = ["margin_fid_ref", "margin_fid_q", "margin_surrogate_ref", "margin_surrogate_q",
           "margin_cos", "margin_dtw", "margin_angle"]


def _by_speed(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    require_columns(df, [*KEYS, "q_speed_mps", *columns], what)
    rows = clean_floats(df).select(*KEYS, speed_key("q_speed_mps").alias("speed_key"), *columns)
    return assert_unique(rows, [*KEYS, "speed_key"], f"{what} row")


def gates(bounds: DataFrame, fidelity: DataFrame, surrogate: DataFrame, metrics: DataFrame,
          test_order: tuple[float, ...] = TEST_ORDER) -> DataFrame:
    """One row per subject and tested speed with seven gates, margins and sequence flags."""
    require_columns(bounds, [*KEYS, *BOUNDS], "bounds")
    spark = bounds.sparkSession
    order = spark.createDataFrame(
        [(i, float(s), round(s * 100)) for i, s in enumerate(test_order)],
        "seq_index int, q_speed_mps double, speed_key int")
    subjects = assert_unique(clean_floats(bounds).select(*KEYS, *BOUNDS), KEYS, "bounds row")
    plan = F.broadcast(order)
    fid = _by_speed(fidelity, ["fidelity_ref_to_q", "fidelity_q_to_ref"], "fidelity").join(plan, "speed_key")
    surr = _by_speed(surrogate, ["F_null_95"], "surrogate")
    met = _by_speed(metrics, ["cosine_median", "dtw_mean", "principal_angle_max_deg"], "metrics")
    on = [*KEYS, "speed_key"]
    rows = fid.join(surr, on).join(met, on).join(subjects, KEYS)
    c = F.col
    rows = rows.select(
        *KEYS, "q_speed_mps", "seq_index", "fidelity_ref_to_q", "fidelity_q_to_ref", "F_null_95",
        "cosine_median", "dtw_mean", "principal_angle_max_deg", *BOUNDS,
        (c("fidelity_ref_to_q") - c("L_ref_fidelity")).alias("margin_fid_ref"),
        (c("fidelity_q_to_ref") - c("L_ref_fidelity")).alias("margin_fid_q"),
        (c("fidelity_ref_to_q") - c("F_null_95")).alias("margin_surrogate_ref"),
        (c("fidelity_q_to_ref") - c("F_null_95")).alias("margin_surrogate_q"),
        (c("cosine_median") - c("L_ref_cosine_median")).alias("margin_cos"),
        (c("U_ref_dtw_mean") - c("dtw_mean")).alias("margin_dtw"),
        (c("U_ref_principal_angle_max_deg") - c("principal_angle_max_deg")).alias("margin_angle"),
        *[F.coalesce(g, F.lit(False)).alias(n) for n, g in {
            "g1": c("fidelity_ref_to_q") >= c("L_ref_fidelity"),
            "g2": c("fidelity_q_to_ref") >= c("L_ref_fidelity"),
            # the null gates are strict
            "g3": c("fidelity_ref_to_q") > c("F_null_95"),
            "g4": c("fidelity_q_to_ref") > c("F_null_95"),
            "g5": c("cosine_median") >= c("L_ref_cosine_median"),
            "g6": c("dtw_mean") <= c("U_ref_dtw_mean"),
            "g7": c("principal_angle_max_deg") <= c("U_ref_principal_angle_max_deg")}.items()])
    rows = sequential_gates(rows, KEYS, "seq_index", PRIMARY, "primary_")
    return sequential_gates(rows, KEYS, "seq_index", ALL_GATES, "all_")


def detect(bounds: DataFrame, fidelity: DataFrame, surrogate: DataFrame, metrics: DataFrame,
           test_order: tuple[float, ...] = TEST_ORDER,
           reference: float = REFERENCE_SPEED) -> tuple[DataFrame, DataFrame]:
    """Gate table by speed, and the floor table by subject.

    Every subject of the bounds table needs exactly one row per tested speed in
    each source; a missing one fails the query.
    """
    gated = gates(bounds, fidelity, surrogate, metrics, test_order)
    primary = reduce_floors(gated, KEYS, "seq_index", "q_speed_mps", reference, MARGINS, "primary_")
    strict = reduce_floors(gated, KEYS, "seq_index", "q_speed_mps", reference, (), "all_")
    strict = strict.select(*KEYS, *[F.col(n).alias(f"{n}_7gate") for n in strict.columns if n not in KEYS])
    complete = gated.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    known = bounds.select(*KEYS, *[F.col(b) for b in BOUNDS]).join(complete, KEYS, "left")
    short = F.raise_error(F.concat(F.lit("missing tested speed for "), F.to_json(F.struct(*KEYS))))
    known = known.where(F.when(F.col("_n") == len(test_order), F.lit(True)).otherwise(
        short.cast("boolean"))).drop("_n")
    table = (known.join(primary, KEYS).join(strict, KEYS)
             .withColumn("ref_speed_mps", F.lit(float(reference))))
    by_speed = gated.select(
        *[n for n in gated.columns if not n.startswith(("primary_", "all_"))],
        F.col("primary_considered").alias("seq_considered"), F.col("all_considered").alias("seq_considered_7gate"),
        F.col("primary_pass").alias("pass_primary"), F.col("all_pass").alias("pass_7gate"),
        F.col("all_pass").alias("all_gates_pass"))
    return by_speed, table
