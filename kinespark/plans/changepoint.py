"""Breakpoint cross-check of the floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_floats, coerce_number
from ..operators.changepoint import hinge_breakpoint, single_mean_shift
from ..operators.joins import nearest_lookup
from ..session import cut_lineage
from .floors import KEYS


def _curve(gates: DataFrame, dataset: str | None) -> DataFrame:
    rows = clean_floats(gates)
    if dataset is not None:
        rows = rows.where(F.col("dataset") == dataset)
    # least skips NULL, so one missing direction leaves the other
    return rows.select("dataset", "subject", F.col("trial").cast("int").alias("trial"),
                       coerce_number("q_speed_mps").alias("q_speed_mps"),
                       F.least("fidelity_ref_to_q", "fidelity_q_to_ref").alias("fidelity_min"))


def fidelity_curve(gates: DataFrame, dataset: str | None = None) -> DataFrame:
    """Smaller of the two fidelities per tested speed, fastest first."""
    return _curve(gates, dataset).orderBy("dataset", "subject", "trial", F.desc("q_speed_mps"))


def crosscheck(gates: DataFrame, floors: DataFrame, n_grid: int = 2000, dataset: str | None = None) -> DataFrame:
    """Hinge and mean-shift breakpoints beside the primary floor, with notes on their agreement."""
    curve = _curve(gates, dataset).dropna("any", subset=["q_speed_mps", "fidelity_min"])
    curve = curve.withColumn("_back", -F.col("q_speed_mps"))
    sizes = curve.groupBy(*KEYS).agg(
        F.count("*").alias("n_speeds_used"),
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("q_speed_mps"))),
                                 lambda v: F.format_string("%.3f", v)), ",").alias("speeds_desc_mps"))
    sizes = sizes.where("n_speeds_used >= 3")
    # a handful of rows per subject, read by both searches and the rounding
    pts = cut_lineage(curve.join(sizes.select(*KEYS), KEYS, "left_semi"))
    hinge = hinge_breakpoint(pts, KEYS, "q_speed_mps", "fidelity_min", n_grid, ties=14).select(
        *KEYS, F.col("bp").alias("segmented_breakpoint_mps"), F.col("sse").alias("segmented_sse"))
    shift = single_mean_shift(pts, KEYS, ["_back"], "q_speed_mps", "fidelity_min").select(
        *KEYS, F.col("mid").alias("pelt_breakpoint_mid_mps"), F.col("low").alias("pelt_break_low_mps"),
        F.col("high").alias("pelt_break_high_mps"))
    probe = hinge.select(*KEYS, F.lit(0).alias("_id"), F.col("segmented_breakpoint_mps").alias("v"))
    near = nearest_lookup(probe, pts.select(*KEYS, F.col("q_speed_mps").alias("v")), KEYS, "_id", "v", prefer_larger=True)
    primary = floors.select("dataset", "subject", F.col("trial").cast("int").alias("trial"),
                            coerce_number("floor_speed_mps").alias("primary_floor_speed_mps"))
    out = (sizes.join(hinge, KEYS, "left").join(shift, KEYS, "left").join(primary, KEYS, "left")
           .join(near.select(*KEYS, F.col("nearest").alias("segmented_breakpoint_nearest_tested_speed_mps")), KEYS, "left"))
    floor, seg, mid = (F.col(c) for c in ("primary_floor_speed_mps", "segmented_breakpoint_mps", "pelt_breakpoint_mid_mps"))
    slow = F.least(seg, mid)
    note = F.concat_ws(
        " | ",
        F.when(slow < floor, F.format_string("crosscheck_slower_than_primary_by=%.3f", floor - slow))
        .when(slow > floor, F.format_string("crosscheck_faster_than_primary_by=%.3f", slow - floor)),
        F.when(seg.isNotNull() & mid.isNotNull(), F.format_string("seg_vs_pelt_mid_absdiff=%.3f", F.abs(seg - mid))),
        F.when(mid.isNotNull(), F.format_string("pelt_interval=[%.3f,%.3f]", F.col("pelt_break_low_mps"),
                                                F.col("pelt_break_high_mps"))))
    return out.withColumn("notes", note).orderBy(*KEYS)
