"""Reliability bounds: within-condition half splits, reference envelopes, external validation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.keys import truthy
from ..functions.signal import block_length, let
from ..operators import factorise, resample, statistics
from ..operators.joins import remaining
from ..operators.matrices import TASK_CELLS, as_columns, compare_modules, has_rows
from ..operators.segments import row_numbers
from ..session import cut_lineage
from .extraction import KEY

# Within-condition replicates, starts and seed base.
WITHIN_BOOT, WITHIN_STARTS, WITHIN_SEED = 100, 20, 20260103
# Envelope targets, coverage, reference speed key and seeds.
ENVELOPE_BOOT, ENVELOPE_CI, COVERAGE, ENVELOPE_SEED, MAX_ATTEMPT_FACTOR = 2000, 2000, 0.90, 42, 20
REFERENCE_KEY = 500
# External validation rank, replicates, starts, minimum strides, successes and seeds.
EXTERNAL_K, EXTERNAL_BOOT, EXTERNAL_STARTS, MIN_STRIDES, MIN_SUCCESS = 5, 50, 10, 20, 10
EXTERNAL_SEED, EXTERNAL_SEED_STEP, EXTERNAL_RESAMPLES, Z95 = 20260103, 1000, 200, 1.645


def _conditions(stable: DataFrame, blocks: DataFrame) -> DataFrame:
    shape = factorise.shapes(blocks, KEY)
    return stable.select(*KEY, "k").join(shape, KEY, "left")


def numbered_subjects(rows: DataFrame, order: list[str]) -> DataFrame:
    """Position of each row in subject order. The scan is cut where the sort ranges lie, whatever the names look like."""
    ranges = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return row_numbers(ranges, [], order, "_rn", chunk="_range").drop("_range")


def within_speed(stable: DataFrame, blocks: DataFrame, n_boot: int = WITHIN_BOOT, n_starts: int = WITHIN_STARTS,
                 seed: int = WITHIN_SEED, rule: kernels.Rule = kernels.WITHIN, limit: int = TASK_CELLS) -> DataFrame:
    """Mean and 10 % quantile of half-split fidelity for every stable condition.

    Conditions that cannot be split keep a row with the reason.
    """
    rows = _conditions(stable.where(truthy("pass_stability")), blocks)
    note = (F.when(F.col("m").isNull(), "MISSING_X").when(F.col("points").isNull(), "BAD_STRIDE_META")
            .when(F.col("n_strides") < 2, "TOO_FEW_STRIDES")
            .when((F.col("k") <= 0) | (F.col("k") > F.col("m")), "K_OUT_OF_RANGE").otherwise(""))
    rows = rows.withColumn("notes", note)
    ready = rows.where("notes = ''").select(*KEY, "k", "n_strides", F.lit(1).alias("block"), F.lit(seed).alias("draw_seed"))

    def seeds(row, replicate, side):
        return [seed + 100 * replicate + s for s in range(n_starts)]

    reps = resample.replicate_fits(blocks, ready, KEY, resample.DISJOINT, rule, seeds, 0, n_boot, n_starts, limit=limit)
    score = (F.col("fid_ab") + F.col("fid_ba")) / 2
    # n_boot values per condition, so the built-in percentile is small
    dist = reps.withColumn("f", score).groupBy(*KEY).agg(
        F.count("f").alias("n_boot_success"), F.avg("f").alias("within_fid_mean"),
        F.percentile("f", 0.10).alias("within_fid_q10"))
    out = rows.join(dist, KEY, "left")
    return out.select(
        "dataset", "subject", "trial", (F.col("speed_key") / 100).alias("speed_mps"), "k", "n_strides",
        F.col("points").alias("n_points"), F.lit(n_boot).alias("n_boot"),
        F.coalesce("n_boot_success", F.lit(0)).alias("n_boot_success"), "within_fid_mean", "within_fid_q10", "notes")


def quantile_bound(values: Column, q: float, side: str, draws: int, seed: Column, alpha: float = 0.05, least: int = 20) -> Column:
    """(est, bound): quantile ``q`` of an array, and the one-sided bound of its bootstrap distribution.

    Entries that are null or not finite do not count; both are null if fewer than ``least`` are left.
    """
    level = {"lower": alpha, "upper": 1 - alpha}[side]

    @F.pandas_udf(T.DoubleType())
    def limit(v: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.quantile(kernels.resampled_quantiles(np.asarray(a, dtype=float), q, draws, int(i)), level) if len(a) else None
                          for a, i in zip(v, s)], dtype=float)

    def both(v: Column) -> Column:
        place = (F.size(v) - 1) * q
        low = F.floor(place).cast("int")
        est = F.get(v, low) + (place - low) * (F.coalesce(F.get(v, low + 1), F.get(v, low)) - F.get(v, low))
        enough = F.size(v) >= least
        return F.struct(F.when(enough, est).alias("est"), F.when(enough, limit(v, seed)).alias("bound"))
    return both(F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def held_block_length(estimate: Column, n: Column) -> Column:
    """Stride block length from its estimate: at least 3, at most an eighth of ``n`` strides, and four blocks of it if ``n`` allows.

    Without an estimate it is a tenth of the strides.
    """
    def part(of: int) -> Column:
        return F.greatest(F.lit(3), F.floor(n / of).cast("int"))
    wanted = F.least(F.coalesce(F.rint(estimate).cast("int"), part(10)), part(8))
    return let(F.greatest(F.lit(3), wanted), lambda b: F.when(n >= 4 * b, b).otherwise(part(4)))


def envelope_blocks(blocks: DataFrame, chunk: int = 1000) -> DataFrame:
    """Stride block length per condition from the autocovariance of the first channel's stride means.

    The series is numbered without gaps and joined with its own lagged copies, so that one row per lag is gathered,
    however long it is.
    """
    @F.pandas_udf(T.DoubleType())
    def first_mean(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([as_columns(xi, mi)[0].mean() for xi, mi in zip(x, m)])

    @F.pandas_udf(T.DoubleType())
    def from_lags(sums: pd.Series, n: pd.Series) -> pd.Series:
        out = [kernels.optimal_block_length(np.stack(v), int(k)) for v, k in zip(sums, n)]
        return pd.Series([v if np.isfinite(v) else None for v in out], dtype=float)

    means = cut_lineage(blocks.select(*KEY, "block_id", first_mean("x", "m").alias("v")))  # one number per stride
    sizes = means.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("v").alias("_mean"))
    sized = means.join(sizes, KEY).withColumn("_chunk", F.floor(F.col("block_id") / chunk))
    placed = row_numbers(sized, KEY, ["block_id"], "at", chunk="_chunk").select(*KEY, "n", "at", (F.col("v") - F.col("_mean")).alias("e"))
    run = F.greatest(F.lit(5), F.floor(F.log10("n")).cast("int"))
    top = F.ceil(F.sqrt("n")).cast("int") + run
    earlier = placed.select(*KEY, "at", F.col("e").alias("b"), F.explode(F.sequence(F.lit(0), top)).alias("lag")).withColumn(
        "at", F.col("at") + F.col("lag"))
    lags = placed.join(earlier, [*KEY, "at"]).groupBy(*KEY, "n", "lag").agg(
        F.array(F.sum(F.col("e") * F.col("b")), F.sum(F.col("e") * F.col("e")), F.sum(F.col("b") * F.col("b"))).alias("s"))
    table = lags.groupBy(*KEY, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "s"))), lambda s: s["s"]).alias("_s"))
    return table.select(*KEY, held_block_length(from_lags("_s", "n"), F.col("n")).alias("block"))


def envelope(stable: DataFrame, blocks: DataFrame, n_boot: int = ENVELOPE_BOOT, n_ci: int = ENVELOPE_CI,
             seed: int = ENVELOPE_SEED, rule: kernels.Rule = kernels.ENVELOPE, reference_key: int = REFERENCE_KEY,
             limit: int = TASK_CELLS, per_task: int = 20) -> tuple[DataFrame, DataFrame]:
    """Bounds on four half-split metrics at the reference speed, and the replicate table.

    Attempts run in waves until each subject has ``n_boot`` successes or has used
    its attempts; the first successes by attempt number are the ones kept.
    """
    rows = _conditions(stable.where(truthy("pass_stability") & (F.col("speed_key") == reference_key)), blocks)
    blocks = blocks.where(F.col("speed_key") == reference_key)
    rows = rows.join(envelope_blocks(blocks), KEY, "left")
    indexed = numbered_subjects(rows, ["subject", "dataset", "trial"])
    rows = cut_lineage(indexed.withColumn("draw_seed", (F.lit(seed) + (F.col("_rn") - 1) * 1000).cast("bigint")).drop("_rn"))
    ready = rows.where((F.floor(F.col("n_strides") / 2) >= 2) & F.col("points").isNotNull()).select(
        *KEY, "k", "n_strides", "block", "draw_seed")

    def seeds(row, replicate, side):
        # a deterministic start: further starts repeat the first
        return [int(row.draw_seed) + 2 * (replicate + 1) + side]

    compare = compare_modules()
    waves, lo, todo = [], 0, ready
    while lo < n_boot * MAX_ATTEMPT_FACTOR:
        hi = lo + n_boot
        reps = resample.replicate_fits(blocks.join(todo.select(*KEY), KEY, "left_semi"), todo, KEY,
                                       resample.CIRCULAR, rule, seeds, lo, hi, 1, per_task, limit=limit)
        scored = reps.where(F.col("w_a").isNotNull() & F.col("w_b").isNotNull()).select(
            *KEY, "replicate", "fid_ab", "fid_ba", compare("w_a", "wave_a", "w_b", "wave_b", "m").alias("_m")).select(
            *KEY, "replicate", "fid_ab", "fid_ba", "_m.cosine_median", "_m.dtw_mean", "_m.principal_angle_max_deg")
        waves.append(cut_lineage(scored.dropna("any")))
        counts = reduce(DataFrame.unionByName, waves).groupBy(*KEY).agg(F.count("*").alias("_n"))
        full = counts.where(F.col("_n") >= n_boot)
        todo = cut_lineage(remaining(todo, full, KEY))
        lo = hi
        if not has_rows(todo):
            break
    ordered = row_numbers(reduce(DataFrame.unionByName, waves), KEY, ["replicate"], "_rn")
    kept = ordered.where(F.col("_rn") <= n_boot).drop("_rn")
    # at most 2 n_boot numbers per subject and metric
    dist = kept.groupBy(*KEY).agg(
        F.count("*").alias("N_boot_success"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "fid_ab", "fid_ba"))),
                              lambda s: F.array(s["fid_ab"], s["fid_ba"]))).alias("fid"),
        *[F.transform(F.array_sort(F.collect_list(F.struct("replicate", F.col(c).alias("v")))),
                      lambda s: s["v"]).alias(n)
          for n, c in (("cos", "cosine_median"), ("dtw", "dtw_mean"), ("ang", "principal_angle_max_deg"))])
    table = rows.join(dist, KEY, "left")
    low, high = (1 - COVERAGE, "lower"), (COVERAGE, "upper")
    for i, (n, (q, end)) in enumerate((("fid", low), ("cos", low), ("dtw", high), ("ang", high))):
        values = F.coalesce(F.col(n), F.array().cast("array<double>"))
        table = table.withColumn(f"_{n}", quantile_bound(values, q, end, n_ci, F.col("draw_seed") + 101 + i))
    got = F.coalesce(F.col("N_boot_success"), F.lit(0))
    half = F.floor(F.col("n_strides") / 2).cast("int")
    bad = reduce(lambda a, b: a | b, [F.col(f"_{n}.bound").isNull() for n in ("fid", "cos", "dtw", "ang")])
    warning = F.when(half < 2, "too_few_strides").otherwise(F.concat_ws(
        ";", F.when(got < n_boot, "bootstrap_shortfall"), F.when(bad, "invalid_bounds")))

    def spread(n: str):
        return [F.array_min(n).alias(f"{n}_min"), (F.aggregate(n, F.lit(0.0), lambda a, b: a + b) / F.size(n)
                                                   ).alias(f"{n}_mean"), F.array_max(n).alias(f"{n}_max")]

    out = table.select(
        "dataset", "subject", "trial", F.col("k").alias("k_ref"), F.col("n_strides").alias("n_strides_ref"),
        F.col("block").alias("block_length_b"), F.floor(F.col("n_strides") / (2 * F.col("block"))).alias("K_disjoint"),
        half.alias("half_n"), F.lit(n_boot).alias("N_boot_target"), got.alias("N_boot_success"),
        (2 * got).alias("n_fidelity_values"), got.alias("n_metric_values"),
        *[c for n in ("fid", "cos", "dtw", "ang") for c in spread(n)],
        F.col("_fid.est").alias("fid_q10_est"), F.col("_fid.bound").alias("L_ref_fidelity"),
        F.col("_cos.est").alias("cos_q10_est"), F.col("_cos.bound").alias("L_ref_cosine_median"),
        F.col("_dtw.est").alias("dtw_q90_est"), F.col("_dtw.bound").alias("U_ref_dtw_mean"),
        F.col("_ang.est").alias("ang_q90_est"), F.col("_ang.bound").alias("U_ref_principal_angle_max_deg"),
        F.col("_fid.bound").alias("L_ref"), warning.alias("warning_flag"))
    return out, kept


def external(trials: DataFrame, blocks: DataFrame, done: DataFrame | None = None, n_boot: int = EXTERNAL_BOOT,
             n_starts: int = EXTERNAL_STARTS, k: int = EXTERNAL_K, rule: kernels.Rule = kernels.EXTERNAL,
             limit: int = TASK_CELLS) -> tuple[DataFrame, DataFrame]:
    """Fixed-rank reliability of independent trials: results, and subjects that failed with a reason.

    ``trials`` holds one row per condition; the first trial of a subject is used.
    ``done`` lists subjects already finished.
    """
    from ..operators.selection import first_values
    first = first_values(trials.select(*KEY), ["dataset", "subject"], ["trial", "speed_key"])
    # the index feeds the seed, so it is taken before finished subjects are left out
    indexed = numbered_subjects(first, ["subject", "dataset"]).withColumn(
        "draw_seed", (F.lit(EXTERNAL_SEED) + EXTERNAL_SEED_STEP * (F.col("_rn") - 1)).cast("bigint")).drop("_rn")
    todo = remaining(indexed, done, ["subject"]) if done is not None else indexed
    rows = todo.join(factorise.shapes(blocks, KEY), KEY, "left").withColumn("k", F.lit(k))
    why = F.when(F.col("m").isNull(), "file_not_found").when(F.col("n_strides") < MIN_STRIDES, "insufficient_strides")
    rows = cut_lineage(rows.withColumn("reason", why))
    ready = rows.where("reason IS NULL").select(
        *KEY, "k", "n_strides", block_length("n_strides").alias("block"), "draw_seed")

    def seeds(row, replicate, side):
        return [int(row.draw_seed) + s for s in range(n_starts)]  # one schedule for every replicate and side

    reps = resample.replicate_fits(blocks, ready, KEY, resample.BLOCKED_HALF, rule, seeds, 0, n_boot, n_starts, limit=limit)
    good = reps.where("fid_ab IS NOT NULL AND fid_ba IS NOT NULL")
    ab = good.groupBy(*KEY).agg(
        F.count("*").alias("n_boot_success"),
        F.sort_array(F.collect_list(F.struct("replicate", "fid_ab", "fid_ba"))).alias("_r"))
    values = F.concat(F.transform("_r", lambda s: s["fid_ab"]), F.transform("_r", lambda s: s["fid_ba"]))

    @F.pandas_udf(T.DoubleType())
    def spread_of_q10(v: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for vals, s in zip(v, seed):
            rng, a = np.random.RandomState(int(s)), np.asarray(vals, dtype=float)
            out.append(np.std([np.percentile(rng.choice(a, size=len(a)), 10) for _ in range(EXTERNAL_RESAMPLES)]))
        return pd.Series(out, dtype=float)

    dist = ab.where(F.col("n_boot_success") >= MIN_SUCCESS).withColumn("_v", values).drop("_r")
    flat = dist.select(*KEY, F.explode("_v").alias("v")).groupBy(*KEY).agg(
        F.avg("v").alias("fid_mean"), F.stddev_pop("v").alias("fid_std"), F.min("v").alias("fid_min"),
        F.max("v").alias("fid_max"), F.percentile("v", 0.10).alias("fid_q10"), F.percentile("v", 0.50).alias("fid_q50"))
    table = dist.join(ready.select(*KEY, "draw_seed", "n_strides", "block"), KEY).join(flat, KEY).withColumn(
        "_se", spread_of_q10("_v", "draw_seed"))
    results = table.join(rows.select(*KEY, F.col("m").alias("n_muscles")), KEY).select(
        "subject", "dataset", (F.col("speed_key") / 100).alias("speed_mps"), "n_muscles", "n_strides", "n_boot_success",
        F.col("block").alias("block_length_b"), F.floor(F.col("n_strides") / 2).cast("int").alias("half_n"),
        "fid_mean", "fid_std", "fid_min", "fid_max", "fid_q10", "fid_q50",
        (F.col("fid_q10") - Z95 * F.col("_se")).alias("L_ref_fidelity"))
    failed = rows.where("reason IS NOT NULL").select("subject", "reason").unionByName(
        remaining(ready.select("subject"), results.select("subject"), ["subject"]).select(
            "subject", F.lit("reliability_computation_failed").alias("reason")))
    return results, failed


def compare_datasets(results: DataFrame, bounds: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Bound summary per dataset, and the two-sample test of their difference."""
    both = results.select(F.lit(first).alias("dataset"), "L_ref_fidelity").unionByName(
        bounds.select(F.lit(second).alias("dataset"), "L_ref_fidelity"))
    summary = both.groupBy("dataset").agg(
        F.count("*").alias("n_subjects"), F.avg("L_ref_fidelity").alias("L_ref_mean"),
        F.stddev_samp("L_ref_fidelity").alias("L_ref_sd"), F.min("L_ref_fidelity").alias("L_ref_min"),
        F.max("L_ref_fidelity").alias("L_ref_max"))
    return summary, statistics.independent_t(both, "dataset", first, second, "L_ref_fidelity")
