"""Replicated fits on resampled strides.

``replicate_fits`` answers, for every condition and replicate: draw strides, fit
each side, and measure how well each side's factors reconstruct the other. The
draws are one table, built in parallel from hashes of (seed, replicate, side,
position), whatever the size of a condition. A replicate is a weight per stride on
one copy of the data: statistics are multiplied by how often a stride was drawn, and
copies of a stride start alike, so nothing is repeated. Where a condition fits a task,
the task makes the same draws as arrays (a few replicates per task); a larger one is
fitted block-wise, all replicates and starts in one run, from a table of them. Blocks are numbered from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.kernels import Rule
from ..functions.signal import let
from ..session import cut_lineage
from .factorise import DOUBLES, NONFINITE, fit_large
from .matrices import (TASK_CELLS, as_columns, block_errors, gather, has_rows, map_rows, ratio_to_fidelity, spread_fits,
                       strides)
from .segments import row_numbers

REPLICATE_FIELDS = [
    ("replicate", T.IntegerType()), ("w_a", DOUBLES), ("wave_a", DOUBLES), ("w_b", DOUBLES), ("wave_b", DOUBLES),
    ("fid_ab", T.DoubleType()), ("fid_ba", T.DoubleType()), ("fail_reason", T.StringType())]


@dataclass(frozen=True)
class Scheme:
    """How strides are drawn: the drawing rule, and whether there is a second side."""

    name: str
    two_sides: bool = True


MOVING = Scheme("moving", two_sides=False)
CIRCULAR = Scheme("circular")
BLOCKED_HALF = Scheme("blocked_half")
DISJOINT = Scheme("disjoint")


def text_seed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8"))


def _small(tasks: DataFrame, keys: Sequence[str], scheme: Scheme, rule: Rule,
           fit_seeds: Callable, normalise: bool, rows: int) -> DataFrame:
    ids = [*keys, "m", "k"]

    def run(row):
        head = tuple(getattr(row, n) for n in ids)
        X3 = strides(as_columns(row.x, row.m), row.n_blocks)
        n_sides = 2 if scheme.two_sides else 1
        for r in range(row.lo, row.lo + len(row.at) // n_sides):
            first = (r - row.lo) * n_sides
            sides = [np.asarray(at, int) for at in row.at[first:first + n_sides]]
            try:
                if not np.isfinite(X3).all():
                    raise ValueError(NONFINITE)
                counted = [np.unique(idx, return_counts=True) for idx in sides]
                parts = [X3[:, at].reshape(X3.shape[0], -1) for at, _ in counted]
                weights = [np.repeat(n, X3.shape[2]).astype(float) for _, n in counted]
                out = []
                for side, (X, (at, n), weight) in enumerate(zip(parts, counted, weights, strict=True)):
                    # draws without repeats count once
                    times = weight if (n > 1).any() else None
                    W, H, *_ = kernels.best_fit(rule, X, int(row.k), fit_seeds(row, r, side), at, [X3.shape[2]] * len(at), times)
                    if normalise:
                        W, H = kernels.unit_sum(W, H, rule.eps)
                    wave = (H.reshape(H.shape[0], len(at), -1) * n[:, None]).sum(axis=1) / n.sum()
                    out += [W.ravel(), wave.ravel()]
                if scheme.two_sides:
                    k = int(row.k)
                    fids = [kernels.fidelity(out[0].reshape(-1, k), parts[1], weights[1]),
                            kernels.fidelity(out[2].reshape(-1, k), parts[0], weights[0])]
                    fids = [f if np.isfinite(f) else None for f in fids]
                else:
                    out, fids = [*out, None, None], [None, None]
                yield (*head, r, *out, *fids, None)
            except (ValueError, np.linalg.LinAlgError) as e:
                yield (*head, r, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])

    schema = T.StructType([tasks.schema[n] for n in ids] + [T.StructField(n, t) for n, t in REPLICATE_FIELDS])
    # each task makes its own draws: they are not shuffled
    dealt = spread_fits(tasks, rows, *keys, "k", "lo")
    return map_rows(dealt.withColumn("at", drawn_arrays(scheme, F.col("lo"), F.col("last"))).drop("last"), schema, run)


def _uniform(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _lengths(scheme: Scheme) -> tuple[Column, Column, Column]:
    """Strides of a side, strides that are drawn together, and how many strides a draw can start at."""
    n, b = F.col("n_strides"), F.col("block")
    size = n if scheme == MOVING else F.floor(n / 2).cast("int")
    step = F.when((b <= 1) | (b >= n), 1).otherwise(b) if scheme == MOVING else b
    return size, step, n if scheme == CIRCULAR else n - step + 1


def drawn_arrays(scheme: Scheme, lo: Column, last: Column) -> Column:
    """The draws of ``drawn_positions`` as arrays of strides by position, one for each replicate from ``lo`` to ``last`` and side.

    A row needs nothing but its own n_strides, block and draw_seed, so its draws are made where it is.
    """
    n, seed = F.col("n_strides"), F.col("draw_seed")
    size, step, limit = _lengths(scheme)

    def shuffled(replicate: Column) -> Column:
        placed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.xxhash64(seed, replicate, i).alias("u"), i.cast("bigint").alias("i")))
        return let(F.transform(F.sort_array(placed), lambda s: s["i"]), lambda order: F.array(
            F.slice(order, F.lit(1), size), F.slice(order, size + 1, size)))

    def runs(replicate: Column, side: int) -> Column:
        count = F.ceil(size / step).cast("int")
        starts = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.floor(_uniform(seed, replicate, F.lit(side), j) * limit))
        offsets = F.sequence(F.lit(0), step - 1)
        return F.slice(F.flatten(F.transform(starts, lambda s: F.transform(
            offsets, lambda o: F.pmod(s + o, n).cast("bigint")))), F.lit(1), size)

    def sides(replicate: Column) -> Column:
        return shuffled(replicate) if scheme == DISJOINT else F.array(*[runs(replicate, s) for s in range(2 if scheme.two_sides else 1)])
    return F.flatten(F.transform(F.sequence(lo, last), sides))


def drawn_positions(conditions: DataFrame, keys: Sequence[str], scheme: Scheme, lo: int, hi: int) -> DataFrame:
    """Drawn strides of large conditions as rows (keys, replicate, side, position, block_id).

    ``conditions`` has keys, n_strides, block and draw_seed. Every draw is a hash
    of its coordinates, so the table is built in parallel and is the same on a rerun.
    """
    last_side = 1 if scheme.two_sides else 0
    base = (conditions.withColumn("replicate", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
            .withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(last_side)))))
    n, b = F.col("n_strides"), F.col("block")
    half = F.floor(n / 2).cast("int")
    if scheme == DISJOINT:
        rows = base.where("side = 0").select(
            *keys, "replicate", "draw_seed", half.alias("_half"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_id"))
        rows = rows.withColumn("_u", F.xxhash64("draw_seed", "replicate", "block_id")).withColumn(
            "_chunk", F.shiftright("_u", 54))
        ranked = row_numbers(rows, [*keys, "replicate"], ["_u", "block_id"], "_rn", chunk="_chunk")
        at = F.col("_rn") - 1
        return ranked.where(at < 2 * F.col("_half")).select(
            *keys, "replicate", F.when(at < F.col("_half"), 0).otherwise(1).alias("side"),
            (at % F.col("_half")).alias("position"), F.col("block_id").cast("bigint"))
    size, step, limit = _lengths(scheme)
    rows = base.withColumn("_size", size).withColumn("_step", step).withColumn("_limit", limit)
    count = F.ceil(F.col("_size") / F.col("_step")).cast("int")
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.floor(_uniform(F.col("draw_seed"), F.col("replicate"), F.col("side"), F.col("_j")) * F.col("_limit"))
    rows = rows.withColumn("_start", start).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_step") - 1)))
    return rows.withColumn("position", F.col("_j") * F.col("_step") + F.col("_o")).where(
        F.col("position") < F.col("_size")).select(
        *keys, "replicate", "side", F.col("position").cast("bigint"),
        F.pmod(F.col("_start") + F.col("_o"), n).cast("bigint").alias("block_id"))


def _seeds(fit_seeds: Callable):
    """The start seeds of a replicate and side, from the row of its condition."""
    @F.pandas_udf("array<bigint>")
    def run(row: pd.DataFrame, replicate: pd.Series, side: pd.Series) -> pd.Series:
        return pd.Series([[int(s) for s in fit_seeds(c, int(r), int(d))]
                          for c, r, d in zip(row.itertuples(index=False), replicate, side)])
    return run


def _large(blocks: DataFrame, conditions: DataFrame, keys: Sequence[str], scheme: Scheme, rule: Rule, fit_seeds: Callable,
           lo: int, hi: int, normalise: bool) -> DataFrame:
    run_keys = [*keys, "replicate", "side"]
    at = drawn_positions(conditions, keys, scheme, lo, hi)
    draws = cut_lineage(at.groupBy(*run_keys, "block_id").agg(F.count("*").alias("weight")))  # a number for each drawn stride
    wanted = draws.select(*run_keys).distinct().join(
        conditions.select(*keys, "k", F.struct(*conditions.columns).alias("_row")), list(keys))
    wanted = cut_lineage(wanted.withColumn("seeds", _seeds(fit_seeds)("_row", "replicate", "side")).drop("_row"))
    fits = cut_lineage(fit_large(blocks, wanted, keys, rule, normalise, draws, run_keys))
    side = {s: fits.where(F.col("side") == i).select(
        *keys, "replicate", "m", "k", F.col("w").alias(f"w_{s}"), F.col("wave").alias(f"wave_{s}"))
        for i, s in enumerate("ab")}
    # one reason for both sides: a failed side fails its replicate
    why = fits.groupBy(*keys, "replicate").agg(F.min_by("fail_reason", F.when(F.col("fail_reason").isNotNull(), F.col("side"))).alias("fail_reason"))
    none = [F.lit(None).cast(t).alias(n) for n, t in REPLICATE_FIELDS if n in ("fid_ab", "fid_ba")]
    if not scheme.two_sides:
        empty = [F.lit(None).cast(DOUBLES).alias(n) for n in ("w_b", "wave_b")]
        return side["a"].join(why, [*keys, "replicate"]).select(
            *keys, "m", "k", "replicate", "w_a", "wave_a", *empty, *none, "fail_reason")
    # each side's factors are projected on the other side's strides
    other = fits.where("fail_reason IS NULL").select(*keys, "replicate", (1 - F.col("side")).alias("side"), "w")
    met = blocks.select(*keys, "block_id", "m", "x").join(draws.join(other, run_keys), [*keys, "block_id"])
    errors = block_errors(met).groupBy(*keys, "replicate").agg(
        *[F.sum(F.when(F.col("side") == s, F.col(c) * F.col("weight"))).alias(f"{c}{s}") for s in (0, 1) for c in ("sse", "sst")])
    both = side["a"].join(side["b"].drop("m", "k"), [*keys, "replicate"]).join(errors, [*keys, "replicate"], "left")
    both = both.join(why, [*keys, "replicate"])
    ok = F.col("fail_reason").isNull()
    return both.select(
        *keys, "m", "k", "replicate", *[F.when(ok, F.col(c)).alias(c) for c in ("w_a", "wave_a", "w_b", "wave_b")],
        F.when(ok, ratio_to_fidelity(F.col("sse1"), F.col("sst1"))).alias("fid_ab"),
        F.when(ok, ratio_to_fidelity(F.col("sse0"), F.col("sst0"))).alias("fid_ba"), "fail_reason")


def replicate_fits(blocks: DataFrame, conditions: DataFrame, keys: Sequence[str], scheme: Scheme, rule: Rule,
                   fit_seeds: Callable, lo: int, hi: int, n_starts: int, per_task: int = 5,
                   normalise: bool = False, limit: int = TASK_CELLS) -> DataFrame:
    """Fits of replicates ``lo`` to ``hi - 1`` for every condition.

    ``conditions`` carries keys, k, n_strides, block (stride block length),
    draw_seed, and whatever ``fit_seeds(row, replicate, side)`` reads.
    """
    conditions = cut_lineage(conditions)  # one short row per condition
    small, large = gather(blocks, keys, limit)
    parts = conditions.withColumn("lo", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1), F.lit(per_task)))).withColumn(
        "last", F.least(F.col("lo") + per_task, F.lit(hi)) - 1)
    tasks = small.join(parts, list(keys))
    out = _small(tasks, keys, scheme, rule, fit_seeds, normalise, conditions.count() * -(-(hi - lo) // per_task))
    if has_rows(large):
        todo = conditions.join(large.select(*keys).distinct(), list(keys), "left_semi")
        out = out.unionByName(_large(large, todo, keys, scheme, rule, fit_seeds, lo, hi, normalise))
    return out
