"""Data matrices as rows of column blocks, and what can be computed block by block.

A condition's matrix (channels x time) is a set of rows
``(keys..., block_id, m, x)``: one row per stride, ``x`` holding the block point
by point (the ``m`` channel values of each), so blocks concatenate. Everything here is row-parallel over blocks; per-condition
results are map-side combined sums of per-block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels

# Largest condition, in matrix cells, that is handed to one task as a whole (64 MiB of doubles).
TASK_CELLS = 1 << 23
# Cells worked on at once inside a Python batch.
BATCH_CELLS = 1 << 20
# Cells of surrogates made at once: a pass over them stays in a core's cache.
SURROGATE_CELLS = 1 << 15
# So many times as many are drawn at once: their generators are arrays, whose steps cost little from thousands on.
DRAWS_AT_ONCE = 4
# Tasks per core for work that takes long by the row.
TASKS_A_CORE = 8
# The most where a row is a whole fit: a task costs some 75 ms in Python even if it has no row.
FITS_A_CORE = 32


def as_matrix(values, rows: int) -> np.ndarray:
    """A stored factor or activation array with the given number of rows."""
    return np.asarray(values, dtype=float).reshape(int(rows), -1)


def as_columns(values, m: int) -> np.ndarray:
    """A block's data as (channels, points)."""
    return np.ascontiguousarray(np.asarray(values, dtype=float).reshape(-1, int(m)).T)


def cells(blocks: DataFrame) -> Column:
    """Block size. A stored ``cells`` column spares reading the data just to measure it."""
    return F.col("cells") if "cells" in blocks.columns else F.size("x").cast("bigint")


def pack_profiles(profiles: DataFrame, keys: Sequence[str], block: str = "stride_idx",
                  channel: str = "muscle_idx", values: str = "values") -> DataFrame:
    """One row per stride from one row per (stride, channel)."""
    item = F.struct(F.col(channel).alias("c"), F.col(values).cast("array<double>").alias("v"))
    stride = (profiles.groupBy(*keys, F.col(block).cast("bigint").alias("block_id"))
              .agg(F.array_sort(F.collect_list(item)).alias("_c")))
    points = F.sequence(F.lit(0), F.size(F.get("_c", F.lit(0))["v"]) - 1)
    size = F.size("_c").cast("bigint") * F.size(F.get("_c", F.lit(0))["v"])
    return stride.select(*keys, "block_id", F.size("_c").alias("m"), size.alias("cells"), F.flatten(F.transform(
        points, lambda t: F.transform("_c", lambda s: F.get(s["v"], t)))).alias("x"))


def pack_columns(rows: DataFrame, keys: Sequence[str], column_id: str, values: str, m: int,
                 per_block: int = 256) -> DataFrame:
    """Blocks of at most ``per_block`` consecutive ids from one row per matrix column."""
    item = F.struct(F.col(column_id).alias("c"), F.col(values).cast("array<double>").alias("v"))
    block = F.floor(F.col(column_id) / per_block).cast("bigint")
    return (rows.groupBy(*keys, block.alias("block_id")).agg(F.array_sort(F.collect_list(item)).alias("_c"))
            .select(*keys, "block_id", F.lit(m).alias("m"),
                    F.flatten(F.transform("_c", lambda s: s["v"])).alias("x")))


def nonnegative_blocks(blocks: DataFrame) -> DataFrame:
    """Clip a block's entries at zero."""
    return blocks.withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))))


def vector_sum(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Element-wise sum of an array column per key, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    total = Summarizer.sum(array_to_vector(column))
    return df.groupBy(*keys).agg(vector_to_array(total).alias(name))


@F.pandas_udf(T.StructType([T.StructField("sse", T.DoubleType()), T.StructField("sst", T.DoubleType())]))
def _project(x: pd.Series, m: pd.Series, w: pd.Series) -> pd.DataFrame:
    out = np.full((len(x), 2), np.nan)
    # rows sharing factors are solved as one wide system
    groups: dict[bytes, list[int]] = {}
    factors = [np.asarray(f, dtype=float) if f is not None else None for f in w]
    for i, f in enumerate(factors):
        if f is not None:
            groups.setdefault(f.tobytes(), []).append(i)
    for members in groups.values():
        W = as_matrix(factors[members[0]], m.iloc[members[0]])
        size = max(1, BATCH_CELLS // len(x.iloc[members[0]]))
        for rows in (members[a:a + size] for a in range(0, len(members), size)):
            mats = [as_columns(x.iloc[i], m.iloc[i]) for i in rows]
            X = np.hstack(mats)
            err = np.square(X - W @ kernels.nnls(W, X)).sum(axis=0)
            tot = np.square(X).sum(axis=0)
            edges = np.cumsum([0, *[a.shape[1] for a in mats]])[:-1]
            out[rows, 0], out[rows, 1] = np.add.reduceat(err, edges), np.add.reduceat(tot, edges)
    return pd.DataFrame(out, columns=["sse", "sst"])


def block_errors(blocks: DataFrame) -> DataFrame:
    """Add per-block squared error and total of ``x`` explained through the row's factors ``w``."""
    return blocks.withColumn("_e", _project("x", "m", "w")).select("*", "_e.sse", "_e.sst").drop("_e")


def ratio_to_fidelity(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST, NULL where there is nothing to explain."""
    return F.when(sst > 0, 1.0 - sse / sst)


def cross_fidelity(pairs: DataFrame, factors: DataFrame, blocks: DataFrame, keys: Sequence[str],
                   source: str, target: str) -> DataFrame:
    """How well each pair's source factors reconstruct the target's data.

    ``pairs`` has key columns plus the condition names ``source`` and ``target``;
    factors and blocks are keyed by (keys, ``speed_key``). Factors are k numbers
    per channel, so they travel to the blocks and never the other way round.
    """
    f = factors.select(*keys, F.col("speed_key").alias(source), "w")
    sided = pairs.join(f, [*keys, source])
    b = blocks.select(*keys, F.col("speed_key").alias(target), "m", "x")
    errors = block_errors(b.join(sided, [*keys, target]))
    extra = [c for c in pairs.columns if c not in keys]
    sums = errors.groupBy(*keys, *extra).agg(F.sum("sse").alias("sse"), F.sum("sst").alias("sst"))
    return sums.select(*keys, *extra, ratio_to_fidelity(F.col("sse"), F.col("sst")).alias("fidelity"))


def gather(blocks: DataFrame, keys: Sequence[str], limit: int = TASK_CELLS) -> tuple[DataFrame, DataFrame]:
    """Split conditions by size: small ones as one row per matrix, large ones as they were.

    Only conditions whose cell count is known to fit one task are collected into
    a row; the second table keeps the blocks of all others. ``points`` is the
    common block length, NULL when blocks differ.
    """
    sizes = blocks.groupBy(*keys).agg(F.sum(cells(blocks)).alias("_cells"))
    tagged = blocks.join(sizes, list(keys))
    item = F.struct("block_id", "x")
    points = F.size("x") / F.col("m")
    small = (tagged.where(F.col("_cells") <= limit).groupBy(*keys)
             .agg(F.first("m").alias("m"), F.min(points).alias("_lo"), F.max(points).alias("_hi"),
                  F.array_sort(F.collect_list(item)).alias("_b"))
             .select(*keys, "m", F.size("_b").alias("n_blocks"),
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).cast("int").alias("points"),
                     F.transform("_b", lambda s: s["block_id"].cast("bigint")).alias("ids"),
                     F.transform("_b", lambda s: (F.size(s["x"]) / F.col("m")).cast("int")).alias("widths"),
                     F.flatten(F.transform("_b", lambda s: s["x"])).alias("x")))
    large = tagged.where(F.col("_cells") > limit).drop("_cells")
    return small, large


def strides(X: np.ndarray, n_blocks: int) -> np.ndarray:
    """A matrix of equal blocks as (channels, blocks, points)."""
    return X.reshape(X.shape[0], int(n_blocks), -1)


def spread(df: DataFrame, *names: str) -> DataFrame:
    """Rows dealt out by ``names`` to several tasks a core, which adaptive execution does not put together again.

    For rows that are small but take long: sizes in bytes say nothing about them.
    """
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, *[F.col(n) for n in names])


def spread_fits(df: DataFrame, rows: int, *names: str) -> DataFrame:
    """About ``rows`` rows of a whole fit each, dealt out evenly by ``names``, which tell them apart: a task each, if they are few.

    Ranges of a hash hold as many rows each; the hash itself would leave every third task empty and put three rows in another.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(FITS_A_CORE * cores, max(TASKS_A_CORE * cores, rows))
    return df.repartitionByRange(tasks, F.xxhash64(*[F.col(n) for n in names]), *[F.col(n) for n in names])


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


# ------------------------------------------------------------------ surrogates


def surrogate_fidelity(pairs: DataFrame, factors: DataFrame, blocks: DataFrame, keys: Sequence[str],
                       source: str, target: str, n_surrogates: int, seed: int,
                       n_iter: int = 20) -> DataFrame:
    """Fidelity of each pair on phase-randomised copies of the target: one row per surrogate.

    A stride's surrogates depend on that stride alone, so every block row makes
    its own copies, seeded by (seed + surrogate, stride), and returns only their
    squared errors. The data is shuffled once whatever the number of surrogates, and
    dealt out by stride, so that a condition is not one task.
    """
    f = factors.select(*keys, F.col("speed_key").alias(source), "w")
    b = blocks.select(*keys, F.col("speed_key").alias(target), "block_id", "m", "x")
    rows = spread(b.join(pairs.join(f, [*keys, source]), [*keys, target]), *keys, target, "block_id")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def copies(x: pd.Series, m: pd.Series, w: pd.Series, block: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        # strides of one shape sharing factors are randomised and projected together
        alike: dict[tuple, list[int]] = {}
        for i, (xi, mi, wi) in enumerate(zip(x, m, w)):
            alike.setdefault((len(xi), int(mi), np.asarray(wi).tobytes()), []).append(i)
        for (cells, mi, _), members in alike.items():
            W = as_matrix(w.iloc[members[0]], mi)
            size = max(1, SURROGATE_CELLS // cells)
            for part in (members[i:i + size] for i in range(0, len(members), size)):
                X = np.stack([as_columns(x.iloc[i], mi) for i in part])
                ids = [int(block.iloc[i]) for i in part]
                # surrogates only reorder values, so they all share the stride's total
                errors = [np.square(X).sum(axis=(1, 2))[None]]
                # few strides: several surrogates of all of them at once
                at_once = max(1, size // len(part))
                for lo in range(0, n_surrogates, at_once * DRAWS_AT_ONCE):
                    numbers = np.arange(lo, min(lo + at_once * DRAWS_AT_ONCE, n_surrogates))
                    copied = np.broadcast_to(X, (len(numbers), *X.shape)).reshape(-1, *X.shape[1:])
                    start = kernels.permuted(copied, np.repeat(seed + numbers, len(ids)), np.tile(ids, len(numbers)))
                    start = start.reshape(len(numbers), *X.shape)
                    for a in range(0, len(numbers), at_once):
                        S = kernels.phase_surrogates(X, start[a:a + at_once], n_iter)
                        flat = S.transpose(2, 0, 1, 3).reshape(mi, -1)
                        rest = np.square(flat - W @ kernels.nnls(W, flat)).sum(axis=0)
                        errors.append(rest.reshape(len(S), len(part), -1).sum(axis=2))
                for i, e in zip(part, np.concatenate(errors).T):
                    out[i] = e
        return pd.Series(out)

    extra = [c for c in pairs.columns if c not in keys]
    summed = vector_sum(rows.select(*keys, *extra, copies("x", "m", "w", "block_id").alias("_e")),
                        [*keys, *extra], "_e", "_s")
    fid = F.transform(F.slice("_s", 2, n_surrogates), lambda e: ratio_to_fidelity(e, F.get("_s", F.lit(0))))
    return summed.select(*keys, *extra, F.posexplode(fid).alias("surrogate", "fidelity"))


# --------------------------------------------------------------------- pairing


PAIR_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in (
    "cosine_median", "cosine_min", "cosine_mean", "principal_angle_max_deg", "principal_angle_mean_deg",
    "dtw_mean", "dtw_max")])


def pair_metrics(A: np.ndarray, B: np.ndarray, wave_a: np.ndarray, wave_b: np.ndarray,
                 method: str = "cosine") -> tuple[float, ...]:
    """Matched-module similarity, subspace angles and waveform distance of two factorisations."""
    rows, cols, cos = kernels.match(A, B, method)
    angles = kernels.principal_angles(A, B)
    warp = kernels.dtw(wave_a[rows], wave_b[cols])
    return (float(np.median(cos)), float(cos.min()), float(cos.mean()), float(angles.max()),
            float(angles.mean()), float(warp.mean()), float(warp.max()))


def compare_modules(method: str = "cosine"):
    """Column function (w_a, wave_a, w_b, wave_b, m) -> metric struct."""

    @F.pandas_udf(PAIR_SCHEMA)
    def run(w_a: pd.Series, wave_a: pd.Series, w_b: pd.Series, wave_b: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for wa, va, wb, vb, mi in zip(w_a, wave_a, w_b, wave_b, m):
            A, B = as_matrix(wa, mi), as_matrix(wb, mi)
            out.append(pair_metrics(A, B, as_matrix(va, A.shape[1]), as_matrix(vb, B.shape[1]), method))
        return pd.DataFrame(out, columns=[f.name for f in PAIR_SCHEMA.fields])

    return run


@F.pandas_udf(T.DoubleType())
def dtw_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unconstrained warping cost of two equally typed sequences, pairs of equal shape together."""
    out = np.full(len(a), np.nan)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (p, q) in enumerate(zip(a, b)):
        if p is not None and q is not None:
            shapes.setdefault((len(p), len(q)), []).append(i)
    for rows in shapes.values():
        out[rows] = kernels.dtw(np.stack([a.iloc[i] for i in rows]).astype(float),
                                np.stack([b.iloc[i] for i in rows]).astype(float))
    return pd.Series(out)


def map_rows(df: DataFrame, schema: T.StructType | str, fn) -> DataFrame:
    """Apply ``fn(row) -> iterable of tuples`` to each row of a table of per-task rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = parsed.fieldNames()
        for pdf in batches:
            rows = [r for row in pdf.itertuples(index=False) for r in fn(row)]
            yield pd.DataFrame(rows, columns=names)
    parsed = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return df.mapInPandas(run, parsed)
