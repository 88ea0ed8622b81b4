"""Nonnegative factorisation of many conditions, small and large.

A condition known to fit one task is fitted there, all its data in one row. A
larger one stays in its blocks: activations belong to a block, the factor update
needs only sums over blocks, so an iteration is one row-parallel step plus one
map-side combined aggregate, for all starts of all tasks at once. Both ways run
the same update functions over stacks of starts or blocks, from the same starts
(drawn by seed and block) with the same stopping tests and failure rows: the
size of a condition decides where its fit runs, not what it gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.kernels import Rule
from ..functions.signal import let
from ..session import cut_lineage, ensure_checkpoint_dir
from .matrices import TASK_CELLS, as_columns, as_matrix, cells, gather, has_rows, map_rows, spread_fits, vector_sum
from .selection import top_row

DOUBLES = T.ArrayType(T.DoubleType())
FIT_FIELDS = [
    ("w", DOUBLES), ("wave", DOUBLES), ("seed", T.LongType()), ("iters", T.IntegerType()),
    ("converged", T.BooleanType()), ("sse", T.DoubleType()), ("channel_sse", DOUBLES),
    ("channel_sst", DOUBLES), ("fail_reason", T.StringType())]
CHECKPOINT_EVERY = 10
# cells of data that a stack of blocks holds
STACK_CELLS = 1 << 18
# starts of a fit that one task runs, if their activations are not too many
STARTS_A_TASK = 5
NONFINITE, NO_FINITE_FIT = "nonfinite entries", "no start converged to finite factors"


def _schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    kept = [df.schema[n] for n in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in FIT_FIELDS])


def fit_small(tasks: DataFrame, keys: Sequence[str], rule: Rule, normalise: bool, rows: int) -> DataFrame:
    """Fit rows ``(keys, m, n_blocks, points, ids, widths, x, k, seeds)``; a failed fit keeps its row and its reason.

    ``rows`` says about how many fits there are, counting ``STARTS_A_TASK`` starts as one. The starts of a fit are dealt to tasks, a few to each: as many as have bounded activations. The best one is kept.
    """
    ids = [*keys, "m", "k", "part"]
    if rule.name == "svd_start":
        tasks = tasks.withColumn("seeds", F.slice("seeds", 1, 1))
    fitting = F.floor(TASK_CELLS / (F.col("k") * F.size("x") / F.col("m") + 1)).cast("int")
    tasks = tasks.withColumn("_few", F.greatest(F.lit(1), F.least(F.lit(STARTS_A_TASK), fitting)))
    parts = F.sequence(F.lit(0), F.ceil(F.size("seeds") / F.col("_few")).cast("int") - 1)
    tasks = tasks.withColumn("part", F.explode(parts)).withColumn(
        "seeds", F.slice("seeds", F.col("part") * F.col("_few") + 1, F.col("_few"))).drop("_few")

    def run(row):
        head = tuple(getattr(row, n) for n in ids)
        try:
            X = as_columns(row.x, row.m)
            if not np.isfinite(X).all():
                raise ValueError(NONFINITE)
            W, H, sse, iters, done, seed = kernels.best_fit(rule, X, int(row.k), row.seeds, row.ids, row.widths)
            if normalise:
                W, H = kernels.unit_sum(W, H, rule.eps)
            rest = np.square(X - W @ H).sum(axis=1)
            wave = None
            if row.points == row.points and row.points is not None:
                wave = H.reshape(H.shape[0], int(row.n_blocks), -1).mean(axis=1).ravel()
            yield (*head, W.ravel(), wave, seed, iters, done, sse, rest,
                   np.square(X).sum(axis=1), None)
        except (ValueError, np.linalg.LinAlgError) as e:
            yield (*head, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])

    fits = map_rows(spread_fits(tasks, rows, *keys, "k", "part"), _schema(tasks, ids), run)
    best = top_row(fits, [*keys, "m", "k"], [F.col("fail_reason").isNotNull(), F.col("sse"), F.col("part")], lowest=True)
    return best.drop("part")


def _stacks(*columns: pd.Series) -> list[np.ndarray]:
    """Row numbers of a batch by equal shape, in parts of bounded size: rows of one part are worked on as a stack.

    Row ``i`` belongs to the shape of ``(len(columns[0][i]), columns[1][i], ...)``.
    """
    shapes_: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(*columns)):
        shapes_.setdefault((len(row[0]), *[int(v) for v in row[1:]]), []).append(i)
    out = []
    for shape, rows in shapes_.items():
        size = max(1, STACK_CELLS // max(1, shape[0]))
        out += [np.array(rows[i:i + size]) for i in range(0, len(rows), size)]
    return out


def _stacked(values: pd.Series, rows: np.ndarray, lines: int, columns: bool = False) -> np.ndarray:
    """Arrays of ``rows`` as a stack of matrices with ``lines`` lines; data blocks are stored column by column."""
    flat = np.stack([np.asarray(values.iloc[i], dtype=float) for i in rows])
    if columns:
        return np.ascontiguousarray(np.swapaxes(flat.reshape(len(rows), -1, lines), 1, 2))
    return flat.reshape(len(rows), lines, -1)


def _weights(weight: pd.Series, rows: np.ndarray, n: int) -> np.ndarray:
    """How often the columns of each stacked block count."""
    return np.repeat(weight.to_numpy(dtype=float)[rows][:, None], n, axis=1)


def _step(rule: Rule):
    """Row step: new activations and the block's statistics (unchanged once a task is done)."""
    fields = T.StructType([T.StructField("h", DOUBLES), T.StructField("stats", DOUBLES)])

    @F.pandas_udf(fields)
    def run(x: pd.Series, h: pd.Series, w: pd.Series, m: pd.Series, k: pd.Series, weight: pd.Series,
            done: pd.Series) -> pd.DataFrame:
        hs, stats = [None] * len(x), [None] * len(x)
        for rows in _stacks(x, m, k, done):
            mi, ki = int(m.iloc[rows[0]]), int(k.iloc[rows[0]])
            X, H, W = _stacked(x, rows, mi, True), _stacked(h, rows, ki), _stacked(w, rows, mi)
            violation, count = 0.0, _weights(weight, rows, X.shape[-1])
            if not done.iloc[rows[0]]:
                H, violation = kernels.update_h(rule, X, H, W)
                if rule.name == "coordinate":  # a block's columns count alike
                    violation = violation * count[:, 0]
            found = kernels.block_stats(rule, X, H, W, violation, count)
            for j, i in enumerate(rows):
                hs[i], stats[i] = H[j].ravel(), found[j]
        return pd.DataFrame({"h": hs, "stats": stats})

    return run


def _statistics(rule: Rule):
    """Block statistics of given factors and activations, with the divergence as the last number."""
    @F.pandas_udf(DOUBLES)
    def run(x: pd.Series, h: pd.Series, w: pd.Series, m: pd.Series, k: pd.Series, weight: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for rows in _stacks(x, m, k):
            mi, ki = int(m.iloc[rows[0]]), int(k.iloc[rows[0]])
            X, H, W = _stacked(x, rows, mi, True), _stacked(h, rows, ki), _stacked(w, rows, mi)
            count = _weights(weight, rows, X.shape[-1])
            found = np.concatenate([kernels.block_stats(rule, X, H, W, 0.0, count), kernels.divergence(rule, X, H, W, count)[:, None]], axis=1)
            for j, i in enumerate(rows):
                out[i] = found[j]
        return pd.Series(out)

    return run


def _advance(rule: Rule):
    """Factor update of one task from its summed statistics, and the error that they show."""
    fields = T.StructType([T.StructField("w", DOUBLES), T.StructField("err", T.DoubleType())])

    @F.pandas_udf(fields)
    def run(w: pd.Series, stats: pd.Series, done: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for wi, si, di, mi in zip(w, stats, done, m):
            W, err = as_matrix(wi, mi), None
            if not di:
                s = np.asarray(si, dtype=float)
                W, violation = kernels.update_w(rule, W, s)
                # a divergence takes another look at the data
                err = None if rule.name == "kullback" else float(kernels.measure(rule, W, s, violation))
            out.append((W.ravel(), err))
        return pd.DataFrame(out, columns=["w", "err"])

    return run


def _settle(rule: Rule, it: int):
    """History and stopping test of every task after pass ``it``."""
    fields = T.StructType([
        T.StructField("prev", T.DoubleType()), T.StructField("first", T.DoubleType()), T.StructField("iters", T.IntegerType()),
        T.StructField("done", T.BooleanType()), T.StructField("converged", T.BooleanType())])
    test = it % rule.check_every == 0 or it == rule.max_iter

    @F.pandas_udf(fields)
    def run(err: pd.Series, prev: pd.Series, first: pd.Series, iters: pd.Series, done: pd.Series,
            converged: pd.Series) -> pd.DataFrame:
        out = []
        for ei, pi, fi, ii, di, ci in zip(err, prev, first, iters, done, converged):
            p, f = (None if v is None or v != v else v for v in (pi, fi))
            if di or not test:
                out.append((p, f, ii if di else it, bool(di), bool(ci)))
                continue
            f = ei if f is None else f
            stop = kernels.converged(rule, it, ei, ei if rule.name == "coordinate" else p, f)
            out.append((p if stop else ei, f, it, bool(stop or it >= rule.max_iter), bool(stop)))
        return pd.DataFrame(out, columns=[x.name for x in fields.fields])

    return run


def _start_random(rule: Rule):
    @F.pandas_udf(DOUBLES)
    def factors(m: pd.Series, k: pd.Series, seed: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([kernels.start_factors(rule, int(mi), int(ki), int(si), mu).ravel()
                          for mi, ki, si, mu in zip(m, k, seed, mean)])

    @F.pandas_udf(DOUBLES)
    def activations(n: pd.Series, k: pd.Series, seed: pd.Series, mean: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([kernels.start_block(rule, int(ni), int(ki), int(si), int(bi), mu).ravel()
                          for ni, ki, si, mu, bi in zip(n, k, seed, mean, block)])

    return factors, activations


@F.pandas_udf(DOUBLES)
def _gram(x: pd.Series, m: pd.Series) -> pd.Series:
    mats = [as_columns(xi, mi) for xi, mi in zip(x, m)]
    return pd.Series([np.append((X @ X.T).ravel(), [X.sum(), X.size]) for X in mats])


@F.pandas_udf(DOUBLES)
def _basis(gram: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
    out = []
    for g, mi, ki in zip(gram, m, k):
        U, S = kernels.svd_basis(np.asarray(g[:-2], dtype=float).reshape(int(mi), int(mi)), int(ki))
        out.append(np.concatenate([U.ravel(), S]))
    return pd.Series(out)


def _unbasis(basis, m: int, k: int):
    b = np.asarray(basis, dtype=float)
    return b[:m * k].reshape(m, k), b[m * k:]


@F.pandas_udf(DOUBLES)
def _sides(x: pd.Series, m: pd.Series, k: pd.Series, basis: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([kernels.svd_sides(*_unbasis(b, int(mi), int(ki)), as_columns(xi, mi), float(ci))
                      for xi, mi, ki, b, ci in zip(x, m, k, basis, weight)])


@F.pandas_udf(DOUBLES)
def _svd_w(m: pd.Series, k: pd.Series, basis: pd.Series, sides: pd.Series) -> pd.Series:
    return pd.Series([kernels.svd_factors(*_unbasis(b, int(mi), int(ki)), np.asarray(s, dtype=float))[0].ravel()
                      for mi, ki, b, s in zip(m, k, basis, sides)])


@F.pandas_udf(DOUBLES)
def _svd_h(x: pd.Series, m: pd.Series, k: pd.Series, basis: pd.Series, sides: pd.Series) -> pd.Series:
    out = []
    for xi, mi, ki, b, s in zip(x, m, k, basis, sides):
        U, S = _unbasis(b, int(mi), int(ki))
        _, scale, mean = kernels.svd_factors(U, S, np.asarray(s, dtype=float))
        out.append(kernels.svd_activations(U, S, scale, mean, as_columns(xi, mi)).ravel())
    return pd.Series(out)


def placed(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The data (keys, block_id, m, x) laid out once by (keys, block_id); passes join it where it lies."""
    return cut_lineage(blocks.select(*keys, "block_id", "m", "x").repartition(*[F.col(c) for c in [*keys, "block_id"]]))


def start_large(data: DataFrame, draws: DataFrame, tasks: DataFrame, keys: Sequence[str], runs: Sequence[str],
                rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Start factors per task, and start activations per (task, block) without the data.

    ``tasks`` is (runs, k, start, seed), ``draws`` (runs, block_id, weight); ``runs`` extends ``keys``. What a block adds
    to a run (its Gram matrix, its sum) is taken from the data once and multiplied by its weight for each run.
    """
    ids = [*runs, "k", "start"]
    own = data.select(*keys, "block_id", "m", (F.size("x") / F.col("m")).cast("int").alias("n"), _gram("x", "m").alias("_g"))
    own = cut_lineage(own)  # m * m numbers a block
    met = draws.join(own, [*keys, "block_id"])
    weighted = met.withColumn("_g", F.transform("_g", lambda v: v * F.col("weight")))
    grams = vector_sum(weighted, list(runs), "_g", "_g").join(met.groupBy(*runs).agg(F.first("m").alias("m")), list(runs))
    mean = F.element_at("_g", -2) / F.element_at("_g", -1)
    base = tasks.join(grams, list(runs)).withColumn("_mean", mean)
    if rule.name == "svd_start":
        base = cut_lineage(base.withColumn("_basis", _basis("_g", "m", "k")).drop("_g", "_mean"))
        wide = data.join(draws.join(base.drop("m"), list(runs)), [*keys, "block_id"])
        sides = vector_sum(wide.withColumn("_s", _sides("x", "m", "k", "_basis", "weight")), ids, "_s", "_s")
        base = base.join(sides, ids)
        factors = base.select(*ids, "seed", "m", _svd_w("m", "k", "_basis", "_s").alias("w"))
        state = data.join(draws.join(base.drop("m"), list(runs)), [*keys, "block_id"]).select(
            *ids, "block_id", "weight", _svd_h("x", "m", "k", "_basis", "_s").alias("h"))
        return factors, state
    make_w, make_h = _start_random(rule)
    factors = base.select(*ids, "seed", "m", make_w("m", "k", "seed", "_mean").alias("w"))
    sized = draws.join(own.select(*keys, "block_id", "n"), [*keys, "block_id"])
    state = sized.join(base.select(*ids, "seed", "_mean"), list(runs)).select(
        *ids, "block_id", "weight", make_h("n", "k", "seed", "_mean", "block_id").alias("h"))
    return factors, state


def iterate_large(factors: DataFrame, state: DataFrame, data: DataFrame, keys: Sequence[str], ids: Sequence[str],
                  rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Run the rule over block state (ids, block_id, weight, h) until every task has stopped.

    ``data`` (keys, block_id, m, x) stays where ``placed`` put it: only activations and factors are iterated and written,
    so what a pass costs on disk does not depend on the width of the data. The state lies as the data does, by (keys,
    block_id), and meets it without a shuffle. It is kept in memory with disk spill and written to the shared checkpoint
    folder every few passes, so a lost executor replays a few passes at most. The driver sees one number per pass
    that tests: how many tasks still run.
    """
    spark = state.sparkSession
    ensure_checkpoint_dir(spark)
    ids, place = list(ids), [*keys, "block_id"]
    step, advance, look = _step(rule), _advance(rule), _statistics(rule)

    def met(state: DataFrame, factors: DataFrame, *more: str) -> DataFrame:
        return data.join(state.join(factors.select(*ids, "w", *more), ids), place)

    def looked(state: DataFrame, factors: DataFrame) -> DataFrame:
        rows = met(state, factors).withColumn("_l", look("x", "h", "w", "m", "k", "weight"))
        return vector_sum(rows, ids, "_l", "_l")

    state = cut_lineage(state.repartition(*[F.col(c) for c in place]))
    kept_columns = [c for c in factors.columns if c not in (*ids, "m", "w")]
    factors = factors.select(*ids, *kept_columns, "m", "w")
    err = F.lit(None).cast("double")
    if rule.name == "svd_start":
        factors = factors.join(looked(state, factors), ids)
        err = _start_error(rule)("w", "_l", "m")
    factors = cut_lineage(factors.select(
        *ids, *kept_columns, "m", "w", err.alias("prev"), err.alias("first"), F.lit(0).alias("iters"),
        F.lit(False).alias("done"), F.lit(False).alias("converged")))
    held = None
    for it in range(1, rule.max_iter + 1):
        test = it % rule.check_every == 0 or it == rule.max_iter
        stepped = met(state, factors, "done").select(*ids, "block_id", "weight", step("x", "h", "w", "m", "k", "weight", "done").alias("_s"))
        following = stepped.select(*ids, "block_id", "weight", F.col("_s.h").alias("h"), F.col("_s.stats").alias("_stats"))
        kept = None if it % CHECKPOINT_EVERY == 0 else following.persist()
        following = cut_lineage(following) if kept is None else kept
        sums = vector_sum(following, ids, "_stats", "_stats")
        moved = factors.join(sums, ids).withColumn("_a", advance("w", "_stats", "done", "m"))
        moved = cut_lineage(moved.select(*ids, *kept_columns, "m", "_a.*", "prev", "first", "iters", "done", "converged"))
        state = following.drop("_stats")
        if test and rule.name == "kullback":
            moved = moved.drop("err").join(looked(state, moved).select(*ids, F.element_at("_l", -1).alias("err")), ids)
        settled = moved.withColumn("_t", _settle(rule, it)("err", "prev", "first", "iters", "done", "converged"))
        factors = cut_lineage(settled.select(*ids, *kept_columns, "m", "w", "_t.*"))
        # the data frame that was persisted is the one to release; this pass no longer needs the last one
        if held is not None:
            held.unpersist()
        held = kept
        if test and not has_rows(factors.where(~F.col("done"))):
            break
    if held is not None:
        state = cut_lineage(state)
        held.unpersist()
    return factors, state


def _start_error(rule: Rule):
    @F.pandas_udf(T.DoubleType())
    def run(w: pd.Series, stats: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([kernels.measure(rule, as_matrix(wi, mi), np.asarray(si, dtype=float)[:-1], 0.0)
                          for wi, si, mi in zip(w, stats, m)], dtype=float)
    return run


@F.pandas_udf(DOUBLES)
def _channel_errors(x: pd.Series, h: pd.Series, w: pd.Series, m: pd.Series, k: pd.Series, weight: pd.Series,
                    points: pd.Series) -> pd.Series:
    """Per block: squared error and total by channel, activations when blocks are equal, and a one, each times its weight."""
    out = []
    for xi, hi, wi, mi, ki, ci, pi in zip(x, h, w, m, k, weight, points):
        X, H, W = as_columns(xi, mi), as_matrix(hi, ki), as_matrix(wi, mi)
        out.append(float(ci) * np.concatenate([np.square(X - W @ H).sum(axis=1), np.square(X).sum(axis=1),
                                               H.ravel() if pi == pi and pi is not None else [], [1.0]]))
    return pd.Series(out)


def fit_large(blocks: DataFrame, tasks: DataFrame, keys: Sequence[str], rule: Rule, normalise: bool,
              draws: DataFrame | None = None, runs: Sequence[str] | None = None) -> DataFrame:
    """Distributed fits; ``tasks`` is (runs, k, seeds). All starts of all tasks run together, the best of each task is kept.

    Without ``draws`` a task fits the blocks of its ``keys``. With them a task belongs to a run, which extends the keys,
    and fits blocks as often as ``draws`` (runs, block_id, weight) says; all runs share one copy of the data. A condition
    with entries that are not finite, or a task without a finite fit, keeps a row with the reason.
    """
    runs = list(runs or keys)
    ids = [*runs, "k", "start"]
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = cut_lineage(blocks.groupBy(*keys).agg(F.max(odd).alias("_odd"), F.first("m").alias("m")))
    everything = tasks.select(*runs, "k").join(sound, list(keys))
    good = sound.where(~F.col("_odd")).select(*keys)
    data = placed(blocks.join(good, list(keys), "left_semi"), keys)
    tasks = tasks.join(good, list(keys), "left_semi")
    if draws is None:
        draws = data.select(*keys, "block_id", F.lit(1).alias("weight"))
    seeds = F.slice("seeds", 1, 1) if rule.name == "svd_start" else F.col("seeds")
    tasks = cut_lineage(tasks.select(*runs, "k", F.posexplode(seeds).alias("start", "seed")))
    factors, state = iterate_large(*start_large(data, draws, tasks, keys, runs, rule), data, keys, ids, rule)
    lengths = shapes(data, keys).select(*keys, "points")
    met = data.join(state.join(factors.select(*ids, "w"), ids), [*keys, "block_id"]).join(lengths, list(keys))
    ends = vector_sum(met.withColumn("_e", _channel_errors("x", "h", "w", "m", "k", "weight", "points")), ids, "_e", "_e")
    m, n = F.col("m"), F.element_at("_e", -1)
    done = ends.join(factors, ids).select(
        *runs, "m", "k", "w", F.when(F.size("_e") > 2 * m + 1, F.transform(
            F.slice("_e", 2 * m + 1, F.size("_e") - 2 * m - 1), lambda v: v / n)).alias("wave"),
        F.col("seed").cast("bigint").alias("seed"), "iters", "converged",
        F.aggregate(F.slice("_e", F.lit(1), m), F.lit(0.0), lambda a, b: a + b).alias("sse"),
        F.slice("_e", F.lit(1), m).alias("channel_sse"), F.slice("_e", m + 1, m).alias("channel_sst"),
        F.lit(None).cast("string").alias("fail_reason"), F.col("start").alias("_start"))
    done = cut_lineage(done)
    finite = done.where(~F.isnan("sse") & (F.col("sse") < float("inf")))
    best = top_row(finite, [*runs, "k"], [F.col("sse"), F.col("_start")], lowest=True).drop("_start")
    out = best.select(*runs, "m", "k", *[n for n, _ in FIT_FIELDS])
    out = scale_factors(out, rule.eps) if normalise else out
    reason = F.concat(F.lit("ValueError: "), F.when(F.col("_odd"), F.lit(NONFINITE)).otherwise(F.lit(NO_FINITE_FIT)))
    failed = everything.join(best.select(*runs, "k"), [*runs, "k"], "left_anti").select(
        *runs, "m", "k", *[(reason if n == "fail_reason" else F.lit(None).cast(t)).alias(n) for n, t in FIT_FIELDS])
    return out.unionByName(failed)


def scale_factors(fits: DataFrame, eps: float) -> DataFrame:
    """Scale module weights to sum to one and the waveforms by the same amount."""
    k = F.col("k")
    sums = F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.aggregate(
        F.filter("w", lambda _, i: i % k == c), F.lit(0.0), lambda a, b: a + b) + eps)
    points = (F.size("wave") / k).cast("int")
    return fits.withColumns({
        "w": let(sums, lambda s: F.transform("w", lambda v, i: v / F.get(s, i % k))),
        "wave": let(sums, lambda s: F.transform("wave", lambda v, i: v * F.get(s, F.floor(i / points).cast("int"))))})


def fit_conditions(blocks: DataFrame, keys: Sequence[str], wanted: DataFrame, rule: Rule,
                   n_starts: int, normalise: bool = False, limit: int = TASK_CELLS) -> DataFrame:
    """Best fit per (condition, rank) asked for in ``wanted``: (keys, k, seeds), one seed per start."""
    # a few numbers per fit; written so that both ways and every start read the same list
    wanted = cut_lineage(wanted)
    small, large = gather(blocks, keys, limit)
    rows = wanted.agg(F.sum(F.ceil(F.size("seeds") / STARTS_A_TASK))).first()[0] or 0
    fits = fit_small(small.join(wanted, list(keys)), keys, rule, normalise, rows)
    if has_rows(large):
        todo = wanted.join(large.select(*keys).distinct(), list(keys), "left_semi")
        fits = fits.unionByName(fit_large(large, todo, keys, rule, normalise))
    return fits


def shapes(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Channel count, block count and common block length (NULL when unequal) per condition."""
    points = cells(blocks) / F.col("m")
    return blocks.groupBy(*keys).agg(
        F.first("m").alias("m"), F.count("*").cast("int").alias("n_strides"), F.min(points).alias("_lo"),
        F.max(points).alias("_hi")).select(
        *keys, "m", "n_strides", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).cast("int").alias("points"))


def explained(fits: DataFrame, eps: float) -> DataFrame:
    """Variance accounted for: in total, and the minimum, median and mean over channels."""
    total = F.aggregate("channel_sst", F.lit(0.0), lambda a, b: a + b) + eps
    per = F.zip_with("channel_sse", "channel_sst", lambda e, t: 1.0 - e / (t + eps))
    ordered = F.array_sort(per)
    n = F.size("channel_sse")
    mid = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    explained_sse = F.aggregate("channel_sse", F.lit(0.0), lambda a, b: a + b)
    return fits.select("*", (1.0 - explained_sse / total).alias("vaf_total"), F.array_min(per).alias("vaf_min"),
                       mid.alias("vaf_median"),
                       (F.aggregate(per, F.lit(0.0), lambda a, b: a + b) / n).alias("vaf_mean"))
