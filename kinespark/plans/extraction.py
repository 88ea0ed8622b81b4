"""Module extraction, rank selection and bootstrap stability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.keys import seed32, speed_tag, trial_tag, truthy
from ..operators import factorise, resample
from ..operators.linkage import consensus_quality
from ..operators.matrices import TASK_CELLS, as_matrix, vector_sum
from ..operators.selection import select_rank, top_row

KEY = ["dataset", "subject", "trial", "speed_key"]
# Largest rank per dataset, and for any other dataset.
K_MIN, K_MAX, K_MAX_OTHER = 2, {"vanhooren": 7, "santuz": 9}, 10
N_STARTS = 10
# Stability replicates, starts, seed base and acceptance threshold.
N_BOOT, BOOT_STARTS, SEED_BASE, MIN_QUALITY = 50, 5, 12345, 0.90


def key_text() -> list[Column]:
    """The parts every seed of a condition starts with."""
    return [F.col("dataset"), F.col("subject"), trial_tag("trial"), speed_tag(F.col("speed_key") / 100)]


def rank_range() -> Column:
    """Ranks to try: 2 up to the dataset's limit, always below the channel count."""
    top = F.coalesce(*[F.when(F.lower("dataset") == d, F.lit(k)) for d, k in K_MAX.items()], F.lit(K_MAX_OTHER))
    top = F.least(top, F.col("m") - 1)
    return F.when(top >= K_MIN, F.sequence(F.lit(K_MIN), top)).otherwise(F.array().cast("array<int>"))


def extract(blocks: DataFrame, done: DataFrame | None = None, n_starts: int = N_STARTS,
            rule: kernels.Rule = kernels.EXTRACTION, limit: int = TASK_CELLS) -> DataFrame:
    """Best factorisation of every condition at every candidate rank.

    Conditions whose channel count leaves no rank keep a row with the reason.
    ``done`` holds finished (KEY, k) rows that are not fitted again.
    """
    shape = factorise.shapes(blocks, KEY)
    ranks = shape.withColumn("_ks", rank_range())
    wanted = ranks.select(*KEY, F.explode("_ks").alias("k"))
    if done is not None:
        wanted = wanted.join(done.select(*KEY, "k").distinct(), [*KEY, "k"], "left_anti")
    seeds = F.array(*[seed32(*key_text(), F.col("k"), F.lit(j)) for j in range(n_starts)])
    fits = factorise.fit_conditions(blocks, KEY, wanted.withColumn("seeds", seeds), rule, n_starts,
                                    normalise=True, limit=limit)
    fits = factorise.explained(fits, rule.eps).withColumn("ok", F.col("fail_reason").isNull())
    empty = ranks.where(F.size("_ks") == 0).select(
        *KEY, "m", F.lit(False).alias("ok"),
        F.concat(F.lit("K_RANGE_EMPTY: m="), F.col("m").cast("string")).alias("fail_reason"))
    out = fits.unionByName(empty, allowMissingColumns=True).join(shape.drop("m"), KEY)
    return out.withColumn("n_obs", F.col("n_strides") * F.col("points"))


def choose_rank(summary: DataFrame, total_target: float = 0.90, channel_target: float = 0.75,
                max_drop: float = 0.01) -> DataFrame:
    """Chosen rank per condition, with an explicit row where no fit converged."""
    usable = summary.where(truthy("ok") & truthy("converged"))
    chosen = select_rank(usable, KEY, total_target, channel_target, max_drop)
    lost = summary.select(*KEY).distinct().join(chosen.select(*KEY), KEY, "left_anti")
    return chosen.unionByName(lost.withColumn("chosen_rule", F.lit("no_converged_fit")), allowMissingColumns=True)


@F.pandas_udf(T.StructType([T.StructField("labels", T.ArrayType(T.DoubleType())),
                            T.StructField("cosines", T.ArrayType(T.DoubleType()))]))
def _agreement(w: pd.Series, w_ref: pd.Series, m: pd.Series) -> pd.DataFrame:
    """Connectivity of a replicate's channel labels, and its module cosines with the reference fit."""
    out = []
    for wi, ri, mi in zip(w, w_ref, m):
        W, R = as_matrix(wi, mi), as_matrix(ri, mi)
        labels = W.argmax(axis=1)
        same = (labels[:, None] == labels[None, :]).astype(float)
        rows, cols, cos = kernels.match(R, W)
        # an empty module has no direction, so its pair has no cosine
        sized = (np.linalg.norm(R[:, rows], axis=0) >= 1e-9) & (np.linalg.norm(W[:, cols], axis=0) >= 1e-9)
        out.append((same.ravel(), cos[sized]))
    return pd.DataFrame(out, columns=["labels", "cosines"])


def _boot_seeds(n_starts: int):
    def seeds(row, replicate, side):
        return [SEED_BASE + resample.text_seed(f"{row.seed_text}|boot|{replicate}|{j}") for j in range(n_starts)]
    return seeds


def stability(blocks: DataFrame, chosen: DataFrame, summary: DataFrame, n_boot: int = N_BOOT,
              n_starts: int = BOOT_STARTS, rule: kernels.Rule = kernels.STABILITY,
              limit: int = TASK_CELLS) -> DataFrame:
    """Consensus stability of the chosen factorisation under a moving-block bootstrap.

    Every chosen condition keeps a row; one that cannot be tested says why.
    """
    from ..functions.signal import block_length
    picks = chosen.where(F.col("chosen_k").isNotNull()).select(*KEY, F.col("chosen_k").alias("k"))
    # one fit per (condition, rank) on the right of the left join
    base = top_row(summary.where(F.col("w").isNotNull()).select(*KEY, "k", "w", "m", "n_strides", "points"),
                   [*KEY, "k"], [F.col("n_strides")])
    joined = picks.join(base, [*KEY, "k"], "left")
    reason = (F.when(F.col("w").isNull(), "missing_baseline_fit")
              .when(F.col("points").isNull(), "BAD_STRIDE_META")
              .when(F.col("n_strides") < 2, F.concat(F.lit("n_strides<2 n_strides="), F.col("n_strides").cast("string"))))
    joined = joined.withColumn("fail_reason", reason)
    text = F.concat_ws("|", *key_text(), F.col("k").cast("string"))
    ready = joined.where(F.col("fail_reason").isNull()).select(
        *KEY, "k", "n_strides", block_length("n_strides").alias("block"), text.alias("seed_text"),
        (F.lit(SEED_BASE) + seed32(*key_text(), F.col("k"))).alias("draw_seed"))
    boots = resample.replicate_fits(blocks, ready, KEY, resample.MOVING, rule, _boot_seeds(n_starts), 0, n_boot,
                                    n_starts, normalise=True, limit=limit)
    refs = joined.where(F.col("fail_reason").isNull()).select(*KEY, F.col("w").alias("w_ref"))
    scored = boots.where(F.col("w_a").isNotNull()).join(refs, KEY).select(
        *KEY, "m", _agreement("w_a", "w_ref", "m").alias("_a")).select(*KEY, "m", "_a.*")
    n = scored.groupBy(*KEY).agg(F.count("*").alias("n_boot_success"), F.first("m").alias("m"))
    links = vector_sum(scored, KEY, "labels", "_c").join(n, KEY)
    shares = links.select(*KEY, "n_boot_success", "m", F.posexplode("_c").alias("_i", "_v")).select(
        *KEY, F.floor(F.col("_i") / F.col("m")).cast("int").alias("a"), (F.col("_i") % F.col("m")).alias("b"),
        (F.col("_v") / F.col("n_boot_success")).alias("c")).where("a < b")
    quality = n.select(*KEY, "n_boot_success").join(consensus_quality(shares, KEY), KEY, "left")
    # a condition has n_boot times k cosines, so the built-in percentile is small
    cos = scored.select(*KEY, F.explode("cosines").alias("c")).groupBy(*KEY).agg(
        F.median("c").alias("w_cosine_median"), F.min("c").alias("w_cosine_min"))
    table = joined.drop("w").join(quality, KEY, "left").join(cos, KEY, "left")
    single = F.coalesce(F.col("w_cosine_median") >= MIN_QUALITY, F.lit(False))
    many = F.coalesce(F.col("cophenetic") >= MIN_QUALITY, F.lit(False))
    passed = F.col("fail_reason").isNull() & F.when(F.col("k") == 1, single).otherwise(many)
    why = F.when(F.col("k") == 1, f"w_cosine_median<{MIN_QUALITY} (k==1) or NaN").otherwise(
        f"cophenetic<{MIN_QUALITY} (or NaN)")
    return table.withColumn("pass_stability", passed).withColumn(
        "fail_reason", F.coalesce("fail_reason", F.when(~passed, why), F.lit("")))


def module_weights(stable: DataFrame, summary: DataFrame) -> DataFrame:
    """Long module table (condition, synergy, channel index, weight)."""
    fits = summary.select(*KEY, "k", "m", "w")
    rows = stable.select(*KEY, "k", "pass_stability", "fail_reason").join(fits, [*KEY, "k"])
    return rows.select(*KEY, "k", "pass_stability", "fail_reason", F.posexplode("w").alias("_i", "weight")).select(
        *KEY, "k", "pass_stability", "fail_reason", (F.col("_i") % F.col("k") + 1).alias("synergy"),
        F.floor(F.col("_i") / F.col("k")).cast("int").alias("muscle_idx"), "weight")


def wide_modules(weights: DataFrame, muscles: DataFrame, names: list[str]) -> DataFrame:
    """One column per channel name; ``muscles`` maps (KEY, muscle_idx) to names."""
    named = weights.join(muscles, [*KEY, "muscle_idx"])
    return named.groupBy(*KEY, "k", "synergy", "pass_stability", "fail_reason").pivot("muscle", names).agg(
        F.first("weight"))
