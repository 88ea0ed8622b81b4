"""Cross-condition fidelity, surrogate nulls and module similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.keys import truthy
from ..operators import factorise
from ..operators.joins import assert_unique, ordered_pairs, reference_pairs
from ..operators.matrices import TASK_CELLS, compare_modules, cross_fidelity, surrogate_fidelity
from .extraction import KEY

GROUP = ["dataset", "subject", "trial"]
# Surrogate count, first seed, refinement passes.
N_SURROGATES, SURROGATE_SEED, SURROGATE_PASSES = 1000, 42, 20


def passing(stable: DataFrame) -> DataFrame:
    """Stable conditions: one row each, keyed by speed."""
    rows = stable.where(truthy("pass_stability") & F.col("speed_key").isNotNull())
    return assert_unique(rows.select(*KEY, "k", "n_strides"), KEY, "stable condition")


def _both_ways(pairs: DataFrame, factors: DataFrame, blocks: DataFrame, a: str, b: str) -> DataFrame:
    """Fidelity of a's factors on b's data and of b's factors on a's data, in one pass over the data."""
    forward = pairs.select(*GROUP, F.col(a).alias("from_key"), F.col(b).alias("to_key"))
    both = forward.unionByName(pairs.select(*GROUP, F.col(b).alias("from_key"), F.col(a).alias("to_key"))).distinct()
    return cross_fidelity(both, factors, blocks, GROUP, "from_key", "to_key")


def pairwise(stable: DataFrame, factors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fidelity of every ordered pair of a subject's stable conditions."""
    pairs = ordered_pairs(passing(stable), GROUP, "speed_key")
    named = pairs.select(*GROUP, F.col("speed_key_a").alias("from_key"), F.col("speed_key_b").alias("to_key"),
                         "k_a", "k_b", "n_strides_a", "n_strides_b")
    fid = cross_fidelity(named.select(*GROUP, "from_key", "to_key"), factors, blocks, GROUP, "from_key", "to_key")
    out = named.join(fid, [*GROUP, "from_key", "to_key"], "left")
    note = F.when(F.col("fidelity").isNull(), "NO_FIDELITY").otherwise("")
    return out.select(*GROUP, (F.col("from_key") / 100).alias("speed_a_mps"), (F.col("to_key") / 100).alias("speed_b_mps"),
                      "k_a", "k_b", "n_strides_a", "n_strides_b", F.col("fidelity").alias("fidelity_a_to_b"),
                      note.alias("notes"))


def reference(stable: DataFrame, factors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fidelity both ways between a subject's fastest stable condition and each slower one."""
    pairs = reference_pairs(passing(stable), GROUP, "speed_key")
    fid = _both_ways(pairs, factors, blocks, "ref_speed_key", "q_speed_key")
    there = fid.select(*GROUP, F.col("from_key").alias("ref_speed_key"), F.col("to_key").alias("q_speed_key"),
                       F.col("fidelity").alias("fidelity_ref_to_q"))
    back = fid.select(*GROUP, F.col("to_key").alias("ref_speed_key"), F.col("from_key").alias("q_speed_key"),
                      F.col("fidelity").alias("fidelity_q_to_ref"))
    on = [*GROUP, "ref_speed_key", "q_speed_key"]
    out = pairs.join(there, on, "left").join(back, on, "left")
    lost = F.col("fidelity_ref_to_q").isNull() | F.col("fidelity_q_to_ref").isNull()
    return out.select(
        *GROUP, (F.col("ref_speed_key") / 100).alias("ref_speed_mps"), (F.col("q_speed_key") / 100).alias("q_speed_mps"),
        F.col("ref_k").alias("k_ref"), F.col("q_k").alias("k_q"), F.col("ref_n_strides").alias("n_strides_ref"),
        F.col("q_n_strides").alias("n_strides_q"), "fidelity_ref_to_q", "fidelity_q_to_ref",
        F.when(lost, "NO_FIDELITY").otherwise("").alias("notes"))


def surrogates(fidelity: DataFrame, factors: DataFrame, blocks: DataFrame, n_surrogates: int = N_SURROGATES,
               seed: int = SURROGATE_SEED) -> DataFrame:
    """Null distribution of the reference-to-query fidelity, and strict passes of both directions.

    One null serves both directions: only reference factors on surrogate query data are computed.
    """
    from ..functions.keys import speed_key
    pairs = fidelity.select(*GROUP, speed_key("ref_speed_mps").alias("ref_key"), speed_key("q_speed_mps").alias("q_key"))
    null = surrogate_fidelity(pairs, factors, blocks, GROUP, "ref_key", "q_key", n_surrogates, seed, SURROGATE_PASSES)
    # n_surrogates rows per pair: the built-in percentile holds them all
    dist = null.groupBy(*GROUP, "ref_key", "q_key").agg(
        F.avg("fidelity").alias("F_null_mean"), F.stddev_pop("fidelity").alias("F_null_std"),
        F.percentile("fidelity", 0.95).alias("F_null_95"))
    rows = fidelity.withColumn("ref_key", speed_key("ref_speed_mps")).withColumn("q_key", speed_key("q_speed_mps"))
    out = rows.join(dist, [*GROUP, "ref_key", "q_key"])
    return out.select(
        *GROUP, "q_speed_mps", "F_null_mean", "F_null_std", "F_null_95", "fidelity_ref_to_q", "fidelity_q_to_ref",
        F.coalesce(F.col("fidelity_ref_to_q") > F.col("F_null_95"), F.lit(False)).alias("pass_surrogate_ref_to_q"),
        F.coalesce(F.col("fidelity_q_to_ref") > F.col("F_null_95"), F.lit(False)).alias("pass_surrogate_q_to_ref"))


def similarity(fidelity: DataFrame, blocks: DataFrame, limit: int = TASK_CELLS,
               rule: kernels.Rule = kernels.ENVELOPE) -> DataFrame:
    """Spatial, temporal and subspace similarity of refitted reference and query modules.

    Each distinct (condition, rank) is refitted once; its deterministic start
    makes that the same as refitting it for every pair.
    """
    from ..functions.keys import speed_key
    rows = fidelity.withColumn("ref_key", speed_key("ref_speed_mps")).withColumn("q_key", speed_key("q_speed_mps"))
    wanted = rows.select(*GROUP, F.col("ref_key").alias("speed_key"), F.col("k_ref").alias("k")).unionByName(
        rows.select(*GROUP, F.col("q_key").alias("speed_key"), F.col("k_q").alias("k"))).distinct()
    fits = factorise.fit_conditions(blocks, KEY, wanted.withColumn("seeds", F.array(F.lit(0).cast("bigint"))),
                                    rule, 1, limit=limit)

    def side(name: str, key: str, k: str) -> DataFrame:
        return fits.select(*GROUP, F.col("speed_key").alias(key), F.col("k").alias(k), F.col("m").alias(f"m_{name}"),
                           F.col("w").alias(f"w_{name}"), F.col("wave").alias(f"wave_{name}"))

    paired = rows.join(side("ref", "ref_key", "k_ref"), [*GROUP, "ref_key", "k_ref"]).join(
        side("q", "q_key", "k_q"), [*GROUP, "q_key", "k_q"])
    metric = compare_modules()("w_ref", "wave_ref", "w_q", "wave_q", "m_ref")
    return paired.select(*GROUP, "q_speed_mps", "k_ref", "k_q", metric.alias("_m")).select(
        *GROUP, "q_speed_mps", "k_ref", "k_q", "_m.*")
