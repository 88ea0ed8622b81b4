"""Floors under alternative analysis choices, and their agreement with the baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.keys import clean_floats, speed_key, truthy
from ..operators import factorise, statistics
from ..operators.draws import drawn
from ..operators.matrices import TASK_CELLS, compare_modules, cross_fidelity
from ..operators.selection import floors as reduce_floors
from ..operators.segments import row_numbers
from ..operators.selection import sequential_gates
from ..session import cut_lineage
from .extraction import KEY
from .floors import ALL_GATES, BOUNDS, REFERENCE_SPEED, TEST_ORDER

GROUP = ["dataset", "subject", "trial"]
CASE = ["variant", *GROUP]
# Starts and seeds of the refits, share of strides in the half-stride variant.
N_STARTS, SEED, QUERY_SEED_SHIFT, STRIDE_SEED_SHIFT = 5, 20260103, 100, 1000
HALF = 0.5


@dataclass(frozen=True)
class Variant:
    """One alternative: factorisation rule, matching rule, share of strides, own-maximum scaling."""

    name: str
    rule: kernels.Rule = kernels.SENSITIVITY
    matching: str = "cosine"
    stride_fraction: float = 1.0
    renormalise: bool = False

    @property
    def changes(self) -> bool:
        """Whether it looks at other data than the blocks as they are."""
        return self.stride_fraction < 1.0 or self.renormalise


VARIANTS = (
    Variant("nmf_kl", rule=kernels.SENSITIVITY_KL),
    Variant("stride_half", stride_fraction=HALF),
    Variant("matching_euclidean", matching="euclidean"),
    Variant("norm_per_speed", renormalise=True),
)


def subsample(blocks: DataFrame, fraction: float, reference_key: int) -> DataFrame:
    """Keep a seeded share of each condition's strides (at least one), renumbered in order."""
    sizes = blocks.groupBy(*KEY).agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("size"))
    seed = F.when(F.col("speed_key") == reference_key, F.lit(SEED)).otherwise(F.lit(SEED + STRIDE_SEED_SHIFT))
    picks = drawn(blocks.select(*KEY, "block_id"), KEY, ["block_id"], sizes, seed)
    placed = row_numbers(picks.withColumn("_chunk", F.floor(F.col("block_id") / 10_000)), KEY, ["block_id"], "_rn", "_chunk")
    picks = placed.select(*KEY, "block_id", (F.col("_rn") - 1).cast("bigint").alias("_new"))
    return blocks.join(picks, [*KEY, "block_id"]).select(*KEY, F.col("_new").alias("block_id"), "m", "x")


def own_maximum(blocks: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Scale each channel of a condition by its own maximum."""
    peaks = blocks.select(*KEY, "m", F.posexplode("x").alias("_i", "_v")).groupBy(
        *KEY, (F.col("_i") % F.col("m")).alias("c")).agg(F.max("_v").alias("_p"))
    table = peaks.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "_p"))),
                                                lambda s: F.greatest(s["_p"], F.lit(floor))).alias("_peaks"))
    scaled = F.transform("x", lambda v, i: v / F.get("_peaks", i % F.col("m")))
    return blocks.join(table, KEY).select(*KEY, "block_id", "m", scaled.alias("x"))


def variant_blocks(variant: Variant, blocks: DataFrame, reference_key: int) -> DataFrame:
    """The blocks that a variant looks at."""
    data = blocks
    if variant.stride_fraction < 1.0:
        data = subsample(data, variant.stride_fraction, reference_key)
    if variant.renormalise:
        data = own_maximum(data)
    return data.select(F.lit(variant.name).alias("variant"), *KEY, "block_id", "m", "x")


def variant_floors(variants: Sequence[Variant], stable: DataFrame, bounds: DataFrame, surrogate: DataFrame, blocks: DataFrame,
                   n_starts: int = N_STARTS, limit: int = TASK_CELLS) -> DataFrame:
    """Floor per variant and subject; subjects that cannot be tested say why.

    The rank is the reference condition's at every speed. A speed without data
    or null threshold is passed over. Variants are conditions beside each other: those of one rule are fitted together,
    and all are tested together.
    """
    ref_key = round(REFERENCE_SPEED * 100)
    order = {round(s * 100): i for i, s in enumerate(TEST_ORDER)}
    stable = stable.where(truthy("pass_stability"))
    ref_k = stable.where(F.col("speed_key") == ref_key).groupBy(*GROUP).agg(F.min("k").alias("k"))
    tested = blocks.where(F.col("speed_key").isin(ref_key, *order)).join(ref_k.select(*GROUP), GROUP, "left_semi")
    # blocks that a variant changes are written once, those that it takes as they are lie where they were
    plain = [v for v in variants if not v.changes]
    data = [variant_blocks(v, tested, ref_key) for v in plain]
    if len(plain) < len(variants):
        data.append(cut_lineage(reduce(DataFrame.unionByName, [variant_blocks(v, tested, ref_key) for v in variants if v.changes])))
    data = reduce(DataFrame.unionByName, data)
    shift = F.when(F.col("speed_key") == ref_key, F.lit(SEED)).otherwise(F.lit(SEED + QUERY_SEED_SHIFT))
    wanted = data.select(*CASE, "speed_key").distinct().join(ref_k, GROUP).withColumn(
        "seeds", F.array(*[(shift + j).cast("bigint") for j in range(n_starts)]))
    fits = []
    for rule in dict.fromkeys(v.rule for v in variants):
        own = F.col("variant").isin(*[v.name for v in variants if v.rule == rule])
        fits.append(factorise.fit_conditions(data.where(own), [*CASE, "speed_key"], wanted.where(own), rule, n_starts, limit=limit))
    fits = cut_lineage(reduce(DataFrame.unionByName, fits))
    fits = fits.where(F.col("w").isNotNull())
    ref = fits.where(F.col("speed_key") == ref_key).select(*CASE, F.col("m").alias("m_ref"), F.col("w").alias("w_ref"),
                                                           F.col("wave").alias("wave_ref"))
    q = fits.where(F.col("speed_key") != ref_key).select(*CASE, F.col("speed_key").alias("q_key"), "w", "wave")
    pairs = q.join(ref, CASE)
    compared = []
    for matching in dict.fromkeys(v.matching for v in variants):
        own = pairs.where(F.col("variant").isin(*[v.name for v in variants if v.matching == matching]))
        compared.append(own.withColumn("_m", compare_modules(matching)("w_ref", "wave_ref", "w", "wave", "m_ref")))
    metrics = reduce(DataFrame.unionByName, compared).select(
        *CASE, "q_key", "_m.cosine_median", "_m.dtw_mean", "_m.principal_angle_max_deg")
    forward = pairs.select(*CASE, F.lit(ref_key).alias("from_key"), F.col("q_key").alias("to_key"))
    both = forward.unionByName(forward.select(*CASE, F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key")))
    fid = cross_fidelity(both, fits, data, CASE, "from_key", "to_key")
    is_forward = F.col("from_key") == ref_key
    fid = fid.groupBy(*CASE, F.when(is_forward, F.col("to_key")).otherwise(F.col("from_key")).alias("q_key")).agg(
        F.max(F.when(is_forward, F.col("fidelity"))).alias("forward"),
        F.max(F.when(~is_forward, F.col("fidelity"))).alias("back"))
    null = surrogate.select(*GROUP, speed_key("q_speed_mps").alias("q_key"), "F_null_95").groupBy(*GROUP, "q_key").agg(
        F.first("F_null_95").alias("F_null_95"))
    limits = clean_floats(bounds).select(*GROUP, *BOUNDS)
    rows = fid.join(metrics, [*CASE, "q_key"]).join(null, [*GROUP, "q_key"]).join(limits, GROUP)
    c = F.col
    gates = {"g1": c("forward") >= c("L_ref_fidelity"), "g2": c("back") >= c("L_ref_fidelity"),
             "g3": c("forward") > c("F_null_95"), "g4": c("back") > c("F_null_95"),
             "g5": c("cosine_median") >= c("L_ref_cosine_median"), "g6": c("dtw_mean") <= c("U_ref_dtw_mean"),
             "g7": c("principal_angle_max_deg") <= c("U_ref_principal_angle_max_deg")}
    seq = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    rows = rows.select(*CASE, (c("q_key") / 100).alias("q_speed_mps"), seq[c("q_key")].alias("seq_index"),
                       *[F.coalesce(g, F.lit(False)).alias(n) for n, g in gates.items()])
    floors = reduce_floors(sequential_gates(rows, CASE, "seq_index", ALL_GATES), CASE, "seq_index", "q_speed_mps",
                           REFERENCE_SPEED)
    names = F.explode(F.array(*[F.lit(v.name) for v in variants]))
    subjects = stable.select(*GROUP).distinct().select(names.alias("variant"), *GROUP)
    out = subjects.join(limits.select(*GROUP, F.lit(True).alias("_bound")), GROUP, "left").join(
        ref_k, GROUP, "left").join(floors.drop("all_speeds_pass"), CASE, "left")
    why = F.when(c("_bound").isNull(), "no_reliability_data").when(c("k").isNull(), "no_ref_speed")
    floor = F.coalesce("floor_speed_mps", F.lit(REFERENCE_SPEED))
    return out.select(*GROUP, "variant", F.when(why.isNull(), floor).alias("floor_speed_mps"),
                      "first_failed_speed_mps", F.coalesce(why, c("first_failure_gate")).alias("first_failure_gate"))


def all_variants(floors: DataFrame, stable: DataFrame, bounds: DataFrame, surrogate: DataFrame, blocks: DataFrame,
                 variants: tuple[Variant, ...] = VARIANTS, n_starts: int = N_STARTS,
                 limit: int = TASK_CELLS) -> DataFrame:
    """Baseline seven-gate floors and every variant's floors as one long table."""
    base = floors.select(*GROUP, F.lit("baseline").alias("variant"), F.col("floor_speed_mps_7gate").alias("floor_speed_mps"),
                         F.col("first_failed_speed_mps_7gate").alias("first_failed_speed_mps"),
                         F.col("first_failure_gate_7gate").alias("first_failure_gate"))
    return base.unionByName(variant_floors(variants, stable, bounds, surrogate, blocks, n_starts, limit))


def floors_by_variant(results: DataFrame, names: list[str]) -> DataFrame:
    return results.groupBy(*GROUP).pivot("variant", names).agg(F.first("floor_speed_mps"))


def agreement(results: DataFrame, variants: tuple[Variant, ...] = VARIANTS) -> tuple[DataFrame, DataFrame]:
    """ICC over all variants and per variant against the baseline, and Bland-Altman limits."""
    names = ["baseline", *[v.name for v in variants]]
    wide = cut_lineage(floors_by_variant(results, names))
    iccs = [statistics.icc21(wide, names).select(F.lit("all_variants").alias("comparison"), "icc_2_1",
                                                 F.col("n").alias("n_subjects"), F.lit(len(names)).alias("n_variants"))]
    limits = []
    for v in names[1:]:
        iccs.append(statistics.icc21(wide, ["baseline", v]).select(
            F.lit(f"baseline_vs_{v}").alias("comparison"), "icc_2_1", F.col("n").alias("n_subjects"), F.lit(2).alias("n_variants")))
        limits.append(statistics.bland_altman(wide, "baseline", v).select(F.lit(v).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, iccs), reduce(DataFrame.unionByName, limits)
