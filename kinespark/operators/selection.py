"""Per-group choices: rank selection, top rows, gates, floors, complete-case pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_row(df: DataFrame, keys: Sequence[str], by: Sequence[Column], lowest: bool = False) -> DataFrame:
    """One whole row per key: the largest (or smallest) sort tuple.

    An aggregate, not a window: rows are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if lowest else F.max_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*by)).alias("_row"))
            .select(*keys, "_row.*"))


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of every column per key, in the given order."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest])


def select_rank(df: DataFrame, keys: Sequence[str], total_target: float = 0.90,
                channel_target: float = 0.75, max_drop: float = 0.01) -> DataFrame:
    """Choose the rank per key.

    The smallest ``k`` reaching both variance targets; failing that, the smallest
    within ``max_drop`` of the best total. Duplicate fits of a (key, k) are first
    reduced to the best one, so what follows handles a few ranks per key.
    """
    rest = [c for c in df.columns if c not in [*keys, "k"]]
    # min k whose any duplicate meets the targets
    meets = (F.col("vaf_total") >= total_target) & (F.col("vaf_min") >= channel_target)
    best = df.where(F.col("k").isNotNull() & F.col("vaf_total").isNotNull()).groupBy(*keys, "k").agg(
        F.max_by(F.struct(*rest), F.struct("vaf_total", "vaf_min")).alias("_row"),
        F.coalesce(F.bool_or(meets), F.lit(False)).alias("_meets"),
        F.max("vaf_total").alias("_vaf"))
    group = Window.partitionBy(*keys)
    scored = best.withColumn("max_vaf_total", F.max("_vaf").over(group))
    by_target = F.min(F.when(F.col("_meets"), F.col("k"))).over(group)
    by_drop = F.min(F.when(F.col("_vaf") >= F.col("max_vaf_total") - max_drop, F.col("k"))).over(group)
    scored = scored.select(
        *keys, "k", "_row", "max_vaf_total", F.coalesce(by_target, by_drop).alias("chosen_k"),
        F.when(by_target.isNotNull(), "thresholds")
        .otherwise(f"within_{max_drop}_of_max_vaf").alias("chosen_rule"),
        F.count("*").over(group).alias("n_k_evaluated"))
    return (scored.where(F.col("k") == F.col("chosen_k"))
            .select(*keys, "k", "_row.*", "chosen_k", "chosen_rule", "max_vaf_total", "n_k_evaluated"))


def sequential_gates(df: DataFrame, keys: Sequence[str], order: str, gates: Sequence[str],
                     prefix: str = "") -> DataFrame:
    """Add pass, considered-so-far and first-failed-gate columns along a short test sequence.

    ``pass`` holds when all gates hold (an undefined gate fails); ``considered``
    is true until a failure has happened strictly before the row.
    """
    ok = F.coalesce(F.expr(" AND ".join(f"`{g}`" for g in gates)), F.lit(False))
    seq = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn(f"{prefix}pass", ok)
    p = F.col(f"{prefix}pass")
    earlier = F.min(p).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    from ..functions.keys import first_failed
    return (out.withColumn(f"{prefix}considered", F.coalesce(earlier, F.lit(True)))
            .withColumn(f"{prefix}failed_gate", F.when(~p, first_failed(gates))))


def floors(df: DataFrame, keys: Sequence[str], order: str, speed: str, default: float,
           margins: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Reduce gated sequences: last pass before the first failure, and the failure itself."""
    ok, seen = F.col(f"{prefix}pass"), F.col(f"{prefix}considered")
    held = F.when(ok & seen, F.col(speed))
    failed = F.when(~ok & seen, F.struct(
        F.col(speed).alias("speed"), F.col(f"{prefix}failed_gate").alias("gate"),
        *[F.col(m) for m in margins]))
    agg = df.groupBy(*keys).agg(
        F.max_by(held, F.when(ok & seen, F.col(order))).alias("_floor"),
        F.first(failed, ignorenulls=True).alias("_fail"))
    return agg.select(
        *keys, F.coalesce("_floor", F.lit(float(default))).alias("floor_speed_mps"),
        F.col("_fail.speed").alias("first_failed_speed_mps"),
        F.col("_fail.gate").alias("first_failure_gate"),
        F.col("_fail").isNull().alias("all_speeds_pass"),
        *[F.col(f"_fail.{m}").alias(f"fail_{m}") for m in margins])


def choose_parity(df: DataFrame, keys: Sequence[str], min_strides: int = 20) -> DataFrame:
    """Pick the window parity: the only one with enough strides, else the lowest score."""
    usable = df.where(F.col("kept") > 0)
    short = (F.col("kept") < min_strides).cast("int")
    return top_row(usable, keys, [short, F.col("score"), F.col("parity")], lowest=True)


def common_items(df: DataFrame, group: Sequence[str], item: str, across: str, n_across: int,
                 min_items: int = 4) -> DataFrame:
    """Items present in all ``n_across`` conditions of a group, if the group has enough of them."""
    shared = (df.groupBy(*group, item).agg(F.count_distinct(across).alias("_n"))
              .where(F.col("_n") == n_across).drop("_n"))
    enough = shared.groupBy(*group).agg(F.count("*").alias("n_common")).where(
        F.col("n_common") >= min_items)
    return shared.join(enough, list(group))


def complete_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence,
                   measure: str, how: str = "avg") -> DataFrame:
    """Fixed-column pivot that keeps only keys with every column present."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.expr(f"{how}(`{measure}`)"))
    names = [c for c in wide.columns if c not in keys]
    # quoted, because pivoted names may contain dots
    return wide.where(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names]))


def max_transition(df: DataFrame, keys: Sequence[str], measure: str, order: str,
                   atol: float = 1e-12) -> DataFrame:
    """Row with the largest measure; values within ``atol`` of it tie and the earliest wins."""
    top = df.groupBy(*keys).agg(F.max(measure).alias("_top"))
    tied = df.join(top, list(keys)).where(F.abs(F.col(measure) - F.col("_top")) <= atol).drop("_top")
    return top_row(tied, keys, [F.col(order)], lowest=True)
