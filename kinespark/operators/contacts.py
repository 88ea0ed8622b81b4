"""Step contacts and stride windows from a level signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .segments import last_before, next_after, row_numbers, running_sums

# Contacts of one run that are folded inside a single row; longer runs give the same result by joins.
FOLD_ROWS = 10_000


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
               on: float, off: float, chunk: str | None = None) -> DataFrame:
    """Add ``state`` and ``prev_state`` of an on/off trigger that starts off.

    The state is that of the latest sample outside the band between ``off`` and
    ``on``, so it is a last-non-null lookup rather than a sequential loop.
    """
    if not off < on:
        raise ValueError("the off level must lie below the on level")
    edge = F.when(F.col(value) >= on, 1).when(F.col(value) <= off, 0)
    seen = last_before(df.withColumn("_edge", edge), keys, order, {"_last": F.col("_edge")}, chunk)
    return (seen.withColumn("state", F.coalesce("_edge", "_last", F.lit(0)))
            .withColumn("prev_state", F.coalesce("_last", F.lit(0)))
            .drop("_edge", "_last"))


def contacts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, position: str,
             on: float, off: float, chunk: str | None = None) -> DataFrame:
    """One row (start, end) per completed contact; an unfinished last one is dropped.

    Starts and ends alternate, so a start's end is the position of the next change.
    """
    cols = list(dict.fromkeys([*keys, *order, position, *([chunk] if chunk else [])]))
    changes = (hysteresis(df, keys, order, value, on, off, chunk)
               .where(F.col("state") != F.col("prev_state")).select(*cols, "state"))
    if chunk:
        changes = cut_lineage(changes)  # a small share of the rows, read several times from here on
    paired = next_after(changes, keys, order, {"end": F.col(position)}, chunk)
    extra = [chunk] if chunk else []
    return (paired.where((F.col("state") == 1) & F.col("end").isNotNull())
            .select(*keys, *extra, F.col(position).alias("start"), "end"))


def spaced_contacts(df: DataFrame, keys: Sequence[str], min_gap: float | Column,
                    chunk: str | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Greedy thinning: keep a contact when it starts ``min_gap`` after the last kept one.

    A start at least ``min_gap`` after its predecessor is kept whatever came
    before, so such starts cut each key into independent runs. Runs of at most
    ``fold_rows`` contacts are folded in order; longer ones are followed by
    joins. ``min_gap`` may be an expression over the keys.
    """
    gap = min_gap if isinstance(min_gap, Column) else F.lit(min_gap)
    seen = last_before(df, keys, ["start"], {"_prev": F.col("start")}, chunk)
    if chunk:
        seen = cut_lineage(seen)
    fresh = (F.col("_prev").isNull() | (F.col("start") - F.col("_prev") >= gap)).cast("bigint")
    runs = running_sums(seen, keys, ["start"], {"_run": fresh}, chunk).drop("_prev")
    runs = cut_lineage(runs)
    size = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_size"))
    sized = runs.join(size, [*keys, "_run"])
    short = _fold_runs(sized.where(F.col("_size") <= fold_rows).drop("_size"), keys, gap)
    if not size.where(F.col("_size") > fold_rows).take(1):
        return short
    return short.unionByName(_follow_runs(sized.where(F.col("_size") > fold_rows).drop("_size"), keys, gap))


def _fold_runs(runs: DataFrame, keys: Sequence[str], gap: Column) -> DataFrame:
    extra = [c for c in runs.columns if c not in [*keys, "_run", "start", "end"]]
    item = F.struct("start", "end", *extra)
    folded = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kept = F.aggregate("_items", F.slice("_items", 1, 0), lambda acc, x: F.when(
        F.coalesce(x["start"] - F.try_element_at(acc, F.lit(-1))["start"] >= gap, F.lit(True)),
        F.concat(acc, F.array(x))).otherwise(acc))
    return folded.select(*keys, F.explode(kept).alias("_c")).select(*keys, "_c.*")


def _follow_runs(runs: DataFrame, keys: Sequence[str], gap: Column) -> DataFrame:
    """Thin long runs without ordering them in one task.

    Each start points to the first start at least a gap later; the kept ones are
    those reached from the head of their run. Pointers are doubled every round,
    so a chain of n kept contacts takes log2(n) equi-joins.
    """
    ids = [*keys, "_run"]
    extra = [c for c in runs.columns if c not in [*ids, "start", "end"]]
    # of equal starts the smallest row counts, as in a fold over sorted rows
    rows = runs.groupBy(*ids, "start").agg(F.min(F.struct("end", *extra)).alias("_c"))
    rows = cut_lineage(rows.select(*ids, "start", "_c.*"))
    none = F.lit(None).cast(rows.schema["start"].dataType)
    merged = rows.select(*ids, (F.col("start") + gap).alias("_at"), F.lit(0).alias("_kind"), F.col("start").alias("_src")
                         ).unionByName(rows.select(*ids, F.col("start").alias("_at"), F.lit(1).alias("_kind"), none.alias("_src")))
    merged = merged.withColumn("_part", F.floor(F.col("_at") / (gap * 4096)))
    ahead = next_after(merged, ids, ["_at", "_kind", "_src"], {"to": F.when(F.col("_kind") == 1, F.col("_at"))}, "_part")
    jump = cut_lineage(ahead.where("_kind = 0 AND to IS NOT NULL").select(*ids, F.col("_src").alias("start"), "to"))
    reached = frontier = cut_lineage(rows.groupBy(*ids).agg(F.min("start").alias("start")))
    while True:
        # positions 0..n-1 of every chain are reached; one doubled jump reaches n..2n-1
        frontier = cut_lineage(reached.join(jump, [*ids, "start"]).select(*ids, F.col("to").alias("start")))
        if not frontier.take(1):
            break
        reached = cut_lineage(reached.unionByName(frontier))
        onward = jump.select(*ids, F.col("start").alias("to"), F.col("to").alias("_to"))
        jump = cut_lineage(jump.join(onward, [*ids, "to"]).select(*ids, "start", F.col("_to").alias("to")))
    return rows.join(reached, [*ids, "start"], "left_semi").select(*keys, "start", "end", *extra)


def stride_windows(df: DataFrame, keys: Sequence[str], start: str = "start",
                   chunk: str | None = None) -> DataFrame:
    """Windows [a, b) between every second contact, for both parities.

    ``parity`` 0 takes contacts 0, 2, 4, ... and parity 1 takes 1, 3, 5, ...
    """
    numbered = row_numbers(df, keys, [start], "_rn", chunk).withColumn(
        "parity", ((F.col("_rn") - 1) % 2).cast("int"))
    if chunk:
        numbered = cut_lineage(numbered)
    follow = next_after(numbered, [*keys, "parity"], [start], {"b": F.col(start)}, chunk)
    return (follow.where(F.col("b") > F.col(start))
            .select(*keys, "parity", F.col(start).alias("a"), "b"))
