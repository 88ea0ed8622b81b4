"""Ordered scans that never put a whole key into one task.

Each scan takes a ``chunk`` column that does not decrease along the order
(an hour of an event time, a thousand sample indexes). Rows are ordered only
inside (key, chunk); what a chunk owes to its neighbours is a single carried
value per (key, chunk), computed from map-side aggregates. ``chunk=None`` means
the caller knows the groups to be small and wants one ordinary window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)

Named = dict[str, Column]


def _window(keys: Sequence[str], order: Sequence[str], rows: tuple[int, int]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows)


def _reversed(keys: Sequence[str], order: Sequence[str]):
    """What lies after a row, seen backwards: a frame that grows is evaluated once, one that shrinks anew for each row."""
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*BEFORE)


def _scan_chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Named, before: Named,
                  after: Named, chunk: str) -> DataFrame:
    place = F.struct(*order)

    def edge(pick, value: Column) -> Column:
        return pick(value, F.when(value.isNotNull(), place))

    # one map-side combined row per (key, chunk): its sums, its last and its first value
    parts = df.groupBy(*keys, chunk).agg(
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[edge(F.max_by, e).alias(f"_b_{n}") for n, e in before.items()],
        *[edge(F.min_by, e).alias(f"_a_{n}") for n, e in after.items()])
    past, future = _window(keys, [chunk], BEFORE), _reversed(keys, [chunk])
    carry = parts.select(
        *keys, chunk, *[F.sum(f"_s_{n}").over(past).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_b_{n}", True).over(past).alias(f"_b_{n}") for n in before],
        *[F.last(f"_a_{n}", True).over(future).alias(f"_a_{n}") for n in after])
    inside = [*keys, chunk]
    upto, local_past, local_future = _window(inside, order, UPTO), _window(inside, order, BEFORE), _reversed(inside, order)

    def total(n: str, e: Column) -> Column:
        here, earlier = F.sum(e).over(upto), F.col(f"_s_{n}")
        return F.coalesce(here + earlier, here, earlier).alias(n)

    return df.join(carry, inside, "left").select(
        *df.columns, *[total(n, e) for n, e in sums.items()],
        *[F.coalesce(F.last(e, True).over(local_past), F.col(f"_b_{n}")).alias(n) for n, e in before.items()],
        *[F.coalesce(F.last(e, True).over(local_future), F.col(f"_a_{n}")).alias(n) for n, e in after.items()])


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Named | None = None,
                 before: Named | None = None, after: Named | None = None, chunk: str | None = None) -> DataFrame:
    """Add columns that depend on the order of each key's rows.

    ``sums``: inclusive running sums. ``before``: the last non-null value
    strictly before the row. ``after``: the first non-null value strictly after.
    """
    sums, before, after = sums or {}, before or {}, after or {}
    if chunk is not None:
        return _scan_chunked(df, keys, order, sums, before, after, chunk)
    upto, past, future = _window(keys, order, UPTO), _window(keys, order, BEFORE), _reversed(keys, order)
    return df.select("*", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
                     *[F.last(e, True).over(past).alias(n) for n, e in before.items()],
                     *[F.last(e, True).over(future).alias(n) for n, e in after.items()])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Named,
                 chunk: str | None = None) -> DataFrame:
    return ordered_scan(df, keys, order, sums=sums, chunk=chunk)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                chunk: str | None = None) -> DataFrame:
    """1-based position of each row in its key."""
    return ordered_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, chunk=chunk)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Named,
                chunk: str | None = None) -> DataFrame:
    return ordered_scan(df, keys, order, before=values, chunk=chunk)


def next_after(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Named,
               chunk: str | None = None) -> DataFrame:
    return ordered_scan(df, keys, order, after=values, chunk=chunk)
