"""Draws without replacement over rows, of an exact size, that no task holds whole.

Every row has a hash of the seed and its own name; the rows with the smallest hashes of a group are drawn. Counts by
leading bits of the hash say in which bucket the last one lies, so only that bucket's rows are ordered. The draw depends
on names and seed alone, not on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: leading bits of the hash that are counted
BITS = 14


def drawn(rows: DataFrame, keys: Sequence[str], names: Sequence[str], sizes: DataFrame, seed: Column, bits: int = BITS) -> DataFrame:
    """The rows of ``rows`` that a draw of ``sizes`` (keys, size) takes from each group; all of a group of that size or less.

    ``names`` tell the rows of a group apart, ``seed`` is an expression over the columns of ``rows``. Groups without a
    size, or with one below 1, give no rows.
    """
    keys = list(keys)
    luck = F.xxhash64(seed, *keys, *names)
    marked = rows.withColumns({"_luck": luck, "_bucket": F.shiftright(luck, 64 - bits)})
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    # at most 2 ** bits rows of a group
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    placed = counts.withColumns({"_upto": F.sum("_c").over(upto), "_all": F.sum("_c").over(whole)}).join(sizes, keys)
    size = F.least("size", "_all")
    last = placed.where((F.col("_upto") - F.col("_c") < size) & (size <= F.col("_upto"))).select(
        *keys, F.col("_bucket").alias("_last"), (size - F.col("_upto") + F.col("_c")).alias("_left"))
    met = marked.join(last, keys).where(F.col("_bucket") <= F.col("_last"))
    before = met.where(F.col("_bucket") < F.col("_last"))
    order = Window.partitionBy(*keys).orderBy("_luck", *names)
    edge = met.where(F.col("_bucket") == F.col("_last")).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("_left"))
    return before.select(rows.columns).unionByName(edge.select(rows.columns))
