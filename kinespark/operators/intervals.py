"""Samples and windows that meet by chunk, so that neither a key's samples nor its windows are ever held whole.

Places are cut into chunks of ``width``. A window stands in every chunk it reaches into; it meets a chunk's samples by
an equi-join on (key, chunk), and what it gets there is a partial result. Partial results of a window are combined
before they are shuffled. A long signal, and a key with very many windows, spread over as many tasks as they have chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reached(windows: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """A row of each window for every chunk it reaches into; an empty window reaches none."""
    chunks = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))
    return windows.where(F.col(stop) > F.col(start)).withColumn("_chunk", F.explode(chunks))


def interval_join(samples: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Pairs of a sample and a window of the same keys with ``start <= at < stop``; whole places, columns of both sides."""
    placed = samples.withColumn("_chunk", F.floor(F.col(at) / width))
    met = placed.join(_reached(windows, start, stop, width), [*keys, "_chunk"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_chunk")


def chunked(rows: DataFrame, keys: Sequence[str], values: str, width: int) -> DataFrame:
    """Signals as rows (keys, chunk, values) of at most ``width`` values."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), lambda i: F.slice(values, i * width + 1, F.lit(width)))
    return rows.where(F.size(values) > 0).select(*keys, F.posexplode(parts).alias("chunk", "values"))


def window_sums(chunks: DataFrame, windows: DataFrame, keys: Sequence[str], names: Sequence[str], width: int, value=lambda v: v,
                signal: Sequence[str] = ()) -> DataFrame:
    """(keys, signal, names, total, n): sum of ``value`` over the samples ``a <= place < b`` of each window, and their number.

    ``chunks`` are ``chunked`` signals of (keys, signal); ``windows`` has (keys, names, a, b). Windows that reach no
    sample are left out.
    """
    met = chunks.withColumn("_chunk", F.col("chunk").cast("long")).join(_reached(windows, "a", "b", width), [*keys, "_chunk"])
    first = F.greatest(F.lit(0), F.col("a") - F.col("_chunk") * width)
    last = F.least(F.size("values"), F.col("b") - F.col("_chunk") * width)
    part = F.slice("values", (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    parts = met.where(last > first).select(*keys, *signal, *names, F.aggregate(part, F.lit(0.0), lambda s, v: s + value(v)).alias("_s"),
                                           (last - first).cast("long").alias("_n"))
    return parts.groupBy(*keys, *signal, *names).agg(F.sum("_s").alias("total"), F.sum("_n").alias("n"))
