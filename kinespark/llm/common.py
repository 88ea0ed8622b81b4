"""Shared pieces: registry of the subpackage, lineage cuts, size-checked broadcasts, streams of sorted groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: a side of a join is broadcast only if it is counted and has no more rows than this
BROADCAST_ROWS = 500_000

#: ASCII whitespace and words, as Java and RE2 patterns
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that later jobs neither recompute nor depend on one executor."""
    return cut_lineage(df)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table bucketed and sorted by ``key`` in the shared folder, and a function that drops it.

    Equi-joins on ``key`` read it where it lies: it is neither shuffled nor sorted again.
    """
    spark = df.sparkSession
    name = f"kinespark_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}")

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.table(name), drop


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` narrow rows; otherwise the planner shuffles it.

    ``df`` is counted, so it should be checkpointed or cheap. Both ways give the same rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words_in(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def dense(text) -> F.Column:
    """Text without ASCII whitespace; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def appended(df: DataFrame, read: str, new: dict[str, T.DataType]) -> tuple[int, DataFrame, T.StructType]:
    """Place of column ``read``, ``df`` under plain names without the columns of ``new``, and the schema with those at the end.

    A function over Arrow batches takes these: columns of any name, dots included, then pass it.
    """
    stay = [i for i, c in enumerate(df.columns) if c not in new]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in stay])
    schema = T.StructType([*[df.schema.fields[i] for i in stay], *[T.StructField(n, t) for n, t in new.items()]])
    return [df.columns[i] for i in stay].index(read), plain, schema


def binaries(column: pa.Array, dtype) -> list[np.ndarray]:
    """The rows of a binary column as arrays that share its memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = buffers[2] if buffers[2] is not None else b""
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(data, dtype, int(b - a) // size, int(a)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that arrive ordered by ``keys``; only an open group is carried on.

    A table holds all complete groups of what has arrived, so that callers can work on many groups at once.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        last = [part[k][-1] for k in keys]
        changed = np.zeros(part.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            changed |= part[k].combine_chunks().to_numpy(zero_copy_only=False) != v.as_py()
        cut_at = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        if not cut_at and held and any(held[-1][k][-1] != v for k, v in zip(keys, last, strict=True)):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut_at:
            held.append(part.slice(0, cut_at))
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(part.slice(cut_at))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows, with the row count at the end."""
    n = len(columns[0])
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(fresh), n)
