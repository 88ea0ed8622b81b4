"""Best-fit packing under conflicts: a bin holds no two documents of one source or of one cluster of copies.

Bins are ordered by what is left in them and carry bitmaps of their sources and clusters. A piece goes to the tightest
bin that it fits and that has neither bit; the search goes on from the first bin that is large enough until such a bin
is found. Documents are dealt at random into cells of bounded size, each packed by one task, so that a source or a
cluster with a third of all rows is spread over all cells.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dense, query, table, words_in

#: words of a bin
CAPACITY = 2048
#: documents of a cell, on average
CELL = 4096

_SCHEMA = "doc_id long, copy int, piece int, start_word long, n_words long, bin_id long"


def best_fit(pieces: list[tuple[int, int, int | None]], capacity: int) -> list[int]:
    """Bin of each piece (size, source number, cluster number or None), taken in the given order."""
    bins: list[tuple[int, int]] = []  # (what is left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster in pieces:
        source_bit, cluster_bit = 1 << source, 0 if cluster is None else 1 << cluster
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (sources[bins[at][1]] & source_bit or clusters[bins[at][1]] & cluster_bit):
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source_bit
        clusters[b] |= cluster_bit
        if left > size:
            insort(bins, (left - size, b))
        placed.append(b)
    return placed


def _numbers(values: list) -> dict:
    return {v: i for i, v in enumerate(dict.fromkeys(values))}


def _pack(capacity: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        doc, copy, piece, start, size, source, cluster = (rows[c].to_pylist() for c in (
            "doc_id", "copy", "piece", "start_word", "n_words", "source", "cluster"))
        order = sorted(range(len(doc)), key=lambda i: (-size[i], cluster[i], doc[i] is None, doc[i] or 0, piece[i], copy[i]))
        # a cluster with one piece here cannot conflict, so that bitmaps stay as short as the real clusters are few
        seen: dict = {}
        for c in cluster:
            seen[c] = seen.get(c, 0) + 1
        source_number, cluster_number = _numbers(source), _numbers([c for c in cluster if seen[c] > 1])
        bins = best_fit([(size[i], source_number[source[i]], cluster_number.get(cluster[i])) for i in order], capacity)
        base = key[0].as_py() << 32
        take = pa.array(order, pa.int64())
        out = rows.select(["doc_id", "copy", "piece", "start_word", "n_words"]).take(take)
        return out.append_column("bin_id", pa.array([base + b for b in bins], pa.int64()))
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(doc_id, copy, piece, start_word, n_words, bin_id) for every piece of every row of ``docs`` (doc_id, source, text).

    Documents are cut into pieces of ``capacity`` words, so that all but the last piece fill a bin. Copies are documents
    whose texts are identical without ASCII whitespace; the pieces of one document count as copies too. Null is a source
    of its own. Repeated rows are numbered by ``copy`` from 1. A null, empty or wordless text has one row with no words
    and a null bin. The result is the same in every run; an empty table gives an empty table.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(text).alias("size"),
                       F.xxhash64(dense(text)).alias("cluster"))
    # identical rows are counted before they are numbered: however many there are, no task has them all
    units = cut(rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("c")))
    total = units.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    cells = max(1, -(-total // cell))
    units = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).drop("c")
    units = units.withColumn("cell", F.pmod(F.xxhash64("doc_id", "source", "size", "cluster", "copy"), F.lit(cells)))
    last = F.ceil(F.col("size") / capacity).cast("int") - 1
    pieces = units.where("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("start_word", F.col("piece").cast("long") * capacity).withColumn(
        "n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_word")))
    packed = pieces.groupBy("cell").applyInArrow(_pack(capacity), _SCHEMA)
    empty = units.where("size = 0").select("doc_id", "copy", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"),
                                           F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("long").alias("bin_id"))
    return packed.unionByName(empty)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
