"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by the ``NEAREST`` reference points that lie nearest to it, in order. Inverted lists give the
vectors that share ``SHARED`` of them: a list stands for that many pivots at once, so that reading it is the same as
counting shared pivots over single lists, without the long lists. What a list brings together is verified by the exact
cosine; vectors of another length have other pivots and lists. A pair in several lists counts in the one of its smallest common pivots. No pairs are written: a list returns
how many links each member has, and one edge for each member of a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, cut, query, sorted_groups, starts_of, table
from .components import connected_components

THRESHOLD = 0.95
#: reference points of a length, taken from a sample of about SAMPLE vectors chosen by hash, no two closer than APART
PIVOTS, SAMPLE, APART = 256, 4096, 0.6
NEAREST, SHARED = 6, 3
#: vectors on one side of a block; longer lists are dealt into blocks, all pairs of which are compared
BLOCK = 1000


def _unit(batch_column: pa.Array, size: int) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> dict[int, np.ndarray]:
    """For each length of ``vectors``, unit reference points of a hash sample; one that is near to an earlier one is passed over.

    Groups of near copies thus give one pivot, however large they are. Lengths of up to ``sample`` vectors are taken whole.
    """
    counts = vectors.groupBy(F.size("embedding").alias("d")).count().collect()
    if not counts:
        return {}
    shares = vectors.sparkSession.createDataFrame([(r["d"], sample / r["count"]) for r in counts], "d int, share double")
    luck = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = vectors.withColumn("d", F.size("embedding")).join(F.broadcast(shares), "d").where(luck < F.col("share")).select(
        "cid", "embedding").collect()
    chosen: dict[int, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: r["cid"]):
        v = np.array(r["embedding"], np.float64)
        v /= np.linalg.norm(v)
        own = chosen.setdefault(len(v), [])
        if len(own) < pivots and (not own or (np.array(own) @ v).max() < apart):
            own.append(v)
    return {d: np.array(own) for d, own in chosen.items()}


def _describe(of_length: dict[int, np.ndarray]):
    """(cid, w, d, unit, mask, key): the vector, its length, its nearest pivots as a bitmap, and a row for each list it is in."""
    words = max(-(-len(pivots) // 64) for pivots in of_length.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                batch, pivots = whole.filter(pa.array(sizes == d)), of_length[d]
                yield one_length(batch, d, pivots)

    def one_length(batch: pa.RecordBatch, d: int, pivots: np.ndarray) -> pa.RecordBatch:
        near = min(NEAREST, len(pivots))
        picks = np.array(list(combinations(range(near), min(SHARED, near))))
        unit = _unit(batch.column(2), d)
        order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :near]
        ids = np.sort(order, axis=1)
        mask = np.zeros((len(ids), words), np.uint64)
        for c in range(near):
            np.bitwise_or.at(mask, (np.arange(len(ids)), ids[:, c] // 64), np.uint64(1) << (ids[:, c] % 64).astype(np.uint64))
        key = np.zeros((len(ids), len(picks)), np.int64)
        for c in range(picks.shape[1]):
            key = key << 20 | ids[:, picks[:, c]]
        flat = pa.array(key.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(picks)), flat)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.full(len(ids), d, np.int32)), pa.array([x.tobytes() for x in unit], pa.binary()),
             pa.array([x.tobytes() for x in mask], pa.binary()), lists], names=["cid", "w", "d", "unit", "mask", "keys"])
    return run


def _compare(shared: dict[int, int]):
    """(cid, n, root): links of a class found in a block, and the class that stands for its component there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["d", "key", "i", "j"]):
            d, key, i, j, cid, w, at = (part[c].to_numpy() for c in ("d", "key", "i", "j", "cid", "w", "at"))
            flat, mask = binaries(part["unit"], np.float64), np.array(binaries(part["mask"], np.uint64))
            cuts, out, length = starts_of(d, key, i, j), [], None
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if d[lo] != length:  # rows are ordered by length
                    length, base = d[lo], lo
                    unit = np.array(flat[base:np.searchsorted(d, length, side="right")])
                left = lo + np.flatnonzero(at[lo:hi] == i[lo])
                right = lo + np.flatnonzero(at[lo:hi] == j[lo])
                close = unit[left - base] @ unit[right - base].T >= THRESHOLD
                if i[lo] == j[lo]:
                    close = np.triu(close, 1)
                a, b = np.nonzero(close)
                if not len(a):
                    continue
                a, b = left[a], right[b]
                own = _smallest_common(int(key[lo]), mask[a], mask[b], shared[int(length)])
                n = np.bincount(a[own] - lo, w[b[own]], hi - lo) + np.bincount(b[own] - lo, w[a[own]], hi - lo)
                root = np.arange(hi - lo)
                while True:
                    low = root.copy()
                    np.minimum.at(low, a - lo, root[b - lo])
                    np.minimum.at(low, b - lo, root[a - lo])
                    if (low == root).all():
                        break
                    root = low
                some = np.unique(np.concatenate([a, b])) - lo
                out.append((cid[lo + some], n[some].astype(np.int64), cid[lo + root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                                 names=["cid", "n", "root"])
    return run


def _smallest_common(key: int, a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Whether the pivots of ``key`` are the smallest that both vectors share."""
    last = key & ((1 << 20) - 1)
    below = np.array([min(max(last + 1 - 64 * k, 0), 64) for k in range(a.shape[1])])
    window = np.array([(1 << int(n)) - 1 for n in below], np.uint64)
    common = np.bitwise_count(a & b & window).sum(axis=1)
    return common == shared


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding).

    Links are pairs with a cosine of 0.95 or more in double precision; equal vectors are compared as one, with their
    number. A vector that is null, empty or zero, or holds a null or a value that is not finite, links with nothing and
    is its own component. Vectors of every length are indexed, and link with vectors of their own length. Repeated rows are vectors of their own. A null vec_id is the
    component only if all of it are null, and is not kept. An empty table gives an empty table.
    """
    e = F.col("embedding")
    good = (e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(e, lambda x: x != 0))
    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    cid = F.xxhash64("embedding", F.size("embedding"))
    known = narrow.where("good").withColumn("cid", cid)
    classes = cut(known.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("embedding").alias("embedding")))
    pivots = choose_pivots(classes)
    one = narrow.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not pivots:
        return one.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    described = cut(classes.select("cid", "w", "embedding").mapInArrow(
        _describe(pivots), "cid long, w long, d int, unit binary, mask binary, keys array<long>"))
    postings = described.select("cid", "d", F.explode("keys").alias("key"))
    lists = postings.groupBy("d", "key").agg(F.count("*").alias("c")).where("c > 1")
    lists = lists.select("d", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    dealt = postings.join(lists, ["d", "key"]).withColumn("at", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "d", "key", "cid", "at", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))
    met = dealt.join(described.drop("keys", "d"), "cid")
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(met.repartition(shuffle, "d", "key", "i", "j").sortWithinPartitions("d", "key", "i", "j").mapInArrow(
        _compare({d: min(SHARED, NEAREST, len(own)) for d, own in pivots.items()}), "cid long, n long, root long"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "rep", "w").join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "component").select("cid", "component_id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    some = known.select("vec_id", "cid").join(named, "cid").select("vec_id", "n_links", "component_id")
    return some.unionByName(one).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
