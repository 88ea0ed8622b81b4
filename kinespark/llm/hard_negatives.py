"""Hard-negative mining: exact integer scores by Strassen products of tiles, and heaps that merge.

Anchors are dealt into blocks and candidates into stripes; a cell is one block against one stripe. Within a cell the
candidates arrive as a stream and are multiplied tile by tile, so a task holds one block of anchors, one tile and the
heaps of its anchors, however long the stripe is. Heaps of different stripes merge: the best few of an anchor are
among the best few of its cells. One pass finds positives (rows meet within their label only), a second one the
negatives inside the windows that the positives set.

Products use only sums, differences and products of 64-bit integers, in which Strassen's scheme is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, query, table

#: anchors of a block (each block is a copy of the candidates in the shuffle), candidates of a tile
BLOCK, TILE = 4096, 1024
#: stripes of n candidates: the root of n over STRIPES, so that stripes grow as well as their number
STRIPES = 16
#: Strassen's scheme stops at matrices with a side of this or less
LEAF = 16
#: squared length of a quantised vector up to which all scores, and 100 times them, fit 64 bits
LARGEST = float(1 << 55)
NONE = np.iinfo(np.int64).min


def _even(x: np.ndarray) -> np.ndarray:
    """``x`` with a row or column of zeros where it has an odd number."""
    m, n = x.shape
    return np.pad(x, ((0, m & 1), (0, n & 1))) if m & 1 or n & 1 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two matrices of 64-bit integers with seven products of halves instead of eight, level by level.

    Odd sides get a row or column of zeros. Sums may pass the 64 bits in between: they wrap around, and the result is
    exact whenever it fits itself.
    """
    m, n = a.shape[0], b.shape[1]
    if min(m, n, a.shape[1]) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    h, k, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :w], b[:k, w:], b[k:, :w], b[k:, w:]
    out = np.empty((2 * h, 2 * w), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:h, :w] = p
    out[h:, w:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[h:, :w] = p
    out[h:, w:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:h, w:] = p
    out[h:, w:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:h, :w] += p
    out[h:, :w] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:h, :w] -= p
    out[:h, w:] += p
    out[h:, w:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:h, :w] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """For every row the ``k`` best (score, id): higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int) -> None:
        self.score, self.id = np.full((rows, k), NONE), np.zeros((rows, k), np.int64)

    def push(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer the columns of ``scores`` (rows, candidates), which carry ``ids``, where ``allowed``."""
        k = self.score.shape[1]
        hit = allowed & (scores >= self.score[:, -1:])
        full = np.flatnonzero(hit.sum(axis=1) > 4 * k)
        if len(full):  # only what reaches the k-th best of the tile can stay
            some = np.where(hit[full], scores[full], NONE)
            hit[full] &= scores[full] >= np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None]
        row, column = np.nonzero(hit)
        self.merge(row, scores[row, column], ids[column])

    def merge(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(row):
            return
        k = self.score.shape[1]
        touched = np.unique(row)
        held = self.score[touched] != NONE
        row = np.concatenate([row, np.repeat(touched, held.sum(axis=1))])
        score, id_ = np.concatenate([score, self.score[touched][held]]), np.concatenate([id_, self.id[touched][held]])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        stay = place < k
        self.score[touched] = NONE
        self.score[row[stay], place[stay]] = score[stay]
        self.id[row[stay], place[stay]] = id_[stay]


def quantised(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(rid, vec_id, label, q) of the rows that take part, with a number of their own: components are floor(256 x).

    Rows with a null id, label, vector or component or a component that is not finite take no part, nor do vectors so
    long that scores would not fit 64 bits (a component of 2^19 and more). Of ids divisible by 7 the label moves on to
    (label + 1) % 10. Other columns are not looked at; an empty table gives an empty table.
    """
    x = F.col("x")
    rows = vectors.select(F.col(f"`{id_}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                          F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 40))))
    rows = rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v * 256)).alias("q"))
    rows = rows.where(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) <= LARGEST)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", moved.alias("label"), "q"))




def _cells(anchors: DataFrame, candidates: DataFrame, group: str | None) -> DataFrame:
    """Both sides dealt to cells (g, block, stripe), a stripe's rows ordered behind the anchors they meet.

    Rows meet inside ``group`` only. Sizes of groups are counted, so that a hot one has more blocks and stripes.
    """
    g = F.lit(0).cast("long") if group is None else F.col(group)
    anchors, candidates = anchors.withColumn("g", g), candidates.withColumn("g", g)
    sizes = candidates.groupBy("g").agg(F.count("*").alias("n")).join(anchors.groupBy("g").agg(F.count("*").alias("a")), "g")
    sizes = bounded(cut(sizes.select("g", F.ceil(F.sqrt("n") / STRIPES).cast("int").alias("stripes"), F.ceil(F.col("a") / BLOCK).cast("int").alias("blocks"))))
    none = F.lit(None).cast("array<long>")
    if "ids" not in anchors.columns:
        anchors = anchors.withColumns({"ids": none, "scores": none})

    def numbers(of: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = anchors.join(sizes, "g").select("g", F.pmod(F.xxhash64("rid"), "blocks").cast("int").alias("block"), numbers("stripes").alias("stripe"),
                                           F.lit(0).alias("side"), "rid", "vec_id", "label", "q", "ids", "scores")
    right = candidates.join(sizes, "g").select("g", numbers("blocks").alias("block"), F.pmod(F.xxhash64("rid"), "stripes").cast("int").alias("stripe"),
                                               F.lit(1).alias("side"), "rid", "vec_id", "label", "q", none.alias("ids"), none.alias("scores"))
    # adaptive execution would join small partitions into few tasks, but tasks multiply here: their number is set
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(tasks, "g", "block", "stripe").sortWithinPartitions("g", "block", "stripe", "side")


def _matrix(rows: pa.Table, columns: int | None = None) -> np.ndarray:
    """Vectors of ``rows`` as a matrix; missing components are 0."""
    q = rows["q"].combine_chunks()
    sizes = np.asarray(q.value_lengths())
    out = np.zeros((len(q), max(int(sizes.max(initial=0)), columns or 0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = q.flatten().to_numpy()
    return out


@dataclass
class _Cell:
    """One block of anchors with what it has seen of its stripe."""

    held: list[pa.Table] = field(default_factory=list)
    tile: list[pa.Table] = field(default_factory=list)
    anchors: pa.Table | None = None

    def add(self, rows: pa.Table) -> None:
        side = rows["side"].to_numpy()
        first = int(np.searchsorted(side, 1))
        if first:
            self.held.append(rows.slice(0, first))
        rows = rows.slice(first)
        while rows.num_rows:
            room = TILE - sum(t.num_rows for t in self.tile)
            self.tile.append(rows.slice(0, room))
            rows = rows.slice(room)
            if sum(t.num_rows for t in self.tile) == TILE:
                self.multiply()

    def multiply(self) -> None:
        if not self.held:  # hashing left the block without an anchor
            self.tile = []
            return
        if self.anchors is None:
            self.anchors = pa.concat_tables(self.held)
            self.begin()
        if not self.tile:
            return
        tile, self.tile = pa.concat_tables(self.tile), []
        b = _matrix(tile, self.a.shape[1])
        a = np.pad(self.a, ((0, 0), (0, b.shape[1] - self.a.shape[1])))
        self.meet(strassen(a, np.ascontiguousarray(b.T)), tile["vec_id"].to_numpy(), tile["label"].to_numpy())

    def begin(self) -> None:
        self.a, self.rid = _matrix(self.anchors), self.anchors["rid"].to_numpy()
        self.vec_id, self.label = self.anchors["vec_id"].to_numpy(), self.anchors["label"].to_numpy()


@dataclass
class _Positives(_Cell):
    """The best rows of the anchor's label."""

    k: int = 5

    def begin(self) -> None:
        super().begin()
        self.heaps = Heaps(len(self.a), self.k)

    def meet(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.heaps.push(scores, (self.label[:, None] == labels) & (self.vec_id[:, None] != ids), ids)

    def found(self) -> list[np.ndarray]:
        row, place = np.nonzero(self.heaps.score != NONE)
        return [self.rid[row], self.heaps.id[row, place], self.heaps.score[row, place]]


@dataclass
class _Negatives(_Cell):
    """For every positive of an anchor, the best rows of other labels inside its window."""

    k: int = 10
    window: tuple[int, int] = (30, 90)

    def begin(self) -> None:
        super().begin()
        ids, scores = self.anchors["ids"].combine_chunks(), self.anchors["scores"].combine_chunks()
        sizes = np.asarray(ids.value_lengths())
        self.real = np.arange(max(int(sizes.max(initial=0)), 1)) < sizes[:, None]
        self.positive, self.score = np.zeros(self.real.shape, np.int64), np.zeros(self.real.shape, np.int64)
        self.positive[self.real], self.score[self.real] = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        self.heaps = [Heaps(len(self.a), self.k) for _ in range(self.real.shape[1])]

    def meet(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        other, hundred, (low, high) = self.label[:, None] != labels, scores * 100, self.window
        for p, heaps in enumerate(self.heaps):
            inside = (hundred >= low * self.score[:, p, None]) & (hundred <= high * self.score[:, p, None])
            heaps.push(scores, other & inside & self.real[:, p, None], ids)

    def found(self) -> list[np.ndarray]:
        out = []
        for p, heaps in enumerate(self.heaps):
            row, place = np.nonzero(heaps.score != NONE)
            out.append([self.rid[row], np.full(len(row), p), heaps.id[row, place], heaps.score[row, place]])
        return [np.concatenate(c) for c in zip(*out)]


def _through_cells(cells: DataFrame, make, schema: str) -> DataFrame:
    """What ``make()`` finds in every cell; cells are streamed, one open at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key = None, None

        def close() -> pa.RecordBatch:
            cell.multiply()
            columns = cell.found() if cell.held else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("g", "block", "stripe")])
            starts = [0, *np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, rows.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                if a == b:
                    continue
                if cell is not None and key != tuple(keys[:, a]):
                    yield close()
                    cell = None
                cell, key = make() if cell is None else cell, tuple(keys[:, a])
                cell.add(rows.slice(a, b - a))
        if cell is not None:
            yield close()
    return cells.mapInArrow(run, schema)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of every key; Spark keeps ``k`` rows of a key in each task before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``quantised`` rows.

    Anchors are the rows whose vec_id is divisible by ``every``; equal anchor rows count once. A score is the inner
    product of two vectors (a shorter one goes on with zeros); higher scores come first, ties by smaller vec_id. The
    positives of an anchor are its best rows of the same label with another vec_id. For each of them the best rows of
    other labels with low * positive score <= 100 * score <= high * positive score are returned. Repeated candidate
    rows count each. An anchor without positives, or a window without rows, gives none; an empty table gives an empty one.
    """
    anchors = cut(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "q"]))
    cells = _cells(anchors, rows, "label")
    found = _through_cells(cells, lambda: _Positives(k=positives), "rid long, id long, score long")
    best = _best(found, ["rid"], positives).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    armed = cut(anchors.join(best, "rid").select("rid", "vec_id", "label", "q", F.col("best.id").alias("ids"), F.col("best.score").alias("scores")))
    cells = _cells(armed, rows, None)
    found = _through_cells(cells, lambda: _Negatives(k=negatives, window=window), "rid long, place long, id long, score long")
    names = armed.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "positive"))
    return _best(found, ["rid", "place"], negatives).join(names, ["rid", "place"]).select(
        "anchor_id", F.col("positive.ids").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("positive.scores").alias("positive_score"), F.col("score").alias("negative_score"))


@query("op13_hard_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, list_dot_product(a.q, c.q)::BIGINT AS score
          FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors of ``embeddings`` against all rows."""
    return mine(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
