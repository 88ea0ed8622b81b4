"""Masked pseudo-likelihood: a small bidirectional window network predicts every word from both of its sides.

All words of all documents are counted. The most frequent ones have an id of their own, and how many do rises with the
number of distinct words. The others share ids by hash: such a word has the probability of its id times its part of
the words that were counted for the id, so that the words of an id divide its probability among them. Training goes over all documents as well: in a round every task starts
from the same parameters, trains on the masked positions of its documents, and the results are averaged by the number
of those positions, in a tree of bounded fan-in. The rounds divide all positions among them: every word of every document
is predicted once, from both of its sides. A document's score is the sum of the log-probabilities of its words,
each given the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, cut, query, table
from .text import mix, string_chunks, word_bounds, word_hashes

#: ids are SIDE classes of SIDE members at least; about SPREAD times the root of the number of distinct words if that is more
SIDE, SPREAD = 32, 1.0
#: one id in SHARED is shared by hash, by words that have no id of their own
SHARED = 16
#: words looked at on either side, and units of the hidden layer
REACH, HIDDEN = 2, 24
#: rounds of training; every position is masked in one of them
ROUNDS = 2
BATCH, RATE = 2048, 0.1
SEED = 11
#: parameter sets that one task averages
FAN_IN = 64


def _known(side: int) -> int:
    """Words with an id of their own among side * side ids; the id behind the last stands beyond the ends of a text."""
    return side * side - side * side // SHARED


def _side(words: tuple[np.ndarray, np.ndarray]) -> int:
    """Classes, and members of a class, of the ids of a vocabulary."""
    side = SIDE
    while _known(side) < len(words[0]):
        side += 4
    return side


def _shapes(side: int) -> list[tuple[int, ...]]:
    return [(2 * REACH, side * side + 1, HIDDEN), (HIDDEN,), (HIDDEN, side), (side,), (HIDDEN, side), (side, side)]


class Network:
    """Sum of one row per neighbour, a tanh, then the class of the word and its member of the class."""

    def __init__(self, flat: np.ndarray | None = None, side: int = SIDE) -> None:
        sizes = [int(np.prod(s)) for s in _shapes(side)]
        if flat is None:
            flat = np.random.default_rng(SEED).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat, self.side = flat, side
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        self.near, self.bias, self.to_class, self.class_bias, self.to_member, self.member_bias = (
            p.reshape(s) for p, s in zip(parts, _shapes(side), strict=True))

    def _forward(self, around: np.ndarray, word: np.ndarray):
        h = self.bias + np.take(self.near[0], around[0], axis=0)
        for k in range(1, 2 * REACH):
            h += np.take(self.near[k], around[k], axis=0)
        np.tanh(h, out=h)
        c = word // self.side
        return h, h @ self.to_class + self.class_bias, h @ self.to_member + self.member_bias[c], c

    def log_prob(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        _, a, b, c = self._forward(around, word)
        return _log_share(a, c) + _log_share(b, word % self.side)

    def step(self, around: np.ndarray, word: np.ndarray, past: "Network") -> None:
        """One step of adaptive gradient descent; ``past`` holds the sums of squared gradients."""
        h, a, b, c = self._forward(around, word)
        n, at = len(word), np.arange(len(word))
        da, db = _softmax(a), _softmax(b)
        da[at, c] -= 1
        db[at, word % self.side] -= 1
        da /= n
        db /= n
        dz = (da @ self.to_class.T + db @ self.to_member.T) * (1 - h * h)
        which = np.zeros_like(da)
        which[at, c] = 1
        one = np.ones(n, np.float32)
        dense = ((self.bias, past.bias, one @ dz), (self.to_class, past.to_class, h.T @ da), (self.class_bias, past.class_bias, one @ da),
                 (self.to_member, past.to_member, h.T @ db), (self.member_bias, past.member_bias, which.T @ db))
        for value, squares, grad in dense:
            squares += grad * grad
            value -= RATE * grad / (np.sqrt(squares) + 1e-6)
        # the rows of all neighbours at once: place k has its own stretch of row numbers
        places, width = self.near.shape[:2]
        rows = (around + np.arange(places)[:, None] * width).ravel()
        order = _order(rows)
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        grad = np.add.reduceat(np.take(dz, order % n, axis=0), first, axis=0)
        rows = rows[first]
        near, sums = self.near.reshape(places * width, -1), past.near.reshape(places * width, -1)
        squares = sums[rows] + grad * grad
        sums[rows] = squares
        near[rows] -= RATE * grad / (np.sqrt(squares) + 1e-6)


def _order(ids: np.ndarray) -> np.ndarray:
    """Stable order; short numbers are ordered by their digits."""
    return np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")


def _bounded(x: np.ndarray) -> np.ndarray:
    """Rows of ``x``, shifted if an exponential of theirs could leave the range of its type."""
    if x.size and (x.max() > 60 or x.min() < -60):
        x -= x.max(axis=1, keepdims=True)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(_bounded(x), out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_share(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its ``which``."""
    own = _bounded(x)[np.arange(len(x)), which].astype(np.float64)
    return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row) of stretches of texts."""
    for first, _, data, offsets in string_chunks(column):
        starts, ends, before = word_bounds(data, offsets)
        yield first, word_hashes(data, starts, ends), before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [h for _, h, _ in _hashes(batch.column(0))]
        word, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of ``docs`` (text) by its hash, written to the shared folder."""
    counts = docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(counts)


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, ids) of the words with an id of their own: the most frequent ones, id 0 the most frequent of all.

    Their number rises with the number of distinct words. ``counts`` are the ``word_counts`` of ``docs`` if they are there.
    """
    counts = word_counts(docs) if counts is None else counts
    side, distinct = SIDE, counts.count()
    while side * side < SPREAD * distinct ** 0.5:
        side += 4
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(_known(side)).collect()]
    words = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], order.astype(np.int64)


def _ids(hashes: np.ndarray, vocabulary_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    words, ids = vocabulary_
    side = _side(vocabulary_)
    out = (_known(side) + hashes % np.uint64(side * side - _known(side))).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        hit = words[at] == hashes
        out[hit] = ids[at[hit]]
    return out


def shared_counts(counts: DataFrame, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For every id, how often the words that share it were counted; 0 for an id of one word."""
    vocabulary_, known = counts.sparkSession.sparkContext.broadcast(words), _known(_side(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_side(words) ** 2, np.int64)
        for batch in batches:
            ids = _ids(batch.column(0).to_numpy().view(np.uint64), vocabulary_.value)
            np.add.at(total, ids, batch.column(1).to_numpy())
        some = known + np.flatnonzero(total[known:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])
    out = np.zeros(_side(words) ** 2, np.int64)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _neighbours(ids: np.ndarray, before: np.ndarray, edge: int, at: np.ndarray | None = None) -> np.ndarray:
    """(2 * REACH, words) ids around each word, or the words at ``at``; beyond the ends of its text there is the edge."""
    at = np.arange(len(ids)) if at is None else at
    rows = np.searchsorted(before, at, side="right") - 1 if len(at) < len(ids) else np.repeat(np.arange(len(before) - 1), np.diff(before))
    lo, hi = before[:-1][rows], before[1:][rows]
    out = np.full((2 * REACH, len(at)), edge, np.int64)
    for k, shift in enumerate([s for s in range(-REACH, REACH + 1) if s]):
        inside = (at + shift >= lo) & (at + shift < hi)
        out[k, inside] = ids[at[inside] + shift]
    return out


def _masked(hashes: np.ndarray, before: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Positions whose word is predicted in round ``turn``; the rounds together have each position once."""
    place = np.arange(len(hashes)) - np.repeat(before[:-1], np.diff(before))
    luck = mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(rounds)
    return np.flatnonzero(luck == turn)


def _train(words, start, turn: int, rounds: int):
    """Parameters of a task after its masked positions, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(start.value.copy(), _side(words.value))
        past = Network(np.zeros_like(net.flat), net.side)
        trained, held = 0, []

        def learn(least: int) -> None:
            nonlocal held, trained
            while sum(len(w) for _, w in held) >= max(least, 1):
                around, word = np.concatenate([a for a, _ in held], axis=1), np.concatenate([w for _, w in held])
                for k in range(0, len(word) - least + 1, BATCH):
                    net.step(around[:, k:k + BATCH], word[k:k + BATCH], past)
                done = len(word) if least <= 1 else len(word) // BATCH * BATCH
                trained += done
                held = [(around[:, done:], word[done:])] if done < len(word) else []
        for batch in batches:
            for _, hashes, before in _hashes(batch.column(0)):
                ids = _ids(hashes, words.value)
                masked = _masked(hashes, before, turn, rounds)
                held.append((_neighbours(ids, before, net.side ** 2, masked), ids[masked]))
                learn(BATCH)
        learn(1)
        if trained:
            yield _parameters(TaskContext.get().partitionId(), trained, net.flat)
    return run


def _parameters(part: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
                                      names=["part", "n", "flat"])


def _average(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")  # the sum does not depend on the order of arrival
    n, total = rows["n"].to_numpy(), 0.0
    for k, flat in zip(n, binaries(rows["flat"], np.float32), strict=True):
        total = total + flat.astype(np.float64) * k
    return pa.Table.from_batches([_parameters(key[0].as_py(), int(n.sum()), (total / n.sum()).astype(np.float32))])


def train(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Network:
    """Network trained on all of ``docs`` (text). Without any word the parameters stay as they begin."""
    context = docs.sparkSession.sparkContext
    vocabulary_, net = context.broadcast(words), Network(side=_side(words))
    schema = "part long, n long, flat binary"
    for turn in range(rounds):
        found = cut(docs.select("text").mapInArrow(_train(vocabulary_, context.broadcast(net.flat), turn, rounds), schema))
        tasks = (found.agg(F.max("part")).first()[0] or 0) + 1
        while tasks > 1:
            found = found.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("up").applyInArrow(_average, schema)
            tasks = -(-tasks // FAN_IN)
        last = found.collect()
        if last:
            net = Network(np.frombuffer(last[0]["flat"], np.float32).copy(), net.side)
    return net


def _log_probs(net: Network, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Log-probability of the id of every word given the ids around it."""
    around, value = _neighbours(ids, before, net.side ** 2), np.empty(len(ids))
    for k in range(0, len(ids), 1 << 12):
        value[k:k + (1 << 12)] = net.log_prob(around[:, k:k + (1 << 12)], ids[k:k + (1 << 12)])
    return value


def score(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], net: Network) -> DataFrame:
    """``docs`` (text; other columns stay) with ``n_words``, ``log_prob`` and ``mean_log_prob`` (replaced if there).

    ``log_prob`` sums the log-probability of the id of every word of the whole text given its neighbours; words that
    share an id are not told apart (``score_words`` does). A null, empty or wordless text has none: 0, 0.0 and null.
    Rows are independent; an empty table gives an empty table.
    """
    context = docs.sparkSession.sparkContext
    vocabulary_, flat, side = context.broadcast(words), context.broadcast(net.flat), net.side
    docs = docs.drop("n_words", "log_prob", "mean_log_prob")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()),
                           T.StructField("mean_log_prob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat.value, side)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, hashes, before in _hashes(batch.column(at)):
                sums = np.concatenate([[0.0], np.cumsum(_log_probs(net, _ids(hashes, vocabulary_.value), before))])
                n[first:first + len(before) - 1] = np.diff(before)
                total[first:first + len(before) - 1] = sums[before[1:]] - sums[before[:-1]]
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(total), mean], names=schema.names)
    return docs.mapInArrow(run, schema)


def score_words(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], net: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row of ``docs`` (doc_id, text), as ``score`` has them, but of words.

    A word that shares its id has the probability of the id times n / (N + 1): n is how often the word was counted,
    N how often all words of the id were. A word that was never counted has the 1 / (N + 1) that is left. The words of
    a document meet their counts in a join by word; each stretch of texts names a word once, with its rows.
    """
    context, known = docs.sparkSession.sparkContext, _known(net.side)
    vocabulary_, flat, side = context.broadcast(words), context.broadcast(net.flat), net.side
    among = context.broadcast(np.log(shared_counts(counts, words) + 1.0))
    docs = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("rows", T.ArrayType(T.LongType())), docs.schema["doc_id"],
                           T.StructField("n_words", T.LongType()), T.StructField("base", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(flat.value, side), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, hashes, before in _hashes(batch.column(1)):
                ids = _ids(hashes, vocabulary_.value)
                sums = np.concatenate([[0.0], np.cumsum(_log_probs(net, ids, before) - among.value[ids])])
                size = len(before) - 1
                row = seen + first + np.arange(size)
                # a row for each document; its number is spread, so that it meets no word and no other row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(row.astype(np.uint64)).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(row)),
                     batch.column(0).slice(first, size), pa.array(np.diff(before)), pa.array(sums[before[1:]] - sums[before[:-1]])],
                    names=schema.names)
                shared = np.flatnonzero(ids >= known)
                if not len(shared):
                    continue
                shared = shared[np.argsort(hashes[shared], kind="stable")]
                word = hashes[shared]
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                rows = pa.array(np.repeat(row, np.diff(before))[shared])
                none = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[starts].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)).astype(np.int32)), rows),
                     pa.nulls(none, batch.column(0).type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.float64())], names=schema.names)
            seen += batch.num_rows
    often = counts.where("n > 1").select("word", F.log(F.col("n").cast("double")).alias("more"))  # a single one adds log 1
    met = docs.mapInArrow(run, schema).join(often, "word", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    # a document's row is its own; should it meet a word's number, that word's count is not taken for it
    parts = met.select(F.explode("rows").alias("row"), "doc_id", "n_words", F.coalesce("base", "more").alias("part"))
    done = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("part").alias("log_prob"))
    return done.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs)
    words = vocabulary(docs, counts)
    return score_words(docs, words, train(docs, words), counts)
