"""Language identification, word first: known words by their log frequency, others by ever shorter character n-grams.

A word known to the model adds how much its frequency speaks for each language. In an unknown word every position is
scored by the longest known n-gram that begins there. All work is on arrays of code points of a stretch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, cut, query, table
from .text import mix, string_chunks

#: different texts of a language that the model is fitted on, on average at most (chosen by a hash of the text)
PER_LANGUAGE = 3000
#: words, and n-grams of each length, that the model keeps for a language: the most frequent ones
WORDS_KEPT = 20_000
GRAMS_KEPT = 20_000
LONGEST = 4
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Stretch:
    """Words of consecutive texts: ``points`` has a space for everything that is no letter, and spaces around each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        text = np.insert(data, offsets[1:], 32) if len(offsets) > 1 else data
        points = np.frombuffer((b" " + text.tobytes() + b" " * LONGEST).decode().encode("utf-32-le"), "<u4")
        solid = _letters()[points]
        self.points = np.where(solid, points, 32).astype(np.uint64)
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        # the n-th text begins behind n inserted spaces and the leading one; count code points, not bytes
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        self.first_word = np.searchsorted(self.starts, lead + np.arange(len(offsets)) + 1)

    def words(self) -> np.ndarray:
        """Hash of every word, three code points at a time."""
        length = self.ends - self.starts
        h = mix(length.astype(np.uint64))
        live, at = np.arange(len(h)), 0
        while len(live):
            p, left = self.starts[live] + at, length[live] - at
            value = self.points[p]
            for k in (1, 2):
                value = value | np.where(left > k, self.points[np.minimum(p + k, len(self.points) - 1)], 0) << np.uint64(21 * k)
            h[live] = mix(h[live] ^ value)
            live, at = live[left > 3], at + 3
        return h

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For the words ``which``: number of each position's word, and per length the n-grams there (with borders).

        The last array tells how many code points from the position to the space behind the word.
        """
        size = self.ends[which] - self.starts[which] + 1
        owner = np.repeat(np.arange(len(which)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        p = self.starts[which][owner] - 1 + inside
        h, found = np.zeros(len(p), np.uint64), []
        for n in range(LONGEST):
            h = mix(h ^ self.points[p + n] + np.uint64(n << 32))
            found.append(h)
        return owner, found, size[owner] - inside + 1


@dataclass
class Model:
    """Sorted hashes and, row by row, log shares over the languages; ``grams`` by length from 1."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]

    def scores(self, stretch: Stretch) -> np.ndarray:
        """(texts, languages) sums of the evidence of all words."""
        hashes = stretch.words()
        known, rows = _found(self.words[0], hashes)
        fresh, first, inverse = np.unique(hashes[~known], return_index=True, return_inverse=True)
        guessed = self._guess(stretch, np.flatnonzero(~known)[first])
        evidence = np.concatenate([self.words[1], guessed, np.zeros((1, len(self.languages)), np.float32)])
        row = np.empty(len(hashes) + 1, np.int64)
        row[:-1][known] = rows[known]
        row[:-1][~known] = len(self.words[0]) + inverse
        row[-1] = len(evidence) - 1
        lo, hi = stretch.first_word[:-1], stretch.first_word[1:]
        out = np.empty((len(lo), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(evidence[row, k], dtype=np.float64)])
            out[:, k] = total[hi] - total[lo]
        return out

    def _guess(self, stretch: Stretch, which: np.ndarray) -> np.ndarray:
        """Evidence of unknown words: mean over their positions of the longest known n-gram."""
        owner, grams, room = stretch.grams(which)
        out = np.zeros((len(which), len(self.languages)), np.float64)
        count = np.zeros(len(which))
        open_ = np.arange(len(owner))
        for n in range(LONGEST, 0, -1):
            fits = open_[room[open_] >= n]
            known, rows = _found(self.grams[n - 1][0], grams[n - 1][fits])
            hit = fits[known]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner[hit], self.grams[n - 1][1][rows[known], k], minlength=len(which))
            count += np.bincount(owner[hit], minlength=len(which))
            done = np.zeros(len(owner), bool)
            done[hit] = True
            open_ = open_[~done[open_]]
        return (out / np.maximum(count, 1)[:, None]).astype(np.float32)


def _found(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return table_[at] == keys, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, gram, c): kind 0 are words, others n-grams of that length; counts of a stretch of one language."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            own = batch.filter(pa.array([x == lang for x in langs]))
            for _, _, data, offsets in string_chunks(own.column(1)):
                stretch = Stretch(data, offsets)
                _, grams, room = stretch.grams(np.arange(len(stretch.starts)))
                for kind, h in enumerate([stretch.words(), *[g[room > n] for n, g in enumerate(grams)]]):
                    value, c = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array(np.full(len(value), kind, np.int32)),
                         pa.array(value.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "kind", "gram", "c"])


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the doc_id's text leaves 2 modulo 4; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS_KEPT, grams: int = GRAMS_KEPT) -> Model:
    """Model of the labelled rows of ``docs`` (text, lang).

    Equal texts of a language count once. Languages with more than about ``per_language`` different texts are sampled by
    a hash of the text; the tables that come to the driver hold ``words`` words and ``grams`` n-grams of each length for
    a language, whatever the input. Null texts and languages are passed over, and so are languages without any word.
    Without any labelled word the model knows no language.
    """
    named = docs.where("text is not null and lang is not null").select("lang", "text")
    distinct = named.groupBy("lang", F.xxhash64("text").alias("h")).count().groupBy("lang").count().collect()
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in distinct}
    if not share:
        return Model([], (np.zeros(0, np.uint64), np.zeros((0, 0))), [])
    shares = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    luck = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = named.join(F.broadcast(shares), "lang").where(luck < F.col("share")).select("lang", "text").distinct()
    sample = sample.select("lang", F.lower("text").alias("text"))
    counts = sample.mapInArrow(_count, "lang string, kind int, gram long, c long")
    counts = counts.groupBy("lang", "kind", "gram").agg(F.sum("c").alias("c"))
    counts = counts.withColumn("total", F.sum("c").over(Window.partitionBy("lang", "kind")))
    top = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "gram"))
    kept = counts.withColumn("rank", top).where(F.when(F.col("kind") == 0, F.col("rank") <= words).otherwise(F.col("rank") <= grams))
    pdf = kept.select("lang", "kind", "gram", "c", "total").toPandas()
    languages = sorted(pdf["lang"][pdf["kind"] == 0].unique(), key=lambda x: x.encode())
    tables = [_log_shares(pdf[pdf["kind"] == kind], languages) for kind in range(LONGEST + 1)]
    return Model(languages, tables[0], tables[1:])


def _log_shares(pdf, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    gram, row = np.unique(pdf["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    frequency = np.full((len(gram), len(languages)), 0.5)
    total = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = (pdf["lang"] == lang).to_numpy()
        frequency[row[own], k] += pdf["c"].to_numpy()[own]
        if own.any():
            total[k] = pdf["total"].to_numpy()[own][0]
    share = np.log(frequency / (total + 0.5 * len(gram)))
    share -= np.logaddexp.reduce(share, axis=1, keepdims=True) if len(gram) else 0
    return gram, share.astype(np.float32)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text; other columns stay) with ``lang_pred`` and ``score``; columns of these names are replaced.

    The language with the most evidence wins, ties go to the first by code point; ``score`` is its share against the
    others (0 to 1). A null text, one without any letter, and every text if the model knows no language are ``und``
    with score 0. Rows are independent of each other; an empty table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at, docs, schema = appended(docs, "text", {"lang_pred": T.StringType(), "score": T.DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            for first, count, data, offsets in string_chunks(batch.column(batch.num_columns - 1)):
                if not model.languages:
                    break
                stretch = Stretch(data, offsets)
                sums = model.scores(stretch)
                sums -= sums.max(axis=1, keepdims=True)
                share = np.exp(sums)
                some = stretch.first_word[1:] > stretch.first_word[:-1]
                best[first:first + count] = np.where(some, sums.argmax(axis=1), len(model.languages))
                score[first:first + count] = np.where(some, 1 / share.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)],
                                             names=schema.names)
    return docs.withColumn("lower", F.lower(docs.columns[at])).mapInArrow(run, schema)


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, by a model of their labelled rows; ``und`` rows go.

    All columns stay as they are, whatever their names. Null, empty and letterless texts are ``und``; ties of languages go to
    the first by code point, which keeps the row. Rows are judged alone: repeated ones stay or go together, long texts are
    read whole, an empty table stays empty. Without any labelled word every row goes.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    packed = docs.select(F.struct("*").alias("_row"), "text")
    return identify(packed, model).where(F.col("lang_pred") != UNKNOWN).select("_row.*")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
