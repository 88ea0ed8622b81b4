"""SentencePiece encoding and decoding of whole texts with a published BPE model that falls back to bytes.

Encoding is exact by backtracking. One Aho-Corasick pass over a unit of text finds the longest piece that starts at each
place. Pieces are laid from left to right, longest first; two neighbours may stand side by side only if merging the
characters of both again gives the same two pieces, and a place from which nothing could be laid is marked in a bit
field, so that no place is tried twice. A sequence whose neighbours all pass is the one that merging the whole text
gives, because a merge across a border would already show in the two pieces beside it.

A text is cut into units where no piece reaches across, so that no merge does either: before each run of spaces, and
between letters and other characters. Both are checked against all pieces when a model is loaded; characters that stand
in a piece across such a cut are not taken for letters. Units that were met before are looked up.
"""

from __future__ import annotations

import codecs
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, query, table

MODEL = "piece_bpe_32k.model"
#: what a model writes for a space
SPACE = "▁"
#: units and pairs of pieces a worker remembers, and the longest unit it remembers
REMEMBERED, LONGEST = 1 << 18, 64
#: ids handled at once
CHUNK = 1 << 20
#: units joined at once
STRETCH = 1 << 16


@dataclass(frozen=True)
class Pieces:
    """The vocabulary of a model: ``names`` by id, ``scores`` of those that merging can make, ids of the 256 bytes."""

    names: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    bytes_: list[int]
    silent: frozenset[int]
    unknown: int
    unit: str

    @staticmethod
    def load(path: str) -> "Pieces":
        """Vocabulary of a model file. Models of another kind, or that change texts beforehand, are refused."""
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind, norm = proto.ModelProto.SentencePiece, model.normalizer_spec
        plain = (norm.add_dummy_prefix and norm.escape_whitespaces and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
                 and not model.trainer_spec.treat_whitespace_as_suffix and not model.denormalizer_spec.precompiled_charsmap)
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain:
            raise ValueError(f"{path}: not a BPE model with byte fallback over unchanged text")
        names = [p.piece for p in model.pieces]
        kinds = {k: [i for i, p in enumerate(model.pieces) if p.type == k] for k in {p.type for p in model.pieces}}
        if kinds.get(kind.USER_DEFINED) or kinds.get(kind.UNUSED):
            raise ValueError(f"{path}: user-defined and unused pieces are not known here")
        scores = {names[i]: model.pieces[i].score for i in kinds[kind.NORMAL]}
        if any(re.search(f"[^{SPACE}]{SPACE}", name) for name in scores):
            raise ValueError(f"{path}: a piece holds a space behind another character")
        bytes_ = {int(names[i][3:5], 16): i for i in kinds[kind.BYTE]}
        return Pieces(names, scores, {names[i]: i for i in kinds[kind.NORMAL]}, [bytes_[b] for b in range(256)],
                      frozenset(kinds.get(kind.CONTROL, [])), kinds[kind.UNKNOWN][0], _unit_pattern(scores))


def _unit_pattern(names: Iterable[str]) -> str:
    """Pattern of the units of a text: a run of letters or of other characters, with the spaces before it.

    Characters count as letters only while no piece has one beside a character that is none.
    """
    beside = {pair for name in names for pair in zip(name, name[1:]) if SPACE not in pair}
    odd = ""
    while True:
        letter = re.compile(f"[^\\W\\d_{re.escape(odd)}]")
        mixed = {a if letter.match(a) else b for a, b in beside if bool(letter.match(a)) != bool(letter.match(b))}
        if not mixed:
            break
        odd += "".join(sorted(mixed))
    other = f"(?:(?!{letter.pattern})[^{SPACE}])"
    return f"{SPACE}*{letter.pattern}+|{SPACE}*{other}+|{SPACE}+"


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The symbols of ``text`` after the adjacent pair of the highest score, the first of equals, was merged until none is left."""
    symbols, none = list(text), float("-inf")
    gain = [scores.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
    while gain and (best := max(gain)) > none:
        i = gain.index(best)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        del gain[i]
        if i:
            gain[i - 1] = scores.get(symbols[i - 1] + symbols[i], none)
        if i < len(gain):
            gain[i] = scores.get(symbols[i] + symbols[i + 1], none)
    return symbols


class Encoder(dict):
    """Encoder of one worker: units and their ids as bytes, and pairs of pieces it has met, each up to a bound."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.unit = pieces, re.compile(pieces.unit)
        self.matches = ahocorasick.Automaton()
        self.whole = {name for name in pieces.scores if merged(name, pieces.scores) == [name]}
        for name in self.whole:
            self.matches.add_word(name, (len(name) - 1, name))
        self.matches.make_automaton()
        self.bytes_of = {name: array("i", [pieces.ids[name]]).tobytes() for name in self.whole}
        self.pairs: dict[tuple[str, str], bool] = {}
        # the longest piece that begins a piece and is shorter
        self.shorter = {n: next((n[:k] for k in range(len(n) - 1, 0, -1) if n[:k] in self.whole), None) for n in self.whole}

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of both gives the two again."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        fits = self.pairs[pair] = merged(pair[0] + pair[1], self.pieces.scores) == list(pair)
        return fits

    def split(self, unit: str) -> list[str]:
        """Pieces of a unit; a character outside the vocabulary stands for itself."""
        size, pair, next_of = len(unit), self.pairs.get, self.shorter.get
        longest: list[str] = list(unit)
        for end, (back, piece) in self.matches.iter(unit):
            longest[end - back] = piece  # matches end later and later, so the longest is the last
        failed: bytearray | None = None
        laid: list[str] = []
        at, piece, last = 0, longest[0], None
        while True:
            end = at + len(piece)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                if last is None:
                    fits = True
                elif (fits := pair((last, piece))) is None:
                    fits = self._fits((last, piece))
                if fits:
                    laid.append(piece)
                    if end == size:
                        return laid
                    at, last, piece = end, piece, longest[end]
                    continue
            shorter = next_of(piece)
            while shorter is None:
                if not laid:
                    raise ValueError(f"no sequence of pieces for {unit[:80]!r}")
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                gone = laid.pop()
                at -= len(gone)
                last = laid[-1] if laid else None
                shorter = next_of(gone)
            piece = shorter

    def __missing__(self, unit: str) -> bytes:
        known = self.bytes_of
        ids = b"".join([known[p] if p in known else array("i", [self.pieces.bytes_[b] for b in p.encode()]).tobytes() for p in self.split(unit)])
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each; an empty one has none."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if len(text) < STRETCH:
            return b"".join([self[unit] for unit in self.unit.findall(text)])
        units, parts = (match[0] for match in self.unit.finditer(text)), []
        while part := b"".join([self[unit] for unit in islice(units, STRETCH)]):
            parts.append(part)
        return b"".join(parts)


@lru_cache(maxsize=1)
def _encoder(key: str, shared: Broadcast) -> Encoder:
    """The encoder of this worker; it outlives a task, so that what it remembers does too."""
    return Encoder(shared.value)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("kinespark_each_byte", _each_byte)


class Decoder:
    """Texts of sequences of ids: the bytes of all pieces side by side, cut at the sequences."""

    def __init__(self, pieces: Pieces) -> None:
        parts = [b"" if i in pieces.silent else name.replace(SPACE, " ").encode() for i, name in enumerate(pieces.names)]
        parts[pieces.unknown] = " ⁇ ".encode()
        for value, i in enumerate(pieces.bytes_):
            parts[i] = bytes([value])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.is_byte = np.zeros(len(parts), bool)
        self.is_byte[pieces.bytes_] = True
        self.leads = np.array([name.startswith(SPACE) for name in pieces.names])
        self.silent = np.array([i in pieces.silent for i in range(len(parts))])

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence: the space before its first piece goes, bytes that are no UTF-8 become U+FFFD one by one."""
        silent = self.silent[ids]
        first = int(np.argmin(silent)) if len(ids) else 0
        bare = bool(len(ids)) and bool(self.leads[ids[first]])
        if self.is_byte[ids].any() and silent.any():  # bytes on both sides of a silent id make no character together
            text = "".join(self._text(part) for part in np.split(ids, np.flatnonzero(silent)))
        else:
            text = self._text(ids)
        return text[1:] if bare else text

    def _text(self, ids: np.ndarray) -> str:
        out = []
        for k in range(0, len(ids), CHUNK):
            part = ids[k:k + CHUNK]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.data[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + sizes, sizes)].tobytes())
        return b"".join(out).decode("utf-8", "kinespark_each_byte" if self.is_byte[ids].any() else "strict")


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of their whole ``text`` in ``into`` (replaced if there); other columns of any name stay.

    No begin or end ids. A null or empty text has an empty list. Rows are independent: repeated rows get equal ids, an
    empty table stays empty. Long texts are read unit by unit; what a worker remembers is bounded.
    """
    if text == into:
        raise ValueError("the ids need a column of their own")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary of the model
    at, docs, schema = appended(docs, text, {into: T.ArrayType(T.IntegerType())})

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first, held, ends = batch.column(at), 0, [], [0]
            for row in range(batch.num_rows):
                held.append(_encoder(key, shared).encode(column[row].as_py() or ""))
                ends.append(ends[-1] + len(held[-1]) // 4)
                if ends[-1] >= CHUNK or row == batch.num_rows - 1:
                    ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(held))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, row + 1 - first).columns, lists], names=schema.names)
                    first, held, ends = row + 1, [], [0]
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids`` in ``into`` (replaced if there); other columns of any name stay.

    A null list gives null, an empty one an empty text. Null ids and ids outside the vocabulary raise.
    """
    if ids == into:
        raise ValueError("the text needs a column of its own")
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    at, rows, schema = appended(rows, ids, {into: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            column = batch.column(at)
            if column.flatten().null_count:
                raise ValueError("a null among ids")
            texts = [decoder.decode(v.values.to_numpy().astype(np.int64)) if v.is_valid else None for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)
    return rows.mapInArrow(run, schema)


@query("op12_piece_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through ``encode`` and back through ``decode``; null counts as empty."""
    pieces = Pieces.load(public_tokenizers.path(MODEL))
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).drop("text"), pieces)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
