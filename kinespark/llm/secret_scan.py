"""Secret scans: all rules in one byte pass of a combined minimal automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton, compile_rules
from .common import appended, query, table
from .text import string_chunks


@dataclass(frozen=True)
class Rule:
    """A secret is ``head`` followed by ``value``, both greedy; its value has ``least`` characters or more.

    Patterns hold literals, ASCII classes, groups, alternatives and repeats, and ``(?i:...)`` for ASCII letters in
    either case. No match may begin before another and end after it has ended, and the longest head must be the one
    that a value follows; with that, results are the leftmost non-overlapping matches of ``head value``, of which the
    short ones are dropped.
    """

    kind: str
    head: str
    value: str
    least: int


#: fixed values: the base rules, in their order of listing
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    # runs shorter than 16 are never accepted: the same matches as of [0-9a-f]+ with the short ones dropped
    Rule("hex", r"", r"[0-9a-f]{16,}", 16),
)
#: formats of well-known credentials, found in the same pass
MORE = (
    Rule("github", r"gh[oprsu]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 20),
    Rule("private_key", r"-----BEGIN\x20", r"(?:[A-Z]+\x20)*PRIVATE\x20KEY-----", 0),
)
SPANS = T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("text", T.StringType())])))


class Scanner:
    """The combined search automaton, and for each rule the small ones that fix the ends of a match."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.search = compile_rules([r.head + r.value for r in rules], search=True)
        self.back = [compile_rules([r.head + r.value], backwards=True) for r in rules]
        self.whole = [compile_rules([r.head + r.value]) for r in rules]
        self.heads = [compile_rules([r.head]) for r in rules]
        n = self.search.classes
        self.mask = np.zeros(len(self.search.accepts) * n, np.int64)
        self.mask[::n] = self.search.accepts

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list]]:
        """(row, spans) of the rows with secrets; the state is reset before every row."""
        rows = len(offsets) - 1
        symbols = np.full(len(data) + rows, self.search.classes - 1, np.int32)
        at = np.arange(len(data))
        at += np.repeat(np.arange(1, rows + 1), np.diff(offsets))
        symbols[at] = self.search.byte_class[data]
        states = self.search.states(symbols)
        bits = self.mask[states]
        step, lane = np.nonzero(bits)
        where = lane * len(states) + step
        order = np.argsort(where)
        where, bits = where[order], bits[step, lane][order]
        row = np.searchsorted(offsets + np.arange(rows + 1), where, side="right") - 1
        for r in np.unique(row):
            lo, hi = np.searchsorted(row, [r, r + 1])
            ends = where[lo:hi] - (offsets[r] + r)  # behind the accepted byte: the reset symbol stands before the row
            yield int(r), self._spans(data[offsets[r]:offsets[r + 1]], ends, bits[lo:hi])

    def _spans(self, data: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> list:
        raw, found = data.tobytes(), []
        for k, rule in enumerate(self.rules):
            own, cursor = ends[bits >> k & 1 == 1], 0
            i = 0
            while i < len(own):
                begin = self.back[k].longest(raw, int(own[i]), cursor, -1)
                if begin is None:
                    i += 1
                    continue
                end = self.whole[k].longest(raw, begin, len(raw))
                value = self.heads[k].longest(raw, begin, end)
                if end - value >= rule.least:
                    found.append((begin, k, end))
                cursor = end
                i = int(np.searchsorted(own, cursor, side="right"))
        if not found:
            return []
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return [{"kind": self.rules[k].kind, "start": int(point[a]), "end": int(point[b]), "text": raw[a:b].decode()}
                for a, k, b in sorted(found)]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` (text; other columns stay) with ``spans``: kind, start, end (code points, end exclusive) and text.

    Spans are ordered by start, then by the order of the rules. Null and empty texts have none. A column of ``docs``
    named ``spans`` is replaced, others of any name stay. Rows are independent: repeated rows give repeated results, an empty
    table an empty one. Long texts are scanned whole, stretch by stretch.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    at, docs, schema = appended(docs, "text", {"spans": SPANS.dataType})
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in string_chunks(batch.column(at)):
                for r, found in scanner.value.chunk(data, offsets):
                    spans[first + r] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(scan, schema)


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [r.kind for r in BASE]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(listed(of_kind(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
