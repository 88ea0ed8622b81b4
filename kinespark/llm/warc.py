"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; the seek table behind the last frame (a skippable frame that ordinary
decoders pass over) gives their sizes. The index maps a record to its bundle, frame and offset inside the frame, so that
one record costs one frame. Tasks write bundles to the shared folder under a temporary name and rename them when they
are whole: a repeated task writes the same bundle again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from ..session import ensure_checkpoint_dir
from .common import bounded, cut, query, table

#: bytes before compression: of a frame, and of a bundle
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: smaller payloads are always written out
LEAST_REVISIT = 1000
#: reading tasks; each takes several bundles or frames where there are more
MOST_TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"

#: fixed values of the seekable Zstandard format and of the WARC revisit profile
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

_INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"
_RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "payload binary")


def _identity(page_id: int | None) -> str:
    return f"<{URN}{'null' if page_id is None else page_id}>"


def _number(identity: str) -> int | None:
    text = identity.strip("<>").removeprefix(URN)
    return None if text == "null" else int(text)


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1_hex: str,
                refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``payload`` is None."""
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _identity(page_id)),
            ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if payload is None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _identity(refers_to))]
    block = http + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, header fields, block) of the records that follow one another in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record begins at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        stop = end + 4 + size + 4
        if data[stop - 4:stop] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, stop - at, fields, data[end + 4:end + 4 + size]
        at = stop


class BundleWriter:
    """Frames, their sizes, and the seek table at the end."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, base = fs.FileSystem.from_uri(folder)
        self.path, self.final = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"
        self.uri = f"{folder}/{name}"
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.records: list[bytes] = []
        self.pending = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.pending and self.pending + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.sizes), self.pending
        self.records.append(record)
        self.pending += len(record)
        self.total += len(record)
        return place

    def _flush(self) -> None:
        frame = ZstdCompressor(level=3).compress(b"".join(self.records))
        self.out.write(frame)
        self.sizes.append((len(frame), self.pending))
        self.records, self.pending = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        table_ = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table_)) + table_)
        self.out.close()
        self.files.move(self.path, self.final)


class BundleReader:
    """Frames of a bundle by number, through the seek table."""

    def __init__(self, uri: str) -> None:
        files, path = fs.FileSystem.from_uri(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        count, _, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        raw = self.source.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = [struct.unpack_from("<II", raw, 8 * k) for k in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return ZstdDecompressor().decompress(self.source.read_at(packed, self.starts[k]), max_output_size=size)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle, rows = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "sha1", "refers_to", "revisit")]
            for page_id, url, html, size, sha1, refers_to, revisit in zip(*columns, strict=True):
                payload = None if revisit else (html or "").encode()
                record = warc_record(page_id, url, payload, size, sha1, refers_to)
                if bundle is None:
                    bundle = BundleWriter(folder, f"part-{part:06d}-{number:04d}.warc.zst")
                    number += 1
                frame, offset = bundle.add(record)
                rows.append((_identity(page_id).strip("<>"), page_id, "revisit" if revisit else "response", bundle.uri, frame,
                             offset, len(record)))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                    yield _index_batch(rows)
                    rows = []
        if bundle is not None:
            bundle.close()
            yield _index_batch(rows)
    return run


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[c.split()[0] for c in _INDEX.split(", ")])


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the index.

    Payloads are the html in UTF-8, null is empty. Of equal payloads of ``LEAST_REVISIT`` bytes or more the largest
    page_id is the response and the others revisit it (a null page_id revisits too; if all are null, all are responses,
    as are repeated rows of the largest page_id). A record's identity is made of its page_id, so repeated page_ids share
    it. A null url leaves its header out. An empty table writes nothing. Archives go to ``folder``, or to a new one
    beside the checkpoints. Pages are written where they are read; they are not shuffled unless the table of
    repeated payloads is too large to broadcast.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha1"))
    groups = cut(rows.where(F.col("size") >= LEAST_REVISIT).groupBy("sha1", "size").agg(
        F.count("*").alias("c"), F.max("page_id").alias("keeper")).where("c > 1 and keeper is not null").drop("c"))
    rows = rows.join(bounded(groups), ["sha1", "size"], "left")
    revisit = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")))
    rows = rows.withColumn("revisit", revisit).select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "size", "sha1",
        F.when(F.col("revisit"), F.col("keeper")).alias("refers_to"), "revisit")
    return cut(rows.mapInArrow(_writer(folder), _INDEX))


def _record_row(fields: dict, block: bytes, payloads: bool) -> tuple:
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    return (_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"],
            None if whole else _number(fields["WARC-Refers-To"]), payload if payloads and whole else None)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[c.split()[0] for c in _RECORD.split(", ")])


def _tasks(bundles: DataFrame) -> int:
    """Tasks that share the bundles: the rows are short, the work behind them is not, so their size may not decide."""
    return max(1, min(bundles.count(), MOST_TASKS))


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame; damaged ones raise an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                bundle = BundleReader(uri)
                for k in range(len(bundle.sizes)):
                    yield _record_batch([_record_row(f, b, payloads) for _, _, f, b in parse_records(bundle.frame(k))])
    bundles = index.select("bundle").distinct()
    return bundles.repartition(_tasks(bundles)).mapInArrow(run, _RECORD)


def fetch(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the rows of ``index`` alone: each distinct frame among them is read and unpacked once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = bundle = number = data = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")]
            rows = []
            for u, k, offset, length in zip(*columns, strict=True):
                if u != uri:
                    uri, bundle, number = u, BundleReader(u), None
                if k != number:
                    number, data = k, bundle.frame(k)
                _, _, fields, block = next(parse_records(data[offset:offset + length]))
                rows.append(_record_row(fields, block, payloads))
            if rows:
                yield _record_batch(rows)
    keys = ["bundle", "frame", "offset", "length"]
    tasks = _tasks(index.select("bundle", "frame").distinct())
    return index.select(keys).repartition(tasks, "bundle", "frame").sortWithinPartitions(*keys).mapInArrow(run, _RECORD)


@query("op4_warc", r"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                      sha1(coalesce(html, '')) AS payload_digest FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
    FROM k""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
