"""File listings with checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST
from .tables import read_csv

# Larger files are not read as one value but by pieces of READ_BYTES; the hash is the same.
MAX_HELD_BYTES = 64 << 20
READ_BYTES = 1 << 20


def _hash_by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path in batch.column(1).to_pylist():
            files, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with files.open_input_stream(name) as source:
                while piece := source.read(READ_BYTES):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string()), batch.column(2)],
                                         names=["file", "sha256", "size_bytes"])


def ordered_roots(spark: SparkSession, roots: list[str], name: str = "", by_folder: bool = False) -> list[tuple[str, list[str]]]:
    """For each root the files below ``root/name`` that no earlier root holds, by relative path.

    With ``by_folder`` a whole folder (a partition of a table) is taken from the first root that has it. Roots that do not exist
    hold nothing. The result names files, as Spark's readers want them; contents are not read.
    """
    parts = []
    for rank, root in enumerate(roots):
        base = f"{root.rstrip('/')}/{name}".rstrip("/")
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        local = F.regexp_replace(F.lit(base), r"^[a-z]+:/+", "/")
        below = F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.length(local) + 2, F.lit(1 << 20))
        unit = F.regexp_replace(below, r"(^|/)[^/]*$", "") if by_folder else below
        parts.append(found.select(F.lit(rank).alias("rank"), "path", unit.alias("unit")))
    if not parts:
        return []
    files = reduce(DataFrame.unionByName, parts)
    first = files.groupBy("unit").agg(F.min("rank").alias("rank"))
    chosen = files.join(first, ["unit", "rank"]).groupBy("rank").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [(roots[r["rank"]], r["paths"]) for r in chosen.orderBy("rank").collect()]


def read_table(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """Parquet table ``name`` whose partitions come from the first of ``roots`` that holds them."""
    if len(roots) == 1:
        return spark.read.parquet(f"{roots[0]}/{name}")
    parts = [spark.read.option("basePath", f"{root.rstrip('/')}/{name}").parquet(*paths) for root, paths in ordered_roots(spark, roots, name, True)]
    if not parts:
        return spark.read.parquet(f"{roots[0]}/{name}")  # says what is missing
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def list_files(spark: SparkSession, root: str, exclude_dirs: Iterable[str] = (),
               skip_files: Iterable[str] = (), held_bytes: int = MAX_HELD_BYTES) -> DataFrame:
    """Files under ``root`` as (file, sha256, size_bytes), paths relative and with forward slashes.

    The size test is pushed into the listing, so a file larger than ``held_bytes`` is never held as a whole: its task
    reads it from the shared file system piece by piece.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    whole = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    named = base.withColumn("file", F.substring(whole, F.length(prefix) + 1, F.lit(1 << 20)))
    parts = F.split("file", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = F.lit(True)
    if exclude_dirs:
        keep = keep & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in exclude_dirs]))
    if skip_files:
        keep = keep & ~F.element_at(parts, -1).isin(*skip_files)
    rows = named.where(keep)
    small = rows.where(F.col("length") <= held_bytes).select(
        "file", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    large = rows.where(F.col("length") > held_bytes).select("file", "path", "length").mapInArrow(
        _hash_by_pieces, "file string, sha256 string, size_bytes long")
    return small.unionByName(large)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MANIFEST, required=["file", "sha256"])
