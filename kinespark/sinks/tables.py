"""Table writes."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Write a table; an existing one is replaced only when asked."""
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        # a static overwrite: the whole table is replaced
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "static")
    writer.save(path)


def upsert_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows for and leave all others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_guarded(df: DataFrame, path: str, success: str, allow_empty: bool = False, overwrite: bool = False) -> int:
    """Write unless every row failed. Returns the exit code: 0 written, 2 refused."""
    if not allow_empty and not df.where(F.col(success) > 0).take(1):
        return 2
    write_table(df, path, overwrite)
    return 0


def write_archives(df: DataFrame, folder: str, name: str, arrays: dict[str, str], rows: str) -> DataFrame:
    """Export array columns as compressed NumPy archives, one file per row.

    ``arrays`` maps archive keys to array columns holding matrices with ``rows``
    rows; ``folder`` is a URI (or absolute path) on a file system that all executors share. Returns the file list.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                buffer = io.BytesIO()
                np.savez_compressed(buffer, **{
                    k: np.asarray(row[c], dtype=float).reshape(int(row[rows]), -1) for k, c in arrays.items()})
                with files.open_output_stream(f"{base}/{row[name]}.npz") as f:
                    f.write(buffer.getvalue())
                out.append((f"{folder}/{row[name]}.npz", len(buffer.getvalue())))
            yield pd.DataFrame(out, columns=["file", "size_bytes"])
    return df.select(name, rows, *arrays.values()).mapInPandas(run, "file STRING, size_bytes BIGINT")


def write_manifest(manifest: DataFrame, path: str) -> tuple[int, int]:
    """Sorted manifest CSV; returns file count and total bytes."""
    total = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    write_table(manifest.orderBy("file"), path, overwrite=True, fmt="csv")
    return int(total["n"]), int(total["b"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A short report as a one-file text folder."""
    lines = [(i, line) for i, line in enumerate(text.splitlines())]
    df = spark.createDataFrame(lines, "i INT, value STRING").coalesce(1).sortWithinPartitions("i").select("value")
    df.write.mode("overwrite").text(path)


def summary_text(title: str, counts: dict[str, object], tables: dict[str, DataFrame]) -> str:
    """Readable report from scalar facts and small aggregated tables, which are listed whole."""
    lines = [title, "=" * len(title), *[f"{k}: {v}" for k, v in counts.items()]]
    for name, df in tables.items():
        lines += ["", name, "-" * len(name), " | ".join(df.columns)]
        lines += [" | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
                  for row in df.toLocalIterator()]
    return "\n".join(lines) + "\n"
