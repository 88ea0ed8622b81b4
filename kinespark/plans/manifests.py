"""Checksum manifests: create, create per release, verify."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import verify_manifest
from ..sources.files import list_files

# Folders and files that never enter a manifest.
EXCLUDED_DIRS = (".git", "__pycache__", ".pytest_cache", ".venv")
MANIFEST_NAME = "manifest_sha256.csv"


def create(spark: SparkSession, root: str, exclude_dirs: Iterable[str] = EXCLUDED_DIRS,
           skip_files: Iterable[str] = (MANIFEST_NAME,)) -> DataFrame:
    return list_files(spark, root, exclude_dirs, skip_files)


def with_release(files: DataFrame) -> DataFrame:
    """Split the first folder off as the release."""
    return files.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("release"),
                        F.regexp_replace("file", r"^[^/]+/", "").alias("file"),
                        *[c for c in files.columns if c != "file"])


def create_all(spark: SparkSession, releases_root: str) -> DataFrame:
    """Manifest rows of every release folder under the root."""
    return with_release(create(spark, releases_root).where(F.contains("file", F.lit("/"))))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return verify_manifest(manifest, files)


def verify_releases(manifests: DataFrame, files: DataFrame, releases: DataFrame) -> DataFrame:
    """Per release: checked files, errors, and whether its manifest is missing.

    ``manifests`` and ``files`` carry a release column; ``releases`` lists them all.
    """
    path = F.concat_ws("/", "release", F.replace(F.col("file"), F.lit("\\"), F.lit("/")))
    status = verify_manifest(manifests.withColumn("file", path), files.withColumn("file", path)).withColumn(
        "release", F.split_part("file", F.lit("/"), F.lit(1)))
    per = status.groupBy("release").agg(F.count("*").alias("checked"),
                                        F.count_if(F.col("status") != "OK").alias("errors"))
    return releases.select("release").distinct().join(per, "release", "left").select(
        "release", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("errors", F.lit(0)).alias("errors"),
        F.col("checked").isNull().alias("manifest_missing"))


def exit_code(per_release: DataFrame) -> int:
    """2 when a manifest is missing, 1 on any error, else 0."""
    row = per_release.agg(F.coalesce(F.bool_or("manifest_missing"), F.lit(False)).alias("m"),
                          F.coalesce(F.sum("errors"), F.lit(0)).alias("e")).first()
    return 2 if row["m"] else 1 if row["e"] else 0
