"""Lookup, pair and resume joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import ordered_scan


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "row") -> DataFrame:
    """Reduce to one row per key and fail the query where a key has several.

    One map-side combined aggregate; the failure is raised by the executor that
    meets the duplicate, so no extra job runs.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit(f"expected one {what} for "), F.to_json(F.struct(*keys)),
                       F.lit(", found "), F.col("_n").cast("string"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(message).cast(df.select(F.struct(*rest)).schema[0].dataType))
    return one.select(*keys, checked.alias("_row")).select(*keys, "_row.*")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "row") -> DataFrame:
    """Inner lookup where every left row must find exactly one right row."""
    table = assert_unique(right, keys, what).withColumn("_found", F.lit(True))
    joined = left.join(table, list(keys), "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.to_json(F.struct(*keys)))).cast("boolean")
    return joined.where(F.coalesce(F.col("_found"), missing)).drop("_found")


def lookup_or_null(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str,
                   name: str) -> DataFrame:
    """The single matching value, NULL when there is none or more than one."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias(name))
    return left.join(single.where("_n = 1").drop("_n"), list(keys), "left")


def tolerance_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str,
                     tol: float) -> DataFrame:
    """Pairs with equal keys and values at most ``tol`` apart.

    Values are cut into cells of twice the tolerance and each left row probes
    its own cell and both neighbours, so the join is an equi-join on
    (keys, cell) and never compares a key's rows with all of each other.
    """
    width = 2.0 * tol
    cell = F.floor(F.col(value) / width).cast("bigint")
    probe = left.withColumn("_cell", F.explode(F.sequence(cell - 1, cell + 1)))
    rest = [c for c in right.columns if c not in keys]
    table = right.select(*keys, cell.alias("_cell"), *[F.col(c).alias(f"right_{c}") for c in rest])
    # rtol = 0; the slack is far below any tolerance and absorbs representation error
    near = F.abs(F.col(value) - F.col(f"right_{value}")) <= tol + 1e-12
    return probe.join(table, [*keys, "_cell"]).where(near).drop("_cell")


def tolerance_lookup_one(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str,
                         value: str, tol: float) -> DataFrame:
    """Per left row the number of matches and, when it is exactly one, the match."""
    hits = tolerance_lookup(left, right, keys, value, tol)
    rest = [c for c in hits.columns if c.startswith("right_")]
    per_row = hits.groupBy(*keys, row_id).agg(
        F.count("*").alias("n_matches"), *[F.first(c).alias(c) for c in rest])
    out = left.join(per_row, [*keys, row_id], "left")
    count = F.coalesce(F.col("n_matches"), F.lit(0)).cast("bigint")
    return out.select(*left.columns, count.alias("n_matches"),
                      *[F.when(count == 1, F.col(c)).alias(c) for c in rest])


def nearest_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, value: str,
                   prefer_larger: bool = False, chunk_width: float | None = None) -> DataFrame:
    """Per left row the nearest right value of its key; ties go to the smaller (or larger) one.

    Both sides are merged on the value axis and each left row looks one candidate
    down and one up, so the cost is one ordered pass whatever the group size.
    """
    l = left.select(*keys, F.col(row_id).alias("_id"), F.col(value).cast("double").alias("_v"),
                    F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_cand"))
    r = right.select(*keys, F.lit(None).cast(left.schema[row_id].dataType).alias("_id"),
                     F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"),
                     F.col(value).cast("double").alias("_cand")).distinct()
    merged = l.unionByName(r)
    chunk = None
    if chunk_width:
        merged, chunk = merged.withColumn("_chunk", F.floor(F.col("_v") / chunk_width)), "_chunk"
    order = ["_v", "_side", "_id"]
    merged = ordered_scan(merged, keys, order, before={"_down": F.col("_cand")}, after={"_up": F.col("_cand")}, chunk=chunk)
    below, above = F.col("_v") - F.col("_down"), F.col("_up") - F.col("_v")
    up_wins = above <= below + 1e-12 if prefer_larger else above < below
    pick = F.when(F.col("_down").isNull() | up_wins, F.coalesce("_up", "_down")).otherwise(F.col("_down"))
    found = merged.where("_side = 1").select(*keys, F.col("_id").alias(row_id), pick.alias("nearest"))
    return left.join(found, [*keys, row_id], "left")


def ordered_pairs(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Every ordered pair of different items of a key, as ``<column>_a`` and ``<column>_b``.

    One row per (key, item) is expected, so a key's rows are its few conditions.
    """
    rest = [c for c in df.columns if c not in keys]
    a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in rest])
    b = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in rest])
    return a.join(b, list(keys)).where(F.col(f"{item}_a") != F.col(f"{item}_b"))


def reference_pairs(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Each item paired with the largest item of its key, as ``ref_<c>`` and ``q_<c>``."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(item)).alias("_ref"))
    joined = df.join(top, list(keys)).where(F.col(item) < F.col(f"_ref.{item}"))
    return joined.select(*keys, *[F.col(f"_ref.{c}").alias(f"ref_{c}") for c in rest],
                         *[F.col(c).alias(f"q_{c}") for c in rest])


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no completed result yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def with_partner(df: DataFrame, partner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the partner table."""
    return df.join(partner.select(*keys).distinct(), list(keys), "left_semi")


def replace_keys(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-insert: all rows of ``fresh`` plus the existing rows of other keys."""
    return remaining(existing, fresh, keys).unionByName(fresh, allowMissingColumns=True)


def shifted_channels(df: DataFrame, unit: Sequence[str], channel: str, available: Column) -> DataFrame:
    """Shift a unit's channel numbers down when their maximum exceeds the file's channel count.

    A number still out of range after the shift is an error.
    """
    top = df.groupBy(*unit).agg(F.max(channel).alias("_max"), F.min(channel).alias("_min"))
    joined = df.join(top, list(unit))
    # numbers within 1..available stay as they are
    over = F.greatest(F.col("_max") - available, F.lit(0))
    moved = F.col(channel) - over
    bad = F.raise_error(F.concat(F.lit("channel out of range: "), F.to_json(F.struct(*unit)))).cast("int")
    return joined.withColumn(channel, F.when((F.col("_min") - over >= 1) & (moved <= available), moved)
                             .otherwise(bad).cast("int")).drop("_max", "_min")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status per manifest entry: OK, MISMATCH or MISSING."""
    from ..functions.keys import posix_path
    entries = manifest.select(posix_path("file").alias("file"), F.lower("sha256").alias("expected"))
    seen = files.select("file", F.lower("sha256").alias("actual"))
    status = (F.when(F.col("actual").isNull(), "MISSING")
              .when(F.col("actual") != F.col("expected"), "MISMATCH").otherwise("OK"))
    return entries.join(seen, "file", "left").select("file", "expected", "actual", status.alias("status"))
