"""Delimited tables, wide signal text files and channel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_floats, require_columns
from ..session import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Typed CSV with a header; NaN becomes NULL. Columns are matched by name through the header."""
    df = spark.read.csv(path, header=True, schema=None)
    wanted = spark.createDataFrame([], schema).schema
    require_columns(df, required if required is not None else [f.name for f in wanted.fields], path)
    present = [f for f in wanted.fields if f.name in df.columns]
    return clean_floats(df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in present]))


def read_signal_text(spark: SparkSession, path: str, points: int = 200, time_column: str = "Time") -> DataFrame:
    """Tab-separated recordings, one column per channel, as stride blocks (path, file, block_id, m, x).

    Files are read in splits. A line's number is its place in its split plus the lines of the splits before it in the file,
    which are counted; line 0 names the columns. Blank lines do not count, trailing samples that do not fill a stride are
    dropped, a file without a header or without a whole stride gives no rows.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat" if not path.endswith(".dat") else "*").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"))
    lines = lines.where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(splits.select("path", "_split", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")))
    numbered = lines.join(splits, ["path", "_split"]).select("path", "value", (F.col("_at") + F.col("_shift")).alias("_line"))
    head = numbered.where("_line = 0").select("path", (F.array_position(F.split("value", "\t"), time_column).cast("int") - 1).alias("_t"))
    sample = F.transform(F.filter(F.split("value", "\t"), lambda _, i: i != F.col("_t")), lambda v: F.trim(v).cast("double"))
    rows = numbered.where("_line > 0").join(cut_lineage(head), "path").select(
        "path", F.floor((F.col("_line") - 1) / points).alias("block_id"), F.struct("_line", sample.alias("v")).alias("_s"))
    whole = rows.groupBy("path", "block_id").agg(F.array_sort(F.collect_list("_s")).alias("_s")).where(F.size("_s") == points)
    values = F.transform("_s", lambda s: s["v"])
    return whole.select("path", F.regexp_replace("path", r"^.*/", "").alias("file"), F.col("block_id").cast("bigint"),
                        F.size(F.get(values, F.lit(0))).alias("m"), F.flatten(values).alias("x"))


def read_channel_map(df: DataFrame, muscles: list[str]) -> DataFrame:
    """Long channel map from a wide sheet (Subject, Condition, one column per channel)."""
    require_columns(df, ["Subject", "Condition", *muscles], "channel sheet")
    typed = df.select(F.col("Subject").cast("int").alias("subject"), F.col("Condition").alias("condition"),
                      *[F.col(f"`{m}`").cast("double").cast("int").alias(m) for m in muscles])
    return typed.unpivot(["subject", "condition"], [f"`{m}`" for m in muscles], "muscle", "channel_num")
