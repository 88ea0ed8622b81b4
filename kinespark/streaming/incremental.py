"""Resume and append as an incremental query.

A stage that must not redo finished work reads its input folder as a file
stream. The checkpoint remembers which files were processed, so a restart
continues where the last run stopped, and results are appended or upserted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import remaining
from ..sinks.tables import append_rows, upsert_partitions


def run_new_inputs(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], target: str,
                   checkpoint: str, keys: Sequence[str] = (), files_per_batch: int = 1000) -> int:
    """Process the Parquet files that arrived since the last run. Returns the number of batches.

    With ``keys`` (columns of the input) the keys of a batch are computed again from all their input, whichever batches
    its files came in, and their partitions replaced; a replayed batch is harmless. Without, results are appended.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        if keys:
            same = [F.col(f"_in.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys]
            touched = batch.select(*keys).distinct().alias("_new")
            everything = spark.read.schema(schema).parquet(source).alias("_in")
            upsert_partitions(plan(everything.join(touched, same, "left_semi")), target, keys)
        else:
            append_rows(plan(batch), target)
        done.append(number)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
              .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    return len(done)


def unfinished(todo: DataFrame, spark: SparkSession, target: str, keys: Sequence[str], exists: bool) -> DataFrame:
    """Inputs whose key has no result in ``target`` yet; everything when there is no target."""
    return remaining(todo, spark.read.parquet(target), keys) if exists else todo
