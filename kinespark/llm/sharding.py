"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size: it starts at an offset and goes on by a
stride, both hashed from its name, and thus passes all slots. The shards take turns, each claiming its next free slot.
A key belongs to the shard at slot ``hash mod size``; adding or removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table, words_in

#: a prime; the table has as many rows whatever the data, and is well above 100 slots a shard for 512 shards
SLOTS = 65_537
SHARDS = 128


def _preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return (int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that owns each slot. Names are distinct; ``slots`` is a prime not below their number."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots:
        raise ValueError("shards need distinct names, and a slot each")
    if any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots is a prime")
    owner = np.full(slots, -1, np.int32)
    state = [_preference(name, slots) for name in shards]
    at, stride = [s[0] for s in state], [s[1] for s in state]
    claimed = 0
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            owner[at[k]] = k
            claimed += 1
            if claimed == slots:
                return owner


def placed(docs: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (a name) of every row; columns of these names are replaced.

    Rows with equal keys share a slot. The key is the JSON text of the key columns, so that types, nulls and empty
    strings stay apart; a null key has a place like any other. Empty tables give empty tables. The join is with the
    table of slots, whose size is fixed, and is broadcast.
    """
    spark = docs.sparkSession
    names = [shards[k] for k in lookup_table(shards, slots)]
    slot_table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "_slot long, shard string")
    key = F.to_json(F.struct(*[docs[k] for k in keys]), {"ignoreNullFields": "false"})
    docs = docs.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots))).drop("shard")
    return docs.join(F.broadcast(slot_table), docs["slot"] == slot_table["_slot"]).drop(slot_table["_slot"])


def write_shards(docs: DataFrame, keys: list[str], shards: list[str], path: str, files: int = 1) -> None:
    """Write ``docs`` as Parquet, a folder for each shard, at most ``files`` files in each.

    Rows are dealt by (shard, hash of the row), so that a shard with a hot key is still written by ``files`` tasks.
    """
    whole = F.xxhash64(*[f"`{c.replace('`', '``')}`" for c in docs.columns])
    rows = placed(docs, keys, shards).withColumn(file := "_file" + "_" * max(map(len, docs.columns)), F.pmod(whole, F.lit(files)))
    rows = rows.repartition(max(1, len(shards) * files), "shard", file).drop(file, "slot")
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, its words, and the shard it had if the last shard did not exist."""
    shards = [f"shard-{i:05d}" for i in range(SHARDS)]
    docs = table(spark, sf_dir, "documents").select("doc_id", words_in(F.col("text")).alias("n_words"))
    now = placed(docs, ["doc_id"], shards)
    return placed(now.withColumnRenamed("shard", "_now"), ["doc_id"], shards[:-1]).select(
        "doc_id", "n_words", "slot", F.col("_now").alias("shard"), F.col("shard").alias("shard_before"))
