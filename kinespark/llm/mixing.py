"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Inside a source the documents stand in order of size (ties spread by a hash). Each has the same expected copies, the
rate of its source; their prefix sum plus one random offset of the source crosses an integer boundary as often as the
document is taken. Because neighbours are of almost equal size, the words taken come close to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, query, table, words_in
from .merkle import numbered

#: fixed values: weights by rank of the source, and how often a document may be taken
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) with ``rank`` from 0 by code point, null last, without sorting in one task.

    Ranges are numbered inside, and the small table of range sizes gives what stands before each range.
    """
    keyed = sources.withColumn("_null", F.col("source").isNull())
    parts = cut(keyed.repartitionByRange("_null", "source").withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("c"))
    before = before.select("_part", (F.sum("c").over(Window.orderBy("_part")) - F.col("c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1
    return parts.join(before, "_part").withColumn("rank", (inside + F.col("_before")).cast("long")).drop(
        "_part", "_before", "_null")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Targets share the total size by weight; a target above ``most`` times its source's size stops there and the excess
    is shared again, until none is above. Each round is one aggregate of three numbers; a source once stopped stays so.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut(ranked(sources).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")))
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, shares = total, None
    while True:
        stopped = F.lit(False) if shares is None else F.col("cap") * shares < F.col("weight") * F.lit(left).cast("double")
        row = s.where(~stopped).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        used = s.where(stopped).agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).first()
        if (total - used["c"], row["w"]) == (left, shares):
            break
        left, shares = total - used["c"], row["w"]
        if not shares:
            break
    target = F.col("cap").cast("double") if not shares else F.when(stopped, F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.lit(left).cast("double") / F.lit(shares).cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"), "rank")


def copies(sized: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` (doc_id, source, size, ...) with ``source_size``, ``target`` and ``copies``.

    The position of a document in its source is the sum of three bounded counts: size classes before its own, hash
    classes before its own in the size class, and rows before it there; no source is sorted in one task.
    """
    plan = bounded(plan.withColumnRenamed("source", "_source"))
    top = F.length(F.bin("size"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns({
        "_class": top * 32 + F.expr(f"shiftright(size, greatest(length(bin(size)) - 5, 0))").cast("int"),
        "_hash": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)})
    rows = cut(rows)
    cells = rows.groupBy("rank", "_class", "_hash").agg(F.count("*").alias("c"))
    classes = cells.groupBy("rank", "_class").agg(F.sum("c").alias("c"))
    classes = classes.select("rank", "_class", (F.sum("c").over(Window.partitionBy("rank").orderBy("_class")) - F.col("c")).alias("_a"))
    cells = cells.withColumn("_b", F.sum("c").over(Window.partitionBy("rank", "_class").orderBy("_hash")) - F.col("c"))
    before = cells.join(classes, ["rank", "_class"]).select("rank", "_class", "_hash", (F.col("_a") + F.col("_b")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("rank", "_class", "_hash").orderBy("size", "doc_id"))
    rows = rows.join(before, ["rank", "_class", "_hash"]).withColumn("_at", F.col("_before") + inside)
    # one offset for each source, a fixed function of seed and source
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8),
                    16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    crossed = lambda at: F.floor(at.cast("double") * rate + offset)
    taken = (crossed(F.col("_at")) - crossed(F.col("_at") - 1)).cast("long")
    return rows.withColumn("copies", taken).drop("rank", "weight", "_class", "_hash", "_before", "_at")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, source, text).

    Sizes are words; null and empty texts have none. Null is a source of its own, the last. A source without words has
    target 0 and takes nothing. Repeated rows count as documents of their own, ties of size and doc_id among them are
    interchangeable. The result is the same in every run. An empty table gives an empty table.
    """
    sized = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    return copies(sized, plan, seed)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever their names.

    Decisions are counts for each (doc_id, source, size); documents find theirs by these keys. Keys of one document, nearly
    all, take one join. Documents that share a key, repeated rows among them, are numbered by text, and each gets the
    share of its number; a key may have any number of them, null doc_ids too. Null and empty texts have no words and stay or go as
    any other document of their size, long ones count whole. An empty table stays empty.
    """
    found = mix(docs, weights, most, seed).groupBy("doc_id", "source", "size", "copies").agg(F.count("*").alias("c"))
    found = found.groupBy("doc_id", "source", "size").agg(
        F.sum("c").alias("_rows"), F.sort_array(F.collect_list(F.struct("copies", "c")), asc=False).alias("_shares"))
    found = cut(found.toDF("_id", "_source", "_size", "_rows", "_shares"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", words_in(F.col("text")).alias("_words"))

    def met(keys: DataFrame) -> DataFrame:
        keys = bounded(keys)
        return rows.join(keys, F.col("doc_id").eqNullSafe(keys["_id"]) & F.col("source").eqNullSafe(keys["_source"])
                         & (F.col("_words") == keys["_size"]))
    one = F.col("_shares")[0]["copies"]
    taken = met(found.where((F.col("_rows") == 1) & (one > 0))).select("row", one.alias("_n"))
    several = found.where("_rows > 1")
    if not several.isEmpty():
        placed = numbered(met(several).select("row", "text", "_id", "_source", "_size", "_shares"), ["_id", "_source", "_size"], ["text"])
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("copies"))
        pick = F.aggregate("_shares", start, lambda a, s: F.struct(
            (a["seen"] + s["c"]).alias("seen"), F.coalesce(a["copies"], F.when(F.col("rank") < a["seen"] + s["c"], s["copies"])).alias("copies")))
        taken = taken.unionByName(placed.select("row", pick["copies"].alias("_n")).where("_n > 0"))
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row.*")


@query("op3_mixing", r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
                 [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
          FROM d GROUP BY source),
    r AS (SELECT 0 AS i, (SELECT sum(source_size)::BIGINT FROM s) AS rest, (SELECT sum(weight)::BIGINT FROM s) AS w
          UNION ALL
          SELECT r.i + 1,
                 (SELECT sum(source_size)::BIGINT FROM s) - coalesce((SELECT sum(3 * source_size)::BIGINT FROM s
                    WHERE 3 * source_size * r.w < weight * r.rest::DOUBLE), 0),
                 (SELECT sum(weight)::BIGINT FROM s WHERE NOT 3 * source_size * r.w < weight * r.rest::DOUBLE)
          FROM r WHERE r.i < 60),
    f AS (SELECT * FROM r WHERE i = 60),
    t AS (SELECT source, source_size, CASE WHEN 3 * source_size * f.w < weight * f.rest::DOUBLE
                 THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * f.rest::DOUBLE / f.w::DOUBLE END AS target FROM s, f),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
                 ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u,
                 row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), d.size >> greatest(length(bin(d.size)) - 5, 0),
                    substr(md5(d.doc_id::VARCHAR), 1, 2), d.size, d.doc_id) AS k
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           size * (floor(k::DOUBLE * rate + u) - floor((k - 1)::DOUBLE * rate + u))::BIGINT AS taken FROM p""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
