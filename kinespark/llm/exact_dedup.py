"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash of the survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, dense, query, table

#: code points of the normalised text that the prefix hash covers
PREFIX = 256


def refine(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The (length, prefix hash) keys that several rows share: only their rows are read in full.

    Lengths and prefix hashes are taken in one pass into a narrow table of counts; both groupings run on that table.
    """
    text = dense(F.col("text"))
    narrow = (docs.select(text.alias("d")).select(
        F.char_length("d").alias("_len"), F.xxhash64(F.substring("d", 1, prefix)).alias("_prefix")))
    # rows with equal keys are counted before they meet, so that a hot length brings one row for each of its prefixes
    kinds = cut(narrow.groupBy("_len", "_prefix").agg(F.count("*").alias("c")))
    lengths = kinds.groupBy("_len").agg(F.sum("c").alias("n")).where("n > 1")
    alive = kinds.join(lengths.select("_len"), "_len", "left_semi")
    return cut(alive.where("c > 1").select("_len", "_prefix"))


def decisions(docs: DataFrame, prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """(doc_id, n, sha, keep_id, group_size, kept) for every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical without ASCII whitespace; null is empty. Of equal texts the row with the
    most code points, then the smallest doc_id stays (a null doc_id comes last); of identical repeated rows one stays.
    ``sha`` is the SHA-256 of the normalised text; it is null where length or prefix already told the text apart from
    all others, unless ``digests`` asks for it as a result. An empty table gives an empty table.
    """
    keys = bounded(refine(docs, prefix)).withColumn("_shared", F.lit(True))
    text = dense(F.col("text"))
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), text.alias("d"))
    rows = rows.withColumns({"_len": F.char_length("d"), "_prefix": F.xxhash64(F.substring("d", 1, prefix))})
    shared = F.col("_shared").isNotNull()
    rows = cut(rows.join(keys, ["_len", "_prefix"], "left").select(
        "doc_id", "n", shared.alias("shared"), F.when(shared | F.lit(digests), F.unhex(F.sha2("d", 256))).alias("sha")))
    # identical rows are counted first: what follows has a row for each (doc_id, n, text), however hot a text is
    units = rows.where("shared").groupBy("doc_id", "n", "sha").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("n"), F.col("doc_id").isNotNull(), -F.col("doc_id"), F.col("doc_id"))
    groups = units.groupBy("sha").agg(F.max(order).alias("best"), F.sum("copies").alias("group_size"))
    groups = groups.select("sha", F.col("best.n").alias("_n"), F.col("best.doc_id").alias("keep_id"), "group_size")
    best = (F.col("n") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # one narrow row for each text: broadcast where that is bounded, so that a hot text stays spread over its units
    placed = units.join(bounded(cut(groups)), "sha").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    placed = placed.select("doc_id", "n", "sha", "keep_id", "group_size", (best & (F.col("copy") == 1)).alias("kept"))
    return placed.unionByName(rows.where("not shared").select(
        "doc_id", "n", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Rows leave by (doc_id, code points, text hash), as ``decisions`` says: null and empty texts are equal, ties go to the
    smallest doc_id, null last. Identical repeated rows, and rows that differ in other columns only, are told apart by
    one of them at will, which only the keys that repeat need. Long texts are hashed whole; an empty table stays empty.
    """
    found = decisions(docs.select("doc_id", "text")).where("sha is not null")
    gone = found.groupBy("doc_id", "n", "sha").agg(F.count("*").alias("_rows"), F.sum(F.col("kept").cast("int")).alias("_stay"))
    gone = cut(gone.where("_stay < _rows"))
    whole = gone.where("_stay = 0").select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("sha").alias("_sha"))
    once = gone.where("_stay > 0").select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("sha").alias("_sha"))
    rest = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))

    def same(keys: DataFrame):
        return (F.col("doc_id").eqNullSafe(keys["_id"]) & (F.char_length(text) == keys["_n"])
                & (F.unhex(F.sha2(dense(F.col("text")), 256)) == keys["_sha"]))
    if not whole.isEmpty():
        keys = bounded(whole)
        rest = rest.join(keys, same(keys), "left_anti")
    if not once.isEmpty():
        keys = bounded(once)
        first = rest.join(keys, same(keys)).groupBy("_id", "_n", "_sha").agg(F.first("row").alias("row"))
        rest = rest.join(keys, same(keys), "left_anti").select("row").unionByName(first.select("row"))
    return rest.select("row.*")


@query("op6_exact_dedup", r"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
