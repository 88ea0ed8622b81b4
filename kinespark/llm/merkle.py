"""Merkle manifest of a table: content-addressed records, and proofs by descent from the root.

Leaves are numbered inside their source by one range shuffle and counts of its partitions. Sixteen neighbours become a
parent, level by level, until a source has one node; the subroots of the sources become one tree the same way. What is
kept is a store of records: the digest of a node and the digests of its children.

A proof is found by descent. A request is the number of a leaf; its digits to the base 16 say which child to take at
each node. All requests below a node go down together as one row, which looks up the record of its digest, and for each
child that is asked for goes on with the digests of the others as a new segment of the path. Only the lowest step meets
the leaves, and what is wanted of them is reckoned there, so that no leaf's path is ever shuffled. From the leaf up,
the path is that list of segments reversed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, query, table

#: children of a node
FAN = 16
#: what a leaf's digest covers, in this order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 15
SEGMENT = "array<struct<left:string,right:string>>"


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of the fields: '-' for null, else byte count, ':' and the value. ``changed`` stands in for fields."""
    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(n) for n in FIELDS]), 256)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, the place of a row among those of equal ``keys``, from 0; nulls come first.

    One range shuffle sorts the rows, however many have one key; the places where a key's rows begin in each
    partition are counted, and there are at most as many of them as partitions and keys. Rows that are equal in
    all of ``order`` are told apart by where they are read, so that they spread as well.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(c) for c in [*keys, *order]] + [F.asc("_tie")]
    laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    laid = cut(laid.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    runs = laid.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")))
    small = runs.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], part == F.col("_p"))
    return laid.join(bounded(small), same).withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_p", "_before", *small.columns)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.pow(F.lit(float(FAN)), k) < n))


def _grown(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Parents of ``nodes`` (tree, idx, digest, depth), level by level: (tree, idx, digest, depth, children)."""
    out = []
    for height in range(1, levels + 1):
        group = nodes.where(F.col("depth") >= height).groupBy("tree", F.shiftright("idx", 4).alias("idx"), "depth")
        made = group.agg(F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"].alias("children"))
        out.append(cut(made.withColumn("digest", F.sha2(F.array_join("children", ""), 256))))
        nodes = out[-1]
    return out


@dataclass
class Manifest:
    """Leaves (tree, rank, depth, leaf and more), sources (tree, source, depth, subroot), the root, and records.

    ``records`` has (upper, height, digest, children): upper nodes lie above the subroots, heights count from the leaves.
    """

    leaves: DataFrame
    sources: DataFrame
    records: DataFrame
    root: str | None
    upper_depth: int
    depth: int


def build(docs: DataFrame, leaf: Column | None = None, more: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text); ``more`` names further columns that leaves keep.

    Leaves of a source ascend by doc_id (null first), equal ones by digest; repeated rows are leaves of their own. A
    null source is a source. An empty text differs from a null one. A source with one leaf has it as its subroot, a
    table with one source has its subroot as root, an empty table has no root. Other columns are not covered.
    """
    spark, more = docs.sparkSession, more or {}
    rows = docs.select("source", "doc_id", (leaf_digest() if leaf is None else leaf).alias("leaf"), *[c.alias(n) for n, c in more.items()])
    ranked = numbered(rows, ["source"], ["doc_id", "leaf"])
    sources = numbered(cut(ranked.groupBy("source").agg(F.count("*").alias("n"))), [], ["source"])
    sources = cut(sources.select(F.col("rank").alias("tree"), "source", "n", _depth(F.col("n")).alias("depth")))
    codes = bounded(sources.select("tree", "depth", F.col("source").alias("_source")))
    leaves = cut(ranked.join(codes, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source"))
    levels = sources.agg(F.max("depth")).first()[0] or 0
    lower = _grown(leaves.select("tree", F.col("rank").alias("idx"), F.col("leaf").alias("digest"), "depth"), levels)
    tops = reduce(DataFrame.unionByName, [part.where(F.col("depth") == height).select("tree", "digest") for height, part in enumerate(
        [leaves.select("tree", "depth", F.col("leaf").alias("digest")), *lower])])
    sources = cut(sources.join(tops.withColumnRenamed("digest", "subroot"), "tree"))
    count = sources.count()
    upper_depth = next(k for k in range(LEVELS + 1) if FAN ** k >= count)
    upper = _grown(sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"),
                                  F.lit(upper_depth).alias("depth")), upper_depth)
    top = (upper[-1].select("digest") if upper else sources.select("subroot")).first()
    none = spark.createDataFrame([], "upper boolean, height int, digest string, children array<string>")
    records = reduce(DataFrame.unionByName, [part.select(F.lit(above).alias("upper"), F.lit(height).alias("height"), "digest", "children")
                                             for above, parts in ((False, lower), (True, upper)) for height, part in enumerate(parts, 1)], none)
    return Manifest(leaves, sources, records, top[0] if top else None, upper_depth, levels)


def _down(cursor: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One step: ``cursor`` (tree, idx, digest, path, more) to the children that ``wanted`` (tree, idx, asks) names by digit.

    Gives (tree, idx, digest, path, ask, more). A digest is looked up once, whatever nodes have it.
    """
    store = records.select("digest", "children").dropDuplicates(["digest"])
    met = cursor.join(store, "digest").join(wanted, ["tree", "idx"]).withColumn("ask", F.explode("asks"))
    digit = F.col("ask.digit")

    def text(first: Column, size: Column) -> Column:
        return F.array_join(F.slice("children", first, size), "")
    segment = F.struct(text(F.lit(1), digit).alias("left"), text(digit + 2, F.lit(FAN)).alias("right"))
    rest = [c for c in cursor.columns if c not in ("tree", "idx", "digest", "path")]
    return met.select("tree", (F.col("idx") * FAN + digit).alias("idx"), F.get("children", digit).alias("digest"),
                      F.concat("path", F.array(segment)).alias("path"), "ask", *rest)


def _asked(rows: DataFrame, *more: str) -> DataFrame:
    """(tree, idx, asks): what is asked for below each node, by digits; ``rows`` (tree, idx, more) name each child once."""
    ask = F.struct((F.col("idx") % FAN).cast("int").alias("digit"), *more)
    return rows.groupBy("tree", F.shiftright("idx", 4).alias("idx")).agg(F.collect_list(ask).alias("asks"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(tree, rank, leaf, subroot, path, more) of the requested leaves; ``path`` holds (left, right) siblings from the leaf up.

    ``requests`` are some rows of ``manifest.leaves``, all of them if not given; their further columns come along. The
    digests on the path and the leaf come from the records alone. No requests give an empty table.
    """
    leaves = manifest.leaves if requests is None else requests
    keep = [c for c in leaves.columns if c not in ("tree", "rank", "depth", "leaf")]
    leaves = leaves.select("tree", F.col("rank").alias("idx"), "depth", *keep)
    wanted = [_asked(leaves.where("depth > 0"), *keep)]
    depths = manifest.sources.select("tree", "depth")
    while len(wanted) < manifest.depth:
        below = wanted[-1].select("tree", "idx").join(bounded(depths), "tree").where(F.col("depth") > len(wanted))
        wanted.append(_asked(cut(below)))
    # above the subroots
    asked = cut(leaves.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx")).distinct())
    cursor = cut(asked.limit(1).select("tree", F.lit(0).cast("long").alias("idx"), F.lit(manifest.root).alias("digest"), F.array().cast(SEGMENT).alias("path")))
    above = [_asked(asked)]
    while len(above) < manifest.upper_depth:
        above.append(_asked(above[-1].select("tree", "idx")))
    for height in range(manifest.upper_depth, 0, -1):
        here = manifest.records.where(F.col("upper") & (F.col("height") == height))
        cursor = cut(_down(cursor, here, above[height - 1]).drop("ask"))
    zero = F.lit(0).cast("long")
    tops = cut(cursor.select(F.col("idx").alias("tree"), zero.alias("idx"), "digest", "path", F.col("digest").alias("subroot")).join(depths, "tree"))
    # inside the sources: those of a depth join when their height is reached
    cursor = tops.limit(0).drop("depth")
    for height in range(manifest.depth, 0, -1):
        cursor = cursor.unionByName(tops.where(F.col("depth") == height).drop("depth"))
        here = manifest.records.where(~F.col("upper") & (F.col("height") == height))
        cursor = _down(cursor, here, wanted[height - 1])
        if height > 1:
            cursor = cut(cursor.drop("ask"))
    lone = leaves.where("depth = 0").join(tops.drop("idx"), "tree")
    out = lone.select("tree", "idx", "digest", "path", "subroot", *keep)
    if manifest.depth:
        out = cursor.select("tree", "idx", "digest", "path", "subroot", *[F.col("ask")[c].alias(c) for c in keep]).unionByName(out)
    return out.select("tree", F.col("idx").alias("rank"), F.col("digest").alias("leaf"), "subroot", F.reverse("path").alias("path"), *keep)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered() -> Column:
    """The leaf's digest after tampering: of doc_ids whose CRC-32 is divisible by 5 the text's A-Z are lower-cased; null doc_ids stay."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(struck & F.col("text").rlike("[A-Z]"), leaf_digest(text=F.translate("text", capitals, capitals.lower())))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:4]) + " || " + "{0})"


@query("op11_merkle_manifest", f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
               {_LEAF.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} AS changed,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                     lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 5 = 0 AS struck
        FROM documents),
    l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
    low AS (
        SELECT tree, 0 AS height, rank AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
        UNION ALL
        SELECT tree, height + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
        FROM low WHERE n > 1 GROUP BY tree, height, idx // 16, n),
    tops AS (SELECT tree, digest FROM low WHERE n = 1),
    up AS (
        SELECT 0 AS height, tree AS idx, digest, count(*) OVER () AS n FROM tops
        UNION ALL
        SELECT height + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
        FROM up WHERE n > 1 GROUP BY height, idx // 16, n),
    -- siblings of every leaf, level by level: those before it and those behind it
    step AS (
        SELECT l.tree, l.rank, a.height, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS prior,
               string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS after
        FROM l JOIN low a ON a.tree = l.tree AND a.idx = l.rank // (16 ** a.height)::BIGINT AND a.n > 1
        JOIN low b ON b.tree = a.tree AND b.height = a.height AND b.idx // 16 = a.idx // 16 GROUP BY l.tree, l.rank, a.height, a.idx
        UNION ALL
        SELECT l.tree, l.rank, 100 + a.height, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx),
               string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx)
        FROM l JOIN up a ON a.idx = l.tree // (16 ** a.height)::BIGINT AND a.n > 1
        JOIN up b ON b.height = a.height AND b.idx // 16 = a.idx // 16 GROUP BY l.tree, l.rank, a.height, a.idx),
    proof AS (
        SELECT l.tree, l.rank, coalesce(string_agg(coalesce(prior, '') || coalesce(after, ''), '' ORDER BY height) FILTER (height IS NOT NULL), '') AS siblings,
               coalesce(list([coalesce(prior, ''), coalesce(after, '')] ORDER BY height) FILTER (height IS NOT NULL), []) AS path
        FROM l LEFT JOIN step s ON s.tree = l.tree AND s.rank = l.rank GROUP BY l.tree, l.rank),
    done AS (
        SELECT l.doc_id, l.leaf, tops.digest AS subroot, (SELECT digest FROM up WHERE n = 1) AS root, sha256(siblings) AS proof_sha256,
               CASE WHEN len(path) = 0 THEN CASE WHEN struck THEN changed ELSE leaf END
                    ELSE list_reduce(list_prepend([CASE WHEN struck THEN changed ELSE leaf END], path),
                                     lambda own, s: [sha256(s[1] || own[1] || s[2])])[1] END AS folded_root
        FROM l JOIN proof p ON p.tree = l.tree AND p.rank = l.rank JOIN tops ON tops.tree = l.tree)
    SELECT *, folded_root = root AS verified FROM done""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a leaf, with its proof and the root after tampering."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    manifest = build(docs, more={"changed": tampered()})
    found = prove(manifest)
    root = F.lit(manifest.root).cast("string")
    found = found.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                         fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
