"""Exact near-duplicate classes by word shingles: prefix filters under several global orders, then verification.

Sets with a Jaccard similarity of ``t`` or more share a token among their first ``n - ceil(t n) + 1`` tokens under
EVERY global order of the tokens. The first order is by corpus frequency (rare first), so that passages which many
documents share stay out of the prefixes; it makes the inverted index. The others run through the token hash upwards
and downwards; candidates must also share prefix tokens there before their sets are compared. With prefixes that are
``l - 1`` tokens longer, similar sets share ``l`` tokens in them, which chance seldom brings about.

Only class representatives of equal sets take part. Pairs inside an index list are never all written: long lists are
tested against hubs, and what is left apart is compared in blocks that return one link for each pair of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, bounded, bucketed, cut, query, sorted_groups, starts_of, table
from .components import connected_components
from .text import mix, shingle_sets

WIDTH = 5
#: similarity as a fraction of whole numbers
NUM, DEN = 75, 100
#: frequency counters (bits of the token hash); collisions change the order, never the result
SKETCH_BITS = 20
SKETCH_BLOCKS = 16
#: lists up to this length give all their pairs, longer ones go by hubs and blocks
SHORT_LIST = 64
#: random list choices per document in the block stage
PICKS = 16
#: documents of one side of a block
BLOCK = 500

_DOCS = "kind int, doc_id long, n long, sid long, block int, counts binary"
_SHIFT = np.uint64(64 - SKETCH_BITS)


def _sid(tokens: np.ndarray) -> int:
    """Identity of a set: two independent sums over its tokens and its size, mixed to 64 bits."""
    seed = np.array([len(tokens)], np.uint64)
    with np.errstate(over="ignore"):
        seed = mix(seed + mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
        seed = mix(seed ^ mix(tokens + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return int(seed.view(np.int64)[0])


def _census(width: int):
    """Per document its set size and identity; per task the counts of token slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SKETCH_BITS, np.int64)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()),
                            ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            n, sid, parts, seen = [], [], [], 0
            for _, tokens in shingle_sets(batch.column(1), width):
                n.append(len(tokens))
                sid.append(_sid(tokens) if len(tokens) else None)
                parts.append(tokens >> _SHIFT)
                seen += len(tokens)
                if seen > 1 << 20:
                    slots += np.bincount(np.concatenate(parts).astype(np.int64), minlength=len(slots))
                    parts, seen = [], 0
            if parts:
                slots += np.bincount(np.concatenate(parts).astype(np.int64), minlength=len(slots))
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), batch.column(0), pa.array(n, pa.int64()),
                                              pa.array(sid, pa.int64()), pa.nulls(rows, pa.int32()),
                                              pa.nulls(rows, pa.binary())], schema=schema)
        if slots.any():
            pieces = [x.tobytes() for x in np.split(np.minimum(slots, 0xFFFFFFFF).astype("<u4"), SKETCH_BLOCKS)]
            nothing = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * SKETCH_BLOCKS, pa.int32()), nothing, nothing, nothing,
                                              pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(pieces, pa.binary())],
                                             schema=schema)
    return run


def _add_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the count arrays of one block; they arrive one by one."""
    total = None
    for batch in batches:
        for piece in binaries(batch.column("counts"), "<u4"):
            total = piece.astype(np.int64) if total is None else total + piece
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                     names=["block", "counts"])


def _frequencies(census: DataFrame) -> np.ndarray:
    """The counters of all documents: a fixed number, whatever the input."""
    rows = (census.where("kind = 1").select("block", "counts").groupBy("block")
            .applyInArrow(_add_counts, "block int, counts binary").collect())
    slots = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in rows:
        slots[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(slots.ravel(), (1 << 24) - 1).astype(np.uint32)


def _prefix_length(n):
    """Tokens of the prefix of a set of n: n - ceil(t n) + 1."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _needed(n):
    """Tokens that the frequency prefixes of two sets must share (the smaller number of the two sets)."""
    return 1 + n // 25


def _needed_of_smaller(n: F.Column) -> F.Column:
    """The number needed with the smallest set that can be similar to one of n tokens."""
    return 1 + F.floor(F.floor(n * NUM / DEN) / 25)


def _rare_prefix(tokens: np.ndarray, slots: np.ndarray) -> np.ndarray:
    key = (slots[(tokens >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (tokens >> np.uint64(24))
    return tokens[np.argsort(key, kind="stable")[:_prefix_length(len(tokens)) + _needed(len(tokens)) - 1]]


def _index(width: int, sketch):
    """(token, sid, n) of every prefix token under the frequency order; equal sets of a task are taken once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, seen = sketch.value, set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for _, t in shingle_sets(batch.column(0), width):
                if len(t) and (sid := _sid(t)) not in seen:
                    seen.add(sid)
                    tokens.append(_rare_prefix(t, slots))
                    sids.append(sid)
                    sizes.append(len(t))
            if tokens:
                lengths = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), lengths)),
                     pa.array(np.repeat(np.array(sizes, np.int32), lengths))], names=["token", "sid", "n"])
    return run


def _fits(a, b):
    """Sizes between which the similarity can be reached."""
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def _runs(part: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(token, distinct sids ascending, sizes) of the lists with two sets or more; input sorted by token, sid."""
    token, sid, n = (part[c].to_numpy() for c in ("token", "sid", "n"))
    first = starts_of(token, sid)[:-1]
    token, sid, n = token[first], sid[first], n[first]
    cuts = starts_of(token)
    for i in np.flatnonzero(np.diff(cuts) > 1):
        lo, hi = cuts[i], cuts[i + 1]
        yield int(token[lo]), sid[lo:hi], n[lo:hi]


def _hub_pairs(token: int, salt: int, sid: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of other components against one member; the smallest first, later ones by chance."""
    hub = int(np.argmin(sid)) if not salt else int((token * 0x9E3779B1 + salt * 0x85EBCA77) % len(sid))
    other = (comp != comp[hub]) & _fits(n, n[hub])
    return np.minimum(sid[other], sid[hub]), np.maximum(sid[other], sid[hub])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lists with two sets or more: pairs of short ones with the number of lists and the number needed, hub pairs
    of long ones (a quarter of it is enough: they only save work later), the members of long ones (with a token), and
    how many lists each set is in (without b)."""
    for part in sorted_groups(batches, ["token"]):
        pairs, rows, members = [], [], []
        for token, sid, n in _runs(part):
            members.append(sid)
            if len(sid) <= SHORT_LIST:
                i, j = np.triu_indices(len(sid), 1)
                keep = _fits(n[i], n[j])
                i, j = i[keep], j[keep]
                pairs.append(np.stack([sid[i], sid[j], _needed(np.minimum(n[i], n[j]))], 1))
            else:
                x, y = _hub_pairs(token, 0, sid, n, sid)
                pairs.append(np.stack([x, y, np.full(len(x), _needed(int(n.min())) // 4)], 1))
                rows.append((token, sid, n))
        if pairs:
            found, count = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            yield _list_batch(None, found[:, 0], found[:, 1], count, found[:, 2])
            sid, count = np.unique(np.concatenate(members), return_counts=True)
            yield _list_batch(None, sid, None, count, None)
        for token, sid, n in rows:
            yield _list_batch(token, sid, None, n, None)


def _list_batch(token, a, b, n, need) -> pa.RecordBatch:
    rows = len(a)
    fill = lambda x: pa.nulls(rows, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64))
    columns = [None if token is None else np.full(rows, token), a, b, n, need]
    return pa.RecordBatch.from_arrays([fill(c) for c in columns], names=["token", "a", "b", "n", "need"])


def _hubs(salt: int):
    """Pairs between a chance hub of every long list and its members of other components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["token"]):
            token, sid, n, comp = (part[c].to_numpy() for c in ("token", "sid", "n", "comp"))
            cuts, found = starts_of(token), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                found.append(np.stack(_hub_pairs(int(token[lo]), salt, sid[lo:hi], n[lo:hi], comp[lo:hi]), 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a long list that no block has compared (they share no pick)."""
    for part in sorted_groups(batches, ["token"]):
        token, sid, n, comp = (part[c].to_numpy() for c in ("token", "sid", "n", "comp"))
        picks = np.stack([part[f"p{k}"].to_numpy() for k in range(PICKS)], 1)
        cuts = starts_of(token)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            c = comp[lo:hi]
            values, count = np.unique(c, return_counts=True)
            outside = np.flatnonzero(c != values[np.argmax(count)])
            a, b = [], []
            for o in outside:
                other = (c != c[o]) & _fits(n[lo:hi], n[lo + o]) & ~(picks[lo:hi] == picks[lo + o]).any(axis=1)
                a.append(np.minimum(sid[lo:hi][other], sid[lo + o]))
                b.append(np.maximum(sid[lo:hi][other], sid[lo + o]))
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _sets(width: int):
    """(sid, ascending tokens) of every distinct set of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sids, blobs = [], []
            for _, t in shingle_sets(batch.column(0), width):
                if len(t) and (sid := _sid(t)) not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    blobs.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())],
                                             names=["sid", "tokens"])
    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending token arrays reach the similarity; cheaper orders first."""
    pa_, pb = _prefix_length(len(a)), _prefix_length(len(b))
    if not _share(a[:pa_], b[:pb]) or not _share(a[-pa_:], b[-pb:]):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def _share(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return bool((b[np.minimum(at, len(b) - 1)] == a).any())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (binaries(batch.column(c), np.uint64) for c in ("ta", "tb"))
        keep = np.fromiter((similar(x, y) for x, y in zip(left, right, strict=True)), bool, len(left))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link for every two components that a block joins; all pairs of the block are compared by counting."""
    for part in sorted_groups(batches, ["pick", "i", "j"]):
        keys = [part[c].to_numpy() for c in ("pick", "i", "j")]
        sid, comp, at = (part[c].to_numpy() for c in ("sid", "comp", "at"))
        tokens = binaries(part["tokens"], np.uint64)
        cuts, found = starts_of(*keys), []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            left = [r for r in range(lo, hi) if at[r] == keys[1][lo]]
            right = [r for r in range(lo, hi) if at[r] == keys[2][lo]]
            found += _block_links(left, right, sid, comp, tokens)
        links = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _block_links(left, right, sid, comp, tokens) -> list[tuple[int, int]]:
    """Links between the components of two sides (one per merge), by an inverted list of the left side."""
    if not left or not right:
        return []
    sizes = np.array([len(tokens[r]) for r in left])
    flat = np.concatenate([tokens[r] for r in left])
    owner = np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    above = {int(c): int(c) for c in np.unique(comp[np.array(left + right)])}

    def root(c):
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c
    links = []
    for r in right:
        t = tokens[r]
        lo, hi = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
        width = hi - lo
        hit = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        common = np.bincount(owner[hit], minlength=len(left))
        for k in np.flatnonzero(DEN * common >= NUM * (sizes + len(t) - common)):
            x, y = root(int(comp[left[k]])), root(int(comp[r]))
            if x != y:
                above[max(x, y)] = min(x, y)
                links.append((int(sid[left[k]]), int(sid[r])))
    return links


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_verify, "a long, b long")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Long-list rows with their component, only of lists that still hold several components."""
    labels = connected_components(links)
    rows = rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "comp", F.coalesce("component", "sid")).drop("component")
    open_lists = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return cut(rows.join(open_lists.select("token"), "token", "left_semi"))


def _by_list(rows: DataFrame) -> DataFrame:
    return rows.repartition(_partitions(rows.sparkSession), "token").sortWithinPartitions("token", "sid")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _block_stage(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found in blocks, and the rows with the lists that each set picked.

    Each set picks ``PICKS`` of its long lists by the smallest hashes; sets with a common pick meet in its blocks. The
    largest component of a pick is not compared with itself.
    """
    picked = rows.groupBy("sid").agg(F.first("comp").alias("comp"), *[
        F.min_by("token", F.xxhash64("token", F.lit(k))).alias(f"p{k}") for k in range(PICKS)])
    picked = cut(picked)
    members = picked.select("sid", "comp", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PICKS)]))).alias("pick"))
    sizes = members.groupBy("pick", "comp").agg(F.count("*").alias("c"))
    groups = sizes.groupBy("pick").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"),
                                       F.count("*").alias("comps")).where("comps > 1")
    groups = groups.select("pick", F.col("top.comp").alias("main"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("nm"),
                           F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("no"))
    dealt = members.join(groups, "pick").withColumn("at", F.when(
        F.col("comp") == F.col("main"), F.col("no") + F.pmod(F.xxhash64("sid"), F.col("nm")).cast("int")).otherwise(
        F.pmod(F.xxhash64("sid"), F.col("no")).cast("int")))
    last = F.when(F.col("at") < F.col("no"), F.col("no") + F.col("nm") - 1).otherwise(F.col("no") - 1)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last))).select(
        "pick", "sid", "comp", "at", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))
    met = dealt.join(sets, "sid")
    links = met.repartition(_partitions(rows.sparkSession), "pick", "i", "j").sortWithinPartitions("pick", "i", "j").mapInArrow(
        _blocks, "a long, b long")
    return links, rows.join(picked.drop("comp"), "sid")


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, hub_rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are not looked at).

    The component is the smallest doc_id reachable over links of Jaccard similarity 0.75 or more between the sets of
    ``width``-word shingles. Null and wordless texts have no shingles and are alone; a text shorter than ``width``
    words is one shingle. Repeated rows are equal sets and thus linked, each row has its result row. A null doc_id is
    never the smallest unless its whole component has none. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    census = cut(texts.mapInArrow(_census(width), _DOCS))
    found = census.where("kind = 0").select("doc_id", "n", "sid")
    classes = cut(found.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep")))
    sketch = spark.sparkContext.broadcast(_frequencies(census))

    index = texts.select("text").mapInArrow(_index(width, sketch), "token long, sid long, n int")
    lists = cut(index.repartition(_partitions(spark), "token").sortWithinPartitions("token", "sid").mapInArrow(
        _lists, "token long, a long, b long, n long, need long"))
    # a pair that also meets in a long list may fall short here: the stages of the long lists have all their pairs
    pairs = lists.where("token is null and b is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    pairs = cut(pairs.where("n >= need").select("a", "b"))
    # a set in fewer lists than any similar one must share with it is out of the long ones; the partner may be smaller
    shared = lists.where("token is null and b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("lists"))
    rows = lists.where("token is not null").select("token", F.col("a").alias("sid"), "n").join(shared, "sid")
    rows = cut(rows.where(F.col("lists") >= _needed_of_smaller(F.col("n"))).drop("lists"))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(rows.select("sid")).distinct()
    holders = cut(classes.join(wanted, "sid", "left_semi"))
    ids = bounded(holders.select(F.col("rep").alias("id")))
    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # a repeated doc_id may bring other sets along; a set that comes twice gives links twice, no other ones. The table is
    # bucketed by sid: no later join moves the sets again
    sets = chosen.select("text").mapInArrow(_sets(width), "sid long, tokens binary")
    sets = sets.join(bounded(holders.select("sid")), "sid", "left_semi")
    sets, drop_sets = bucketed(sets, "sid")

    links = cut(_checked(pairs, sets))
    tested = pairs
    rows = _labelled(rows, links)
    for salt in range(1, hub_rounds + 1):
        if rows.isEmpty():
            break
        more = cut(_by_list(rows).mapInArrow(_hubs(salt), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(more)
        links = cut(links.unionByName(_checked(more, sets)))
        rows = _labelled(rows.drop("comp"), links)
    if not rows.isEmpty():
        met, rows = _block_stage(rows, sets)
        apart = _by_list(rows).mapInArrow(_apart, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        links = cut(links.unionByName(met).unionByName(_checked(apart, sets)))

    drop_sets()
    labels = connected_components(links).withColumnRenamed("node", "sid")
    named = classes.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("sid", "component_id")
    return found.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of every near-duplicate class (the smallest doc_id stays).

    Rows whose doc_id is null stay. Of repeated rows with one doc_id all stay or go: exact copies are the task of exact
    deduplication.
    """
    gone = near_duplicate_classes(docs).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
