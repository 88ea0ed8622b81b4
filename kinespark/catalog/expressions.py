"""Scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, signal
from ..operators.matrices import dtw_cost
from . import query, table
from .relational import r


@query("truthy_parse", """
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN '1' WHEN 2 THEN 'no' WHEN 3 THEN 'Y'
           WHEN 4 THEN NULL ELSE event_type END AS w FROM events)
SELECT event_id, coalesce(lower(trim(w)) IN ('true', '1', 'yes', 'y', 't'), false) AS flag FROM t
""")
def truthy_parse(spark, sf):
    k = F.col("event_id") % 6
    word = (F.when(k == 0, " True ").when(k == 1, "1").when(k == 2, "no").when(k == 3, "Y")
            .when(k == 4, F.lit(None)).otherwise(F.col("event_type")))
    return table(spark, sf, "events").select("event_id", keys.truthy(word).alias("flag"))


@query("speed_tag", """
WITH s AS (SELECT *, round_even(o_totalprice / 1000 * 100, 0)::INT AS key FROM orders)
SELECT o_orderkey, lpad(key::VARCHAR, greatest(4, length(key::VARCHAR))::INT, '0') AS tag, key,
       CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE o_orderstatus END AS trial
FROM s
""")
def speed_tag(spark, sf):
    speed = F.col("o_totalprice") / 1000
    trial = F.when(F.col("o_orderkey") % 3 == 0, " nan").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", keys.speed_tag(speed).alias("tag"), keys.speed_key(speed).alias("key"),
        keys.trial_tag(trial).alias("trial"))


@query("pace_format", """
WITH s AS (SELECT c_custkey, c_acctbal / 1000 AS v FROM customer),
q AS (SELECT *, CASE WHEN v > 0 THEN round_even(1000 / v, 0)::BIGINT END AS sec FROM s)
SELECT c_custkey, CASE WHEN v > 0 THEN (sec // 60)::VARCHAR || ':' || lpad((sec % 60)::VARCHAR, 2, '0') ELSE 'N/A' END AS pace FROM q
""")
def pace_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", keys.pace(F.col("c_acctbal") / 1000).alias("pace"))


@query("list_parse", """
SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' ; ' || p_brand || ';; ' || p_type, ';'), lambda x: trim(x)), lambda x: x <> '') AS items,
       array_to_string(list_filter(list_transform(string_split(p_name || ' ; ' || p_brand || ';; ' || p_type, ';'), lambda x: trim(x)), lambda x: x <> ''), ';') AS joined
FROM part
""")
def list_parse(spark, sf):
    text = F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(";; "), "p_type")
    return table(spark, sf, "part").select("p_partkey", keys.split_list(text).alias("items"),
                                           keys.join_list(keys.split_list(text)).alias("joined"))


@query("condition_speed", """
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_retailprice / 100 END AS speed FROM part
""")
def condition_speed(spark, sf):
    number = (F.col("p_retailprice") / 100).cast("string")
    text = F.when(F.col("p_size") % 4 == 3, F.concat(number, F.lit(" km/h"))).otherwise(
        F.concat(F.lit(" "), number, F.lit(" m/s ")))
    return table(spark, sf, "part").select("p_partkey", keys.condition_speed(text).alias("speed"))


@query("crc32_seed", """
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
         string_split(source || '|' || lang || '|' || doc_id || '|5|0', ''), lambda ch: ord(ch)::BIGINT)),
       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
         lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)::BIGINT AS seed
FROM documents
""")
def crc32_seed(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", keys.seed32("source", "lang", "doc_id", F.lit(5), F.lit(0)).alias("seed"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents")
def sha256_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("time_normalise", f"""
WITH e AS ({VEC})
SELECT vec_id, list_transform(range(200), lambda i: round(v[least(floor(i * 63 / 199.0::DOUBLE)::INT, 62) + 1]
  + (v[least(floor(i * 63 / 199.0::DOUBLE)::INT, 62) + 2] - v[least(floor(i * 63 / 199.0::DOUBLE)::INT, 62) + 1])
  * (i * 63 / 199.0::DOUBLE - least(floor(i * 63 / 199.0::DOUBLE)::INT, 62)), 6)) AS profile FROM e
""")
def time_normalise(spark, sf):
    profile = signal.time_normalise("v", 200)
    return vectors(spark, sf).select("vec_id", F.transform(profile, lambda x: r(x)).alias("profile"))


@query("sign_standardise", f"""
WITH e AS ({VEC})
SELECT vec_id, list_max(v) < abs(list_min(v)) AS flipped, round(greatest(list_max(v), -list_min(v)), 6) AS peak,
  (list_position(v, list_max(v)) - 1)::BIGINT AS peak_at,
  round(list_sum(list_transform(v, lambda x: greatest(x, 0) / list_max(v))), 6) AS scaled_sum FROM e
""")
def sign_standardise(spark, sf):
    v = F.col("v")
    clipped = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    return vectors(spark, sf).select(
        "vec_id", (F.array_max(v) < F.abs(F.array_min(v))).alias("flipped"),
        r(F.array_max(signal.standardise_sign(v))).alias("peak"), signal.argmax(v).alias("peak_at"),
        r(signal.array_sum(signal.peak_normalise(clipped, F.array_max(v)))).alias("scaled_sum"))


@query("clip_fraction", f"""
WITH e AS ({VEC}), m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS rail FROM e)
SELECT vec_id, round(len(list_filter(v, lambda x: abs(x) >= greatest(0.0::DOUBLE, rail - 0.05::DOUBLE))) / len(v), 6) AS clip_frac FROM m
""")
def clip_fraction(spark, sf):
    return vectors(spark, sf).select("vec_id", r(signal.clip_fraction("v")).alias("clip_frac"))


@query("cosine_to_reference", f"""
WITH e AS ({VEC}), f AS (SELECT label, arg_min(v, vec_id) AS ref FROM e GROUP BY 1)
SELECT vec_id, e.label, round(list_cosine_similarity(v, ref), 6) AS cosine FROM e JOIN f ON e.label = f.label
""")
def cosine_to_reference(spark, sf):
    """Each vector against the first of its label: linear in the rows, never all pairs."""
    e = vectors(spark, sf)
    ref = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("ref"))
    return e.join(ref, "label").select("vec_id", "label", r(signal.cosine("v", "ref")).alias("cosine"))


@query("module_mean_waveform", f"""
WITH e AS ({VEC}), x AS (SELECT label, unnest(v) AS a, generate_subscripts(v, 1) - 1 AS t FROM e)
SELECT label, t::INT AS t, round(avg(a), 6) AS mean FROM x GROUP BY 1, 2
""")
def module_mean_waveform(spark, sf):
    long = vectors(spark, sf).select("label", F.posexplode("v").alias("t", "a"))
    return long.groupBy("label", "t").agg(r(F.avg("a")).alias("mean"))


@query("block_length", """
WITH n AS (SELECT l_partkey, count(*)::INT AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n, greatest(1, least(greatest(3, least(greatest(3, n // 8), floor(sqrt(n))::INT)), n))::INT AS b FROM n
""")
def block_length(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("int").alias("n"))
    return n.select("l_partkey", "n", signal.block_length("n").alias("b"))


@query("dtw_to_reference", f"""
WITH e AS ({VEC}), f AS (SELECT label, arg_min(v, vec_id) AS ref FROM e GROUP BY 1),
j AS (SELECT vec_id, v, ref FROM e JOIN f ON e.label = f.label),
d AS (SELECT vec_id, list_reduce(v, lambda prev, xi: list_reduce(list_zip(ref, range(64)), lambda row, c:
   list_append(row, abs(xi - c[1]) + least(prev[c[2] + 1], prev[c[2] + 2], row[-1])), ['inf'::DOUBLE]),
   list_concat([0.0::DOUBLE], list_transform(range(64), lambda i: 'inf'::DOUBLE))) AS last FROM j)
SELECT vec_id, round(last[65], 6) AS dtw FROM d
""")
def dtw_to_reference(spark, sf):
    e = vectors(spark, sf)
    ref = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("ref"))
    return e.join(ref, "label").select("vec_id", r(dtw_cost("v", "ref")).alias("dtw"))
