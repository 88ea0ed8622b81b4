"""Lookups, pairs, selection, set operations and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, selection
from ..plans import floors as floor_plan
from ..session import cut_lineage
from . import query, table


def r(col, digits: int = 6):
    """Rounded value that keeps the sign of what it rounds, as SQL's does: a small negative number becomes -0.0, not 0.0."""
    value = F.col(col) if isinstance(col, str) else col
    near = F.round(value, digits)
    return F.when(near == 0, value * 0.0).otherwise(near)


def year(col: str):
    return F.year(col).cast("bigint")


@query("rank_select", """
WITH fits AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS k, max(1 - l_discount) AS vaf_total, max(1 - 4 * l_tax) AS vaf_min
  FROM lineitem GROUP BY 1, 2),
top AS (SELECT *, max(vaf_total) OVER (PARTITION BY l_orderkey) AS mx,
               count(*) OVER (PARTITION BY l_orderkey) AS nk FROM fits),
pick AS (
  SELECT l_orderkey, max(mx) AS mx, max(nk) AS nk,
         min(CASE WHEN vaf_total >= 0.95::DOUBLE AND vaf_min >= 0.75::DOUBLE THEN k END) AS thr,
         min(CASE WHEN vaf_total >= mx - 0.01::DOUBLE THEN k END) AS near
  FROM top GROUP BY 1)
SELECT p.l_orderkey, coalesce(thr, near) AS chosen_k,
       CASE WHEN thr IS NOT NULL THEN 'thresholds' ELSE 'within_0.01_of_max_vaf' END AS chosen_rule,
       round(mx, 6) AS max_vaf_total, nk::BIGINT AS n_k_evaluated, round(f.vaf_total, 6) AS vaf_total,
       round(f.vaf_min, 6) AS vaf_min
FROM pick p JOIN fits f ON f.l_orderkey = p.l_orderkey AND f.k = coalesce(thr, near)
""")
def rank_select(spark, sf):
    fits = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k")).agg(
        F.max(1 - F.col("l_discount")).alias("vaf_total"), F.max(1 - 4 * F.col("l_tax")).alias("vaf_min"))
    chosen = selection.select_rank(fits, ["l_orderkey"], total_target=0.95)
    return chosen.select("l_orderkey", "chosen_k", "chosen_rule", r("max_vaf_total").alias("max_vaf_total"),
                         "n_k_evaluated", r("vaf_total").alias("vaf_total"), r("vaf_min").alias("vaf_min"))


@query("exactly_one_lookup", """
SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def exactly_one_lookup(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    found = joins.lookup(customers, nations, ["n_nationkey"], "nation")
    return found.groupBy("n_name").agg(F.count("*").alias("n_customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("single_or_null_lookup", """
WITH one AS (SELECT p_brand, p_size, count(*) AS n, max(p_partkey) AS p_partkey FROM part
             WHERE p_type = 'ECONOMY' GROUP BY 1, 2)
SELECT d.p_brand, d.p_size, CASE WHEN n = 1 THEN p_partkey END AS only_part
FROM (SELECT DISTINCT p_brand, p_size FROM part) d LEFT JOIN one USING (p_brand, p_size)
""")
def single_or_null_lookup(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.select("p_brand", "p_size").distinct()
    return joins.lookup_or_null(wanted, part.where("p_type = 'ECONOMY'"), ["p_brand", "p_size"],
                                "p_partkey", "only_part")


@query("tolerance_lookup", """
SELECT c_custkey, count(s_suppkey) AS n_matches, CASE WHEN count(s_suppkey) = 1 THEN max(s_suppkey) END AS s_suppkey
FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 150 + 1e-12
GROUP BY 1
""")
def tolerance_lookup(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey",
                                               F.col("c_acctbal").alias("balance"))
    right = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey",
                                                F.col("s_acctbal").alias("balance"))
    hits = joins.tolerance_lookup_one(left, right, ["nation"], "c_custkey", "balance", 150.0)
    return hits.select("c_custkey", "n_matches", F.col("right_s_suppkey").alias("s_suppkey"))


@query("nearest_lookup", """
WITH c AS (SELECT c_custkey, s_acctbal, row_number() OVER (
             PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_acctbal) AS rn
           FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT c.c_custkey, round(n.s_acctbal, 6) AS nearest
FROM customer c LEFT JOIN c n ON n.c_custkey = c.c_custkey AND n.rn = 1
""")
def nearest_lookup(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey",
                                               F.col("c_acctbal").alias("balance"))
    right = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"),
                                                F.col("s_acctbal").alias("balance"))
    found = joins.nearest_lookup(left, right, ["nation"], "c_custkey", "balance", chunk_width=500.0)
    return found.select("c_custkey", r("nearest").alias("nearest"))


@query("nearest_tie_larger", """
WITH t AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_type = 'LARGE'),
c AS (SELECT p.p_partkey, t.p_size, row_number() OVER (
        PARTITION BY p.p_partkey ORDER BY abs(t.p_size - p.p_size), t.p_size DESC) AS rn
      FROM part p JOIN t ON t.p_brand = p.p_brand)
SELECT p.p_partkey, c.p_size::DOUBLE AS nearest FROM part p LEFT JOIN c ON c.p_partkey = p.p_partkey AND rn = 1
""")
def nearest_tie_larger(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    tested = part.where("p_type = 'LARGE'").select("p_brand", "p_size")
    found = joins.nearest_lookup(part.drop("p_type"), tested, ["p_brand"], "p_partkey", "p_size",
                                 prefer_larger=True, chunk_width=10.0)
    return found.select("p_partkey", "nearest")


def nation_years(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", year("o_orderdate").alias("year"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(customers, "o_custkey").groupBy("c_nationkey", "year").agg(
        F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))


NATION_YEARS = """SELECT c_nationkey, year(o_orderdate)::BIGINT AS year, avg(o_totalprice) AS price, count(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"""


@query("ordered_pairs", f"""
WITH g AS ({NATION_YEARS})
SELECT a.c_nationkey, a.year AS year_a, b.year AS year_b, a.n AS n_a, b.n AS n_b, round(a.price / b.price, 6) AS ratio
FROM g a JOIN g b ON a.c_nationkey = b.c_nationkey AND a.year <> b.year
""")
def ordered_pairs(spark, sf):
    pairs = joins.ordered_pairs(nation_years(spark, sf), ["c_nationkey"], "year")
    return pairs.select("c_nationkey", "year_a", "year_b", "n_a", "n_b",
                        r(F.col("price_a") / F.col("price_b")).alias("ratio"))


@query("ref_to_slower", f"""
WITH g AS ({NATION_YEARS}), m AS (SELECT *, max(year) OVER (PARTITION BY c_nationkey) AS top FROM g)
SELECT q.c_nationkey, f.year AS ref_year, q.year AS q_year, round(f.price - q.price, 4) AS gap
FROM m q JOIN m f ON f.c_nationkey = q.c_nationkey AND f.year = f.top AND q.year < f.year
""")
def ref_to_slower(spark, sf):
    pairs = joins.reference_pairs(nation_years(spark, sf), ["c_nationkey"], "year")
    return pairs.select("c_nationkey", "ref_year", "q_year", r(F.col("ref_price") - F.col("q_price"), 4).alias("gap"))


@query("resume_antijoin", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def resume_antijoin(spark, sf):
    todo = table(spark, sf, "customer").select("c_custkey", "c_name")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.remaining(todo, done, ["c_custkey"])


@query("partner_semijoin", """
SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)
""")
def partner_semijoin(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    rich = table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation"))
    return joins.with_partner(suppliers, rich, ["nation"]).select("s_suppkey", "s_name")


@query("upsert_union", """
WITH old AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2),
fresh AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer
          WHERE c_nationkey < 5 AND c_acctbal > 0 GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n, NULL::VARCHAR AS note FROM old
WHERE c_nationkey NOT IN (SELECT c_nationkey FROM fresh)
UNION ALL SELECT c_nationkey, c_mktsegment, n, 'rerun' FROM fresh
""")
def upsert_union(spark, sf):
    customer = table(spark, sf, "customer")
    keys = ["c_nationkey", "c_mktsegment"]
    old = customer.groupBy(*keys).agg(F.count("*").alias("n"))
    fresh = (customer.where("c_nationkey < 5 AND c_acctbal > 0").groupBy(*keys).agg(F.count("*").alias("n"))
             .withColumn("note", F.lit("rerun")))
    return joins.replace_keys(old, fresh, ["c_nationkey"])


@query("set_intersection", """
WITH s AS (SELECT c_mktsegment, c_custkey, count(DISTINCT o_orderpriority) AS np
           FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT c_mktsegment, c_custkey FROM s WHERE np = 5),
n AS (SELECT c_mktsegment, count(*) AS n_common FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT k.c_mktsegment, k.c_custkey, n_common FROM k JOIN n USING (c_mktsegment)
""")
def set_intersection(spark, sf):
    """Customers of each segment who have orders of every priority."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey")
    return selection.common_items(rows, ["c_mktsegment"], "c_custkey", "o_orderpriority", 5, min_items=3)


@query("left_equi_dedup", """
WITH best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey,
                                           l_linenumber, l_suppkey) AS rn FROM lineitem)
SELECT o_orderkey, round(l_extendedprice, 2) AS top_price, l_partkey AS top_part
FROM orders LEFT JOIN best ON l_orderkey = o_orderkey AND rn = 1
""")
def left_equi_dedup(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_linenumber",
                                                "l_suppkey")
    best = selection.top_row(lines, ["l_orderkey"], [-F.col("l_extendedprice"), F.col("l_partkey"),
                                                     F.col("l_linenumber"), F.col("l_suppkey")], lowest=True)
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", r("l_extendedprice", 2).alias("top_price"), F.col("l_partkey").alias("top_part"))


@query("first_nonnull_per_group", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS bought,
                  CASE WHEN event_type = 'error' THEN props END AS fault FROM events)
SELECT user_id, arg_min(bought, event_id) FILTER (WHERE bought IS NOT NULL) AS bought,
       arg_min(fault, event_id) FILTER (WHERE fault IS NOT NULL) AS fault FROM e GROUP BY 1
""")
def first_nonnull_per_group(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("fault"))
    return selection.first_values(e, ["user_id"], ["event_id"]).select("user_id", "bought", "fault")


@query("value_counts", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value >= 100) AS high,
       round(min(value), 6) AS lo, round(avg(value), 6) AS mean, round(max(value), 6) AS hi
FROM events GROUP BY 1
""")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("value") >= 100).alias("high"), r(F.min("value")).alias("lo"),
        r(F.avg("value")).alias("mean"), r(F.max("value")).alias("hi")).orderBy("event_type")


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query("pivot_complete_case", f"""
WITH w AS (SELECT o_custkey, {", ".join(f"avg(o_totalprice) FILTER (WHERE o_orderpriority = '{k}') AS {v}" for k, v in PRIORITIES.items())}
  FROM orders GROUP BY 1)
SELECT o_custkey, {", ".join(f"round({v}, 6) AS {v}" for v in PRIORITIES.values())} FROM w
WHERE {" AND ".join(f"{v} IS NOT NULL" for v in PRIORITIES.values())}
""")
def pivot_complete_case(spark, sf):
    wide = selection.complete_pivot(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", list(PRIORITIES), "o_totalprice")
    return wide.select("o_custkey", *[r(F.col(f"`{k}`")).alias(v) for k, v in PRIORITIES.items()])


@query("channel_shift", """
WITH u AS (SELECT l_orderkey, max(l_linenumber) AS mx FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_partkey, (l_linenumber + 1 - CASE WHEN mx + 1 > 7 THEN mx + 1 - 7 ELSE 0 END)::INT AS channel
FROM lineitem l JOIN u USING (l_orderkey)
""")
def channel_shift(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey",
                                                (F.col("l_linenumber") + 1).alias("channel"))
    return joins.shifted_channels(lines, ["l_orderkey"], "channel", F.lit(7))


@query("channel_map_unpivot", """
WITH w AS (SELECT l_orderkey::INT AS subject, l_linenumber || '-' || l_partkey AS condition, trunc(l_quantity)::INT AS q,
                  trunc(l_discount * 100)::INT AS d, trunc(l_tax * 100)::INT AS t FROM lineitem)
SELECT subject, condition, 'quantity' AS muscle, q AS channel_num FROM w
UNION ALL SELECT subject, condition, 'discount', d FROM w
UNION ALL SELECT subject, condition, 'tax', t FROM w
""")
def channel_map_unpivot(spark, sf):
    """Order lines as a wide channel sheet."""
    from ..sources.tables import read_channel_map
    sheet = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Subject"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("Condition"),
        F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"))
    return read_channel_map(sheet, ["quantity", "discount", "tax"])


@query("manifest_verify", """
WITH files AS (SELECT 'doc/' || doc_id AS file, sha256(text) AS h, lang, source FROM documents),
manifest AS (SELECT 'doc/' || doc_id AS file, CASE WHEN lang = 'fr' THEN sha256(text || '!') ELSE upper(sha256(text)) END AS h
             FROM documents)
SELECT m.file, CASE WHEN f.file IS NULL THEN 'MISSING' WHEN lower(f.h) <> lower(m.h) THEN 'MISMATCH' ELSE 'OK' END AS status
FROM manifest m LEFT JOIN (SELECT * FROM files WHERE source <> 'src0') f ON f.file = m.file
""")
def manifest_verify(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    slash = F.concat(F.lit("doc\\"), F.col("doc_id").cast("string"))
    wrong = F.sha2(F.concat("text", F.lit("!")), 256)
    manifest = docs.select(slash.alias("file"), F.when(F.col("lang") == "fr", wrong).otherwise(
        F.upper(F.sha2("text", 256))).alias("sha256"))
    files = docs.where("source <> 'src0'").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.sha2("text", 256).alias("sha256"))
    return joins.verify_manifest(manifest, files).select("file", "status")


def monthly_gates(spark, sf):
    """Brands tested over months against their own bounds."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_discount", "l_tax", "l_quantity",
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
    brands = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("subject"))
    monthly = lines.join(brands, "p_partkey").groupBy("subject", "month").agg(
        F.avg(1 - F.col("l_discount")).alias("forward"), F.avg(1 - F.col("l_tax")).alias("backward"),
        F.avg("l_quantity").alias("load"))
    bounds = monthly.groupBy("subject").agg(
        (F.avg("forward") - 1.2 * F.stddev_samp("forward")).alias("lower"),
        (F.avg("load") + 1.5 * F.stddev_samp("load")).alias("upper"))
    return monthly.join(bounds, "subject").select(
        "subject", "month", "forward", "backward", "load", "lower", "upper",
        (F.col("forward") >= F.col("lower")).alias("g1"), (F.col("backward") >= F.col("lower")).alias("g2"),
        (F.col("load") <= F.col("upper")).alias("g3"),
        (F.col("forward") - F.col("lower")).alias("margin_forward"),
        (F.col("upper") - F.col("load")).alias("margin_load"),
        (F.year("month") * 100 + F.month("month")).cast("double").alias("stage"))


MONTHLY_GATES = """
m AS (SELECT p_brand AS subject, date_trunc('month', l_shipdate)::DATE AS month, avg(1 - l_discount) AS forward,
             avg(1 - l_tax) AS backward, avg(l_quantity) AS load
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
b AS (SELECT subject, avg(forward) - 1.2::DOUBLE * stddev_samp(forward) AS lower,
             avg(load) + 1.5::DOUBLE * stddev_samp(load) AS upper FROM m GROUP BY 1),
g AS (SELECT m.*, lower, upper, coalesce(forward >= lower, false) AS g1, coalesce(backward >= lower, false) AS g2,
             coalesce(load <= upper, false) AS g3, (year(month) * 100 + month(month))::DOUBLE AS stage
      FROM m JOIN b USING (subject)),
s AS (SELECT *, g1 AND g2 AND g3 AS pass, coalesce(bool_and(g1 AND g2 AND g3) OVER (
        PARTITION BY subject ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS considered,
        CASE WHEN NOT g1 THEN 'g1' WHEN NOT g2 THEN 'g2' WHEN NOT g3 THEN 'g3' END AS failed_gate FROM g)"""


@query("sequential_gates", f"""
WITH {MONTHLY_GATES} SELECT subject, stage, pass, considered, failed_gate FROM s
""")
def sequential_gates(spark, sf):
    gated = selection.sequential_gates(monthly_gates(spark, sf), ["subject"], "month", ["g1", "g2", "g3"])
    return gated.select("subject", "stage", "pass", "considered", "failed_gate")


@query("sequential_floor", f"""
WITH {MONTHLY_GATES},
f AS (SELECT subject, max(stage) FILTER (WHERE pass AND considered) AS floor,
             min(stage) FILTER (WHERE NOT pass AND considered) AS fail_stage FROM s GROUP BY 1)
SELECT f.subject, coalesce(floor, 0.0) AS floor_speed_mps, fail_stage AS first_failed_speed_mps,
       s.failed_gate AS first_failure_gate, fail_stage IS NULL AS all_speeds_pass,
       round(s.forward - s.lower, 6) AS fail_margin_forward, round(s.upper - s.load, 6) AS fail_margin_load
FROM f LEFT JOIN s ON s.subject = f.subject AND s.stage = f.fail_stage
""")
def sequential_floor(spark, sf):
    gated = selection.sequential_gates(monthly_gates(spark, sf), ["subject"], "month", ["g1", "g2", "g3"])
    out = selection.floors(gated, ["subject"], "month", "stage", 0.0, ["margin_forward", "margin_load"])
    return out.withColumn("fail_margin_forward", r("fail_margin_forward")).withColumn(
        "fail_margin_load", r("fail_margin_load"))


@query("coordination_floors", """
WITH c AS (SELECT c_nationkey AS subject, o_orderpriority AS prio, avg(o_totalprice) / 1e6 AS f1,
                  quantile_cont(o_totalprice, 0.4) / 1e6 AS f2, stddev_samp(o_totalprice) / 1e6 AS d
           FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
k AS (SELECT subject, CASE prio WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 3 END AS seq,
             CASE prio WHEN '2-HIGH' THEN 4.0 WHEN '3-MEDIUM' THEN 3.33 WHEN '4-NOT SPECIFIED' THEN 3.0 ELSE 2.78 END AS spd,
             f1, f2, d FROM c WHERE prio <> '1-URGENT'),
b AS (SELECT subject, 0.93::DOUBLE * f1 AS lf, 0.8::DOUBLE * f2 AS lc, 1.3::DOUBLE * d AS ud FROM c WHERE prio = '1-URGENT'),
g AS (SELECT k.*, f1 >= lf AS g1, f2 >= 0.7::DOUBLE * lf AS g2, f1 > 0.22::DOUBLE AS g3, f2 >= lc AS g5, d <= ud AS g6,
             f1 - lf AS margin FROM k JOIN b USING (subject)),
s AS (SELECT *, g1 AND g2 AS pp, g1 AND g2 AND g3 AND g5 AND g6 AS p7,
        coalesce(bool_and(g1 AND g2) OVER w, true) AS cp,
        coalesce(bool_and(g1 AND g2 AND g3 AND g5 AND g6) OVER w, true) AS c7 FROM g
      WINDOW w AS (PARTITION BY subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT subject, coalesce(min(spd) FILTER (WHERE pp AND cp), 5.0)::DOUBLE AS floor_speed_mps,
       (max(spd) FILTER (WHERE NOT pp AND cp))::DOUBLE AS first_failed_speed_mps,
       max(CASE WHEN NOT pp AND cp THEN CASE WHEN NOT g1 THEN 'g1' ELSE 'g2' END END) AS first_failure_gate,
       round(max(margin) FILTER (WHERE NOT pp AND cp), 6) AS fail_margin_fid_ref,
       coalesce(min(spd) FILTER (WHERE p7 AND c7), 5.0)::DOUBLE AS floor_speed_mps_7gate,
       max(CASE WHEN NOT p7 AND c7 THEN CASE WHEN NOT g1 THEN 'g1' WHEN NOT g2 THEN 'g2' WHEN NOT g3 THEN 'g3'
           WHEN NOT g5 THEN 'g5' ELSE 'g6' END END) AS first_failure_gate_7gate
FROM s GROUP BY 1
""")
def coordination_floors(spark, sf):
    """The seven-gate floor plan with nations as subjects and order priorities as speeds."""
    speeds = {"1-URGENT": 5.0, "2-HIGH": 4.0, "3-MEDIUM": 3.33, "4-NOT SPECIFIED": 3.0, "5-LOW": 2.78}
    speed = F.create_map(*[F.lit(x) for kv in speeds.items() for x in kv])
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", speed[F.col("o_orderpriority")].alias("spd"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                    F.col("c_nationkey").alias("subject"))
    rows = orders.join(customers, "o_custkey")
    from ..operators.quantiles import exact_quantiles
    cells = rows.groupBy("subject", "spd").agg(
        (F.avg("o_totalprice") / 1e6).alias("f1"), (F.stddev_samp("o_totalprice") / 1e6).alias("d")).join(
        exact_quantiles(rows, ["subject", "spd"], "o_totalprice", {"q": 0.4}), ["subject", "spd"]).withColumn(
        "f2", F.col("q") / 1e6)
    # the stages exchange written tables; here the small condition table plays that part
    cells = cut_lineage(cells.withColumn("dataset", F.lit("orders")).withColumn("trial", F.lit(0)))
    key = ["dataset", "subject", "trial"]
    bounds = cells.where("spd = 5.0").select(
        *key, (0.93 * F.col("f1")).alias("L_ref_fidelity"), (0.8 * F.col("f2")).alias("L_ref_cosine_median"),
        (1.3 * F.col("d")).alias("U_ref_dtw_mean"), F.lit(90.0).alias("U_ref_principal_angle_max_deg"))
    tested = cells.where("spd < 5.0").withColumnRenamed("spd", "q_speed_mps")
    scale = bounds.select(*key, F.col("L_ref_fidelity").alias("_lf"))
    # g2 compares with the same bound, so the second direction is scaled to its level
    fidelity = tested.join(scale, key).select(
        *key, "q_speed_mps", F.col("f1").alias("fidelity_ref_to_q"), (F.col("f2") / 0.7).alias("fidelity_q_to_ref"))
    surrogate = tested.select(*key, "q_speed_mps", F.lit(0.22).alias("F_null_95"))
    metrics = tested.select(*key, "q_speed_mps", F.col("f2").alias("cosine_median"), F.col("d").alias("dtw_mean"),
                            F.lit(0.0).alias("principal_angle_max_deg"))
    _, floors = floor_plan.detect(bounds, fidelity, surrogate, metrics)
    return floors.select(
        "subject", "floor_speed_mps", "first_failed_speed_mps", "first_failure_gate",
        r("fail_margin_fid_ref").alias("fail_margin_fid_ref"), "floor_speed_mps_7gate", "first_failure_gate_7gate")
