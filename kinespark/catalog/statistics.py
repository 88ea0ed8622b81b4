"""Rank, paired and agreement statistics on order panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage, selection, statistics
from ..operators.quantiles import exact_quantiles
from ..plans import reorganisation
from ..session import cut_lineage
from . import query, table
from .relational import r

# Order years stand for the tested speeds in turn, so that every order counts.
YEAR_SPEED = {1: 5.0, 2: 4.0, 3: 3.33, 4: 3.0, 0: 2.78}

LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def panel(spark, sf):
    """Mean order price per nation and priority (complete for every nation)."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (orders.join(customers, "o_custkey")
            .groupBy("c_nationkey", F.col("o_orderpriority").alias("transition"))
            .agg((F.avg("o_totalprice") / 1e5).alias("drop")))


PANEL = """p AS (SELECT c_nationkey, o_orderpriority AS transition, avg(o_totalprice) / 1e5 AS drop
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("max_transition", f"""
WITH {PANEL} SELECT c_nationkey, transition, round(drop, 6) AS drop FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(drop, 11) DESC, transition) AS k FROM p) WHERE k = 1
""")
def max_transition(spark, sf):
    top = selection.max_transition(panel(spark, sf), ["c_nationkey"], "drop", "transition")
    return top.select("c_nationkey", "transition", r("drop").alias("drop"))


@query("group_summary", f"""
WITH {PANEL}, w AS (SELECT transition, count(*) AS wins FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(drop, 11) DESC, transition) AS k FROM p) WHERE k = 1 GROUP BY 1),
g AS (SELECT transition, avg(drop) AS m, stddev_samp(drop) AS sd, count(*) AS n FROM p GROUP BY 1)
SELECT transition, round(m, 6) AS drop_mean, round(sd, 6) AS drop_sd, n, coalesce(wins, 0)::BIGINT AS n_max_here,
       round(coalesce(wins, 0) / (sum(coalesce(wins, 0)) OVER ())::DOUBLE * 100, 6) AS pct_max_here,
       round(m / first_value(m) OVER (ORDER BY transition), 6) AS ratio_to_first
FROM g LEFT JOIN w USING (transition)
""")
def group_summary(spark, sf):
    p = panel(spark, sf)
    labels = spark.createDataFrame([(t, i) for i, t in enumerate(LEVELS)], "transition string, ord int")
    winners = selection.max_transition(p, ["c_nationkey"], "drop", "transition")
    out = statistics.group_summary(p, "transition", "drop", labels, "ord", winners, "transition")
    return out.select("transition", r("drop_mean").alias("drop_mean"), r("drop_sd").alias("drop_sd"), "n",
                      "n_max_here", r("pct_max_here").alias("pct_max_here"),
                      r("ratio_to_first").alias("ratio_to_first"))


@query("friedman_stat", f"""
WITH {PANEL},
rk AS (SELECT c_nationkey, transition, rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey, drop) - 1) / 2.0::DOUBLE AS r,
              count(*) OVER (PARTITION BY c_nationkey, drop) AS t FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY drop)),
s AS (SELECT transition, sum(r) AS R, count(*) AS n, sum(t * t - 1) AS ties FROM rk GROUP BY 1),
a AS (SELECT sum(R * R) AS RR, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(ties)::DOUBLE AS T FROM s)
SELECT round((12 / (n * k * (k + 1)) * RR - 3 * n * (k + 1)) / (1 - T / (n * k * (k * k - 1))), 6) AS chi2,
       n::BIGINT AS n, k::BIGINT AS k FROM a
""")
def friedman_stat(spark, sf):
    out = statistics.friedman(panel(spark, sf), ["c_nationkey"], "transition", "drop")
    return out.select(r("chi2").alias("chi2"), "n", "k")


# with five treatments the upper tail of chi-square is a finite sum
@query("friedman_test", f"""
WITH {PANEL},
rk AS (SELECT c_nationkey, transition, rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey, drop) - 1) / 2.0::DOUBLE AS r,
              count(*) OVER (PARTITION BY c_nationkey, drop) AS t FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY drop)),
s AS (SELECT transition, sum(r) AS R, count(*) AS n, sum(t * t - 1) AS ties FROM rk GROUP BY 1),
a AS (SELECT sum(R * R) AS RR, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(ties)::DOUBLE AS T FROM s),
c AS (SELECT (12 / (n * k * (k + 1)) * RR - 3 * n * (k + 1)) / (1 - T / (n * k * (k * k - 1))) AS x, n, k FROM a)
SELECT round(x, 6) AS chi2, round(exp(-x / 2) * (1 + x / 2), 6) AS p, n::BIGINT AS n, k::BIGINT AS k FROM c
""")
def friedman_test(spark, sf):
    out = statistics.friedman(panel(spark, sf), ["c_nationkey"], "transition", "drop")
    return out.select(r("chi2").alias("chi2"), r("p").alias("p"), "n", "k")


def wide_panel(spark, sf):
    return selection.complete_pivot(panel(spark, sf), ["c_nationkey"], "transition", LEVELS, "drop")


@query("paired_t", f"""
WITH {PANEL}, d AS (SELECT a.transition || ' vs ' || b.transition AS comparison, a.drop AS da, b.drop AS db, a.drop - b.drop AS d
  FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.transition < b.transition)
SELECT comparison, count(*) AS n, (count(*) - 1)::BIGINT AS df, round(avg(da), 6) AS mean_drop_a, round(avg(db), 6) AS mean_drop_b,
       round(avg(d), 6) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic,
       round(avg(d) / stddev_samp(d), 6) AS dz FROM d GROUP BY 1
""")
def paired_t(spark, sf):
    out = statistics.paired_tests(wide_panel(spark, sf), LEVELS)
    return out.select("comparison", "n", "df", *[r(c).alias(c) for c in (
        "mean_drop_a", "mean_drop_b", "mean_difference", "t_statistic", "dz")])


# with an even number of degrees of freedom the tails of Student's t are a finite sum
@query("paired_t_p", f"""
WITH {PANEL}, d AS (SELECT a.transition || ' vs ' || b.transition AS comparison, a.drop - b.drop AS d
  FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.transition < b.transition),
t AS (SELECT comparison, count(*) - 1 AS nu, abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) AS t FROM d GROUP BY 1),
q AS (SELECT comparison, CASE WHEN nu % 2 = 1 THEN error('odd') END AS e, 1 - t / sqrt(nu + t * t) * list_sum(list_transform(range(nu // 2), lambda j:
        coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1)::DOUBLE / (2 * i))), 1) * pow(nu / (nu + t * t), j))) AS p FROM t),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, comparison) + 1) * p AS step FROM q)
SELECT comparison, round(p, 6) AS p_uncorrected,
       round(least(1.0::DOUBLE, max(step) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s
""")
def paired_t_p(spark, sf):
    tests = statistics.holm(statistics.paired_tests(wide_panel(spark, sf), LEVELS), "p_uncorrected", tie=["_ord"])
    return tests.select("comparison", r("p_uncorrected").alias("p_uncorrected"), r("p_holm").alias("p_holm"))


@query("paired_t_tests")
def paired_t_tests(spark, sf):
    tests = statistics.holm(statistics.paired_tests(wide_panel(spark, sf), LEVELS), "p_uncorrected", tie=["_ord"])
    out = statistics.effect_interval(tests).withColumn("significant_holm_0p05", F.col("p_holm") < 0.05)
    return out.drop("_ord").orderBy("p_uncorrected")


@query("holm_adjust", """
WITH p AS (SELECT c_mktsegment, c_nationkey, avg(abs(c_acctbal)) / 100000 AS p FROM customer GROUP BY 1, 2),
s AS (SELECT *, (count(*) OVER (PARTITION BY c_mktsegment) - row_number() OVER w + 1) * p AS step FROM p
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY p, c_nationkey))
SELECT c_mktsegment, c_nationkey, round(p, 6) AS p,
       round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY c_mktsegment ORDER BY p, c_nationkey ROWS UNBOUNDED PRECEDING)), 6) AS p_holm
FROM s
""")
def holm_adjust(spark, sf):
    p = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        (F.avg(F.abs("c_acctbal")) / 100000).alias("p"))
    out = statistics.holm(p, "p", ["c_mktsegment"], ["c_nationkey"])
    return out.select("c_mktsegment", "c_nationkey", r("p").alias("p"), r("p_holm").alias("p_holm"))


@query("independent_t_stat", """
WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS ma, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS mb,
  var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS va, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS vb,
  (count(*) FILTER (WHERE o_orderstatus = 'O'))::DOUBLE AS na, (count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS nb FROM orders)
SELECT round(ma, 3) AS mean_a, round(mb, 3) AS mean_b, (na + nb - 2)::BIGINT AS df,
  round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t,
  round((ma - mb) / sqrt((va + vb) / 2), 6) AS cohens_d FROM s
""")
def independent_t_stat(spark, sf):
    out = statistics.independent_t(table(spark, sf, "orders"), "o_orderstatus", "O", "F", "o_totalprice")
    return out.select(r("mean_a", 3).alias("mean_a"), r("mean_b", 3).alias("mean_b"), "df", r("t").alias("t"),
                      r("cohens_d").alias("cohens_d"))


def _linkage_sql(steps: int) -> str:
    """The steps of average linkage over ``pairs`` (g, a, b, d): clusters ca and cb of each pair, and the height h that joined it."""
    return f"""s AS (
  SELECT g, a, b, d, a AS ca, b AS cb, NULL::DOUBLE AS h, 0 AS step FROM pairs
  UNION ALL
  SELECT g, a, b, d, na, nb, CASE WHEN h IS NULL AND na = nb THEN best.mean ELSE h END, step + 1 FROM (
    SELECT *, CASE WHEN ca = best.hi THEN best.lo ELSE ca END AS na, CASE WHEN cb = best.hi THEN best.lo ELSE cb END AS nb FROM (
      SELECT *, first_value({{'lo': lo, 'hi': hi, 'mean': mean}}) OVER (PARTITION BY g ORDER BY lo = hi, round(mean, 12), lo, hi) AS best FROM (
        SELECT *, least(ca, cb) AS lo, greatest(ca, cb) AS hi, avg(d) OVER (PARTITION BY g, least(ca, cb), greatest(ca, cb)) AS mean
        FROM s WHERE step < {steps})))),
heights AS (SELECT g, a, b, d, h FROM s WHERE step = {steps})"""


@query("average_linkage", f"""
WITH RECURSIVE m AS (SELECT c_mktsegment AS g, (c_nationkey % 8)::INT AS k, avg(c_acctbal) / 10000.0::DOUBLE AS v FROM customer GROUP BY 1, 2),
pairs AS (SELECT x.g, x.k AS a, y.k AS b, abs(x.v - y.v) AS d FROM m x JOIN m y ON x.g = y.g AND x.k < y.k),
{_linkage_sql(7)}
SELECT g, a, b, round(h, 6) AS height FROM heights
""")
def average_linkage(spark, sf):
    """Groups of nations of every market segment, by the distance of their mean balances."""
    mean = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("g"), (F.col("c_nationkey") % 8).cast("int").alias("k")).agg(
        (F.avg("c_acctbal").cast("double") / 10000).alias("v"))
    pairs = mean.select("g", F.col("k").alias("a"), F.col("v").alias("x")).join(
        mean.select("g", F.col("k").alias("b"), F.col("v").alias("y")), "g").where("a < b").select("g", "a", "b", F.abs(F.col("x") - F.col("y")).alias("d"))
    return linkage.cophenetic_heights(pairs, ["g"]).select("g", "a", "b", r("height").alias("height"))


@query("consensus_quality", f"""
WITH RECURSIVE n AS (SELECT o_orderstatus AS g, year(o_orderdate) AS run, (c_nationkey % 8)::INT AS k, o_orderpriority AS p, count(*) AS c
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4),
l AS (SELECT g, run, k, p FROM n QUALIFY row_number() OVER (PARTITION BY g, run, k ORDER BY c DESC, p) = 1),
shares AS (SELECT x.g, x.k AS a, y.k AS b, avg((x.p = y.p)::INT) AS c FROM l x JOIN l y ON x.g = y.g AND x.run = y.run AND x.k < y.k GROUP BY 1, 2, 3),
pairs AS (SELECT g, a, b, 1 - c AS d FROM shares),
{_linkage_sql(7)},
q AS (SELECT g, avg(4 * (c - 0.5) * (c - 0.5)) AS dispersion, stddev_pop(c) AS sd FROM shares GROUP BY 1)
SELECT g, round(CASE WHEN sd >= 1e-12 THEN (SELECT corr(d, h) FROM heights t WHERE t.g = q.g) WHEN dispersion > 0.95 THEN 1
  WHEN dispersion < 0.05 THEN 0 END, 6) AS cophenetic, round(dispersion, 6) AS dispersion FROM q
""")
def consensus_quality(spark, sf):
    """How far years agree on which nations share their most frequent order priority."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("g"), F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("p"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 8).cast("int").alias("k"))
    counts = orders.join(customers, "o_custkey").groupBy("g", "run", "k", "p").agg(F.count("*").alias("c"))
    labels = counts.groupBy("g", "run", "k").agg(F.min_by("p", F.struct(-F.col("c"), "p")).alias("p"))
    both = labels.withColumnsRenamed({"k": "a", "p": "pa"}).join(labels.withColumnsRenamed({"k": "b", "p": "pb"}), ["g", "run"]).where("a < b")
    shares = both.groupBy("g", "a", "b").agg(F.avg((F.col("pa") == F.col("pb")).cast("int")).alias("c"))
    return linkage.consensus_quality(shares, ["g"]).select("g", r("cophenetic").alias("cophenetic"), r("dispersion").alias("dispersion"))


# two samples of every nation: an even number of degrees of freedom, so the tails are a finite sum
@query("independent_t_p", f"""
WITH {PANEL}, s AS (SELECT avg(drop) FILTER (WHERE transition = '1-URGENT') AS ma, avg(drop) FILTER (WHERE transition = '5-LOW') AS mb,
  var_samp(drop) FILTER (WHERE transition = '1-URGENT') AS va, var_samp(drop) FILTER (WHERE transition = '5-LOW') AS vb,
  count(*) FILTER (WHERE transition = '1-URGENT') AS na, count(*) FILTER (WHERE transition = '5-LOW') AS nb FROM p),
t AS (SELECT na, nb, na + nb - 2 AS nu, abs(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS t,
  (ma - mb) / sqrt((va + vb) / 2) AS d FROM s)
SELECT na AS n_a, nb AS n_b, round(d, 6) AS cohens_d, round(CASE WHEN nu % 2 = 1 THEN error('odd')::DOUBLE ELSE
  1 - t / sqrt(nu + t * t) * list_sum(list_transform(range(nu // 2), lambda j:
    coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1)::DOUBLE / (2 * i))), 1) * pow(nu / (nu + t * t), j))) END, 6) AS p FROM t
""")
def independent_t_p(spark, sf):
    out = statistics.independent_t(panel(spark, sf), "transition", "1-URGENT", "5-LOW", "drop")
    return out.select("n_a", "n_b", r("cohens_d").alias("cohens_d"), r("p").alias("p"))


def status_panel(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    wide = orders.groupBy("o_custkey").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.avg("o_totalprice"))
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return wide.join(segments, "o_custkey")


STATUS = """w AS (SELECT o_custkey, c_mktsegment, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o,
 avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("icc21", f"""
WITH {STATUS}, c AS (SELECT *, (o + f + p) / 3 AS rm FROM w WHERE o IS NOT NULL AND f IS NOT NULL AND p IS NOT NULL),
a AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(rm) AS g, avg(o) AS mo, avg(f) AS mf, avg(p) AS mp FROM c GROUP BY 1),
s AS (SELECT c_mktsegment, any_value(n) AS n,
   3 * sum((rm - g) * (rm - g)) AS ssr,
   any_value(n * ((mo - g) * (mo - g) + (mf - g) * (mf - g) + (mp - g) * (mp - g))) AS ssc,
   sum((o - g) * (o - g) + (f - g) * (f - g) + (p - g) * (p - g)) AS sst FROM c JOIN a USING (c_mktsegment) GROUP BY 1),
m AS (SELECT *, ssr / (n - 1) AS msr, ssc / 2 AS msc, (sst - ssr - ssc) / ((n - 1) * 2) AS mse FROM s)
SELECT c_mktsegment, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (msr - mse) / (msr + 2 * mse + (3 / n) * (msc - mse)))), 6) AS icc_2_1,
       n::BIGINT AS n FROM m
""")
def icc21(spark, sf):
    out = statistics.icc21(status_panel(spark, sf), ["O", "F", "P"], ["c_mktsegment"])
    return out.select("c_mktsegment", r("icc_2_1").alias("icc_2_1"), "n")


@query("bland_altman", f"""
WITH {STATUS}
SELECT c_mktsegment, round(avg(f - o), 4) AS mean_diff, round(stddev_samp(f - o), 4) AS sd_diff,
  round(avg(f - o) - 1.96::DOUBLE * stddev_samp(f - o), 4) AS loa_lower, round(avg(f - o) + 1.96::DOUBLE * stddev_samp(f - o), 4) AS loa_upper,
  count(*) AS n FROM w WHERE o IS NOT NULL AND f IS NOT NULL GROUP BY 1
""")
def bland_altman(spark, sf):
    out = statistics.bland_altman(status_panel(spark, sf), "O", "F", ["c_mktsegment"])
    return out.select("c_mktsegment", *[r(c, 4).alias(c) for c in (
        "mean_diff", "sd_diff", "loa_lower", "loa_upper")], "n")


def year_profile(spark, sf):
    """Nations as subjects and order years as speeds: within-speed reliability and pairwise fidelity."""
    speed = F.create_map(*[F.lit(x) for kv in YEAR_SPEED.items() for x in kv])
    orders = table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_totalprice") / 1e6).alias("v"), speed[F.year("o_orderdate") % 5].alias("speed_mps"))
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("subject"))
    rows = orders.join(customers, "o_custkey")
    key = ["subject", "speed_mps"]
    stats = rows.groupBy(*key).agg(F.avg("v").alias("within_fid_mean")).join(
        exact_quantiles(rows, key, "v", {"within_fid_q10": 0.10}), key)
    within = cut_lineage(stats.withColumn("dataset", F.lit("orders")).withColumn("trial", F.lit(0)))
    group = ["dataset", "subject", "trial"]
    from ..operators.joins import ordered_pairs
    pairs = ordered_pairs(within, group, "speed_mps").select(
        *group, F.col("speed_mps_a").alias("speed_a_mps"), F.col("speed_mps_b").alias("speed_b_mps"),
        (0.7 * F.col("within_fid_mean_a") + F.col("within_fid_q10_b")).alias("fidelity_a_to_b"))
    return within, pairs


YEARS = """y AS (SELECT c_nationkey::VARCHAR AS subject, 1996 + (year(o_orderdate) - 1996 + 1000) % 5 AS yr, avg(o_totalprice / 1e6) AS m, quantile_cont(o_totalprice / 1e6, 0.1) AS q
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
t AS (SELECT f.subject, f.yr - 1996 AS ord, ['5.0->4.0', '4.0->3.33', '3.33->3.0', '3.0->2.78'][f.yr - 1995] AS transition,
   ['3:20', '4:10', '5:00', '5:33'][f.yr - 1995] AS pace_fast, 0.5::DOUBLE * (f.m + s.m) AS wavg, 0.5::DOUBLE * (f.q + s.q) AS thr,
   0.5::DOUBLE * ((0.7::DOUBLE * f.m + s.q) + (0.7::DOUBLE * s.m + f.q)) AS cross_avg
  FROM y f JOIN y s ON s.subject = f.subject AND s.yr = f.yr + 1),
d AS (SELECT *, wavg - cross_avg AS drop, greatest(0.0::DOUBLE, thr - cross_avg) AS beyond FROM t)"""


@query("transition_drops", f"""WITH {YEARS}
SELECT subject, transition, pace_fast AS pace_fast_min_per_km, round(wavg, 6) AS within_fidelity_avg, round(thr, 6) AS within_q10_threshold,
  round(cross_avg, 6) AS cross_fidelity_avg, round(drop, 6) AS drop, round(beyond, 6) AS drop_beyond, cross_avg >= thr AS pass_within_q10 FROM d
""")
def transition_drops(spark, sf):
    drops = reorganisation.transition_drops(*year_profile(spark, sf))
    return drops.select("subject", "transition", "pace_fast_min_per_km", *[r(c).alias(c) for c in (
        "within_fidelity_avg", "within_q10_threshold", "cross_fidelity_avg", "drop", "drop_beyond")], "pass_within_q10")


@query("transition_summary", f"""WITH {YEARS},
w AS (SELECT subject, transition FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(beyond, 11) DESC, ord) AS k FROM d) WHERE k = 1),
c AS (SELECT transition, count(*) AS wins FROM w GROUP BY 1),
g AS (SELECT ord, transition, avg(drop) AS m, stddev_samp(drop) AS sd, count(*) AS n FROM d GROUP BY 1, 2)
SELECT transition, round(m, 6) AS drop_mean, round(sd, 6) AS drop_sd, n, coalesce(wins, 0)::BIGINT AS n_subjects_max_here,
  round(m / first_value(m) OVER (ORDER BY ord), 6) AS ratio_vs_5_to_4 FROM g LEFT JOIN c USING (transition)
""")
def transition_summary(spark, sf):
    drops = cut_lineage(reorganisation.transition_drops(*year_profile(spark, sf)))
    out = reorganisation.group_summary(drops, reorganisation.max_reorganisation(drops))
    return out.select("transition", r("drop_mean").alias("drop_mean"), r("drop_sd").alias("drop_sd"), "n",
                      "n_subjects_max_here", r("ratio_vs_5_to_4").alias("ratio_vs_5_to_4"))


@query("transition_tests")
def transition_tests(spark, sf):
    return reorganisation.transition_tests(reorganisation.transition_drops(*year_profile(spark, sf)))
