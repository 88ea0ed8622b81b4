"""Event detection, windows, robust screening and breakpoints over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changepoint, contacts, draws, intervals, quantiles, selection
from . import query, table
from .relational import r

ON, OFF = 100.0, 50.0
DAY = 86_400_000_000


def timed_events(spark, sf, *extra: str):
    """Events with a microsecond position and the day chunk the ordered scans are cut by."""
    pos = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        "user_id", "event_id", "value", *extra, pos.alias("pos")).withColumn(
        "day", F.floor(F.col("pos") / DAY))


def user_contacts(spark, sf):
    return contacts.contacts(timed_events(spark, sf), ["user_id"], ["pos", "event_id"], "value", "pos",
                             ON, OFF, chunk="day")


CONTACTS = f"""
e AS (SELECT user_id, event_id, epoch_us(ts) AS pos, value,
             CASE WHEN value >= {ON} THEN 1 WHEN value <= {OFF} THEN 0 END AS edge FROM events),
st AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM e),
pv AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY pos, event_id), 0) AS prev FROM st),
ch AS (SELECT *, lead(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS nxt FROM pv WHERE state <> prev),
ct AS (SELECT user_id, pos AS "start", nxt AS "end" FROM ch WHERE state = 1 AND nxt IS NOT NULL)"""


@query("schmitt_contacts", f"""WITH {CONTACTS} SELECT user_id, "start", "end" FROM ct""")
def schmitt_contacts(spark, sf):
    return user_contacts(spark, sf).select("user_id", "start", "end")


@query("contacts_per_user", f"""
WITH {CONTACTS} SELECT user_id, count(*) AS n, round(avg("end" - "start") / 1e6, 3) AS mean_s FROM ct GROUP BY 1
""")
def contacts_per_user(spark, sf):
    return user_contacts(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("n"), r(F.avg(F.col("end") - F.col("start")) / 1e6, 3).alias("mean_s"))


GAP = 7_200_000_000


@query("min_interval_greedy", f"""
WITH RECURSIVE n AS (SELECT event_type, epoch_us(ts) AS pos, event_id,
                            row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_type, pos, event_id, rn, pos AS last, true AS kept FROM n WHERE rn = 1
      UNION ALL
      SELECT n.event_type, n.pos, n.event_id, n.rn, CASE WHEN n.pos - g.last >= {GAP} THEN n.pos ELSE g.last END,
             n.pos - g.last >= {GAP}
      FROM g JOIN n ON n.event_type = g.event_type AND n.rn = g.rn + 1)
SELECT event_type, pos AS "start" FROM g WHERE kept
""")
def min_interval_greedy(spark, sf):
    rows = timed_events(spark, sf, "event_type").select(
        "event_type", F.col("pos").alias("start"), F.col("pos").alias("end"), "day")
    return contacts.spaced_contacts(rows, ["event_type"], GAP, chunk="day").select("event_type", "start")


@query("stride_windows", f"""
WITH {CONTACTS},
rn AS (SELECT *, ((row_number() OVER (PARTITION BY user_id ORDER BY "start") - 1) % 2)::INT AS parity FROM ct),
nx AS (SELECT *, lead("start") OVER (PARTITION BY user_id, parity ORDER BY "start") AS b FROM rn)
SELECT user_id, parity, "start" AS a, b FROM nx WHERE b > "start"
""")
def stride_windows(spark, sf):
    return contacts.stride_windows(user_contacts(spark, sf), ["user_id"], chunk="day")


@query("mad_outliers", """
WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
d AS (SELECT event_type, 1.4826::DOUBLE * quantile_cont(abs(value - med), 0.5) AS s FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, round(med, 6) AS med, round(s, 6) AS mad_scaled, count(*) AS n,
       count(*) FILTER (WHERE abs(value - med) / s > 3) AS n_outliers,
       round(avg(CASE WHEN abs(value - med) / s > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outlier_frac,
       avg(CASE WHEN abs(value - med) / s > 3 THEN 1.0::DOUBLE ELSE 0 END) > 0.2 AS drift_fail
FROM events JOIN m USING (event_type) JOIN d USING (event_type) GROUP BY event_type, med, s
""")
def mad_outliers(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value")
    marked = quantiles.robust_outliers(rows, ["event_type"], "value", 3.0)
    frac = F.avg(F.col("outlier").cast("double"))
    return marked.groupBy("event_type").agg(
        r(F.first("med")).alias("med"), r(F.first("mad_scaled")).alias("mad_scaled"), F.count("*").alias("n"),
        F.count_if("outlier").alias("n_outliers"), r(frac).alias("outlier_frac"), (frac > 0.2).alias("drift_fail"))


@query("duration_screen", """
WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
d AS (SELECT event_type, any_value(med) AS med, 1.4826::DOUBLE * quantile_cont(abs(value - med), 0.5) AS s
      FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN d USING (event_type)
WHERE value >= greatest(2.5, med - 1.5::DOUBLE * s) AND value <= least(120.0, med + 1.5::DOUBLE * s)
""")
def duration_screen(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return quantiles.duration_screen(rows, ["event_type"], "value", 2.5, 120.0, 1.5)


DRIFT = """
s AS (SELECT user_id, event_type, date_trunc('day', ts)::DATE AS stride, avg(value) AS base FROM events GROUP BY 1, 2, 3),
m AS (SELECT user_id, event_type, quantile_cont(base, 0.5) AS med FROM s GROUP BY 1, 2),
d AS (SELECT user_id, event_type, any_value(med) AS med, 1.4826::DOUBLE * quantile_cont(abs(base - med), 0.5) AS mad
      FROM s JOIN m USING (user_id, event_type) GROUP BY 1, 2),
o AS (SELECT user_id, event_type, stride, med, abs(base - med) / CASE WHEN mad > 0 THEN mad ELSE 1e-12 END > 3 AS outlier
      FROM s JOIN d USING (user_id, event_type))"""


def daily_baseline(spark, sf):
    return table(spark, sf, "events").groupBy(
        "user_id", "event_type", F.col("ts").cast("date").alias("stride")).agg(F.avg("value").alias("base"))


@query("drift_union", f"""
WITH {DRIFT} SELECT user_id, stride FROM o GROUP BY 1, 2 HAVING NOT bool_or(outlier)
""")
def drift_union(spark, sf):
    kept, _ = quantiles.drift_union(daily_baseline(spark, sf), ["user_id"], "event_type", "stride", "base",
                                      small_groups=True)  # one row per day
    return kept


@query("drift_channels", f"""
WITH {DRIFT} SELECT user_id, event_type, round(any_value(med), 6) AS baseline_med,
  round(avg(outlier::INT::DOUBLE), 6) AS outlier_frac, avg(outlier::INT::DOUBLE) > 0.2 AS drift_fail FROM o GROUP BY 1, 2
""")
def drift_channels(spark, sf):
    _, channels = quantiles.drift_union(daily_baseline(spark, sf), ["user_id"], "event_type", "stride", "base",
                                      small_groups=True)  # one row per day
    return channels.select("user_id", "event_type", r("baseline_med").alias("baseline_med"),
                           r("outlier_frac").alias("outlier_frac"), "drift_fail")


@query("quantile_summary", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.10), 6) AS q10,
       min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def quantile_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    s = quantiles.summarise(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", r("mean", 4).alias("mean"), r("q").alias("q10"),
                    F.col("min").alias("lo"), F.col("max").alias("hi"), "n")


@query("null_quantiles", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS null_mean, round(stddev_pop(o_totalprice), 4) AS null_std,
       round(quantile_cont(o_totalprice, 0.95), 6) AS null_95,
       round(quantile_cont(o_totalprice, 0.05), 6) AS q05, round(quantile_cont(o_totalprice, 0.5), 6) AS q50
FROM orders GROUP BY 1
""")
def null_quantiles(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    q = quantiles.exact_quantiles(rows, ["o_orderpriority"], "o_totalprice",
                                  {"null_95": 0.95, "q05": 0.05, "q50": 0.5})
    moments = rows.groupBy("o_orderpriority").agg(r(F.avg("o_totalprice"), 4).alias("null_mean"),
                                                  r(F.stddev_pop("o_totalprice"), 4).alias("null_std"))
    return moments.join(q, "o_orderpriority").select(
        "o_orderpriority", "null_mean", "null_std", *[r(c).alias(c) for c in ("null_95", "q05", "q50")])


@query("snr_ratio", """
WITH p AS (SELECT user_id, date_trunc('day', ts)::DATE AS d,
             sqrt(avg(value * value) FILTER (WHERE event_type IN ('purchase', 'click'))) AS active,
             sqrt(avg(value * value) FILTER (WHERE event_type NOT IN ('purchase', 'click'))) AS base FROM events GROUP BY 1, 2),
s AS (SELECT user_id, active / (base + 1e-8) AS snr FROM p WHERE active IS NOT NULL AND base IS NOT NULL)
SELECT user_id, round(quantile_cont(snr, 0.5), 6) AS snr_median, count(*) AS snr_n, quantile_cont(snr, 0.5) < 3 AS low_snr
FROM s GROUP BY 1
""")
def snr_ratio(spark, sf):
    sq = F.col("value") * F.col("value")
    act = F.col("event_type").isin("purchase", "click")
    per = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(
        F.sqrt(F.avg(F.when(act, sq))).alias("active"), F.sqrt(F.avg(F.when(~act, sq))).alias("base"))
    snr = per.where("active IS NOT NULL AND base IS NOT NULL").select(
        "user_id", (F.col("active") / (F.col("base") + 1e-8)).alias("snr"))
    med = quantiles.exact_quantiles(snr, ["user_id"], "snr", {"snr_median": 0.5}, small_groups=True)
    n = snr.groupBy("user_id").agg(F.count("*").alias("snr_n"))
    return med.join(n, "user_id").select("user_id", r("snr_median").alias("snr_median"), "snr_n",
                                         (F.col("snr_median") < 3.0).alias("low_snr"))


@query("parity_choice", f"""
WITH {CONTACTS},
rn AS (SELECT *, ((row_number() OVER (PARTITION BY user_id ORDER BY "start") - 1) % 2)::INT AS parity FROM ct),
nx AS (SELECT *, lead("start") OVER (PARTITION BY user_id, parity ORDER BY "start") AS b FROM rn),
w AS (SELECT user_id, parity, count(*) AS kept, round(stddev_pop(b - "start") / 1e6, 3) AS score
      FROM nx WHERE b > "start" GROUP BY 1, 2)
SELECT user_id, parity, kept, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (kept < 3)::INT, score, parity) AS k FROM w) WHERE k = 1
""")
def parity_choice(spark, sf):
    windows = contacts.stride_windows(user_contacts(spark, sf), ["user_id"], chunk="day")
    scored = windows.groupBy("user_id", "parity").agg(
        F.count("*").alias("kept"), r(F.stddev_pop(F.col("b") - F.col("a")) / 1e6, 3).alias("score"))
    return selection.choose_parity(scored, ["user_id"], min_strides=3)


@query("toe_off_filter", f"""
WITH {CONTACTS}, nx AS (SELECT *, lead("start") OVER (PARTITION BY user_id ORDER BY "start") AS b FROM ct),
k AS (SELECT user_id, b IS NOT NULL AND "end" > "start" AND "end" < b AS ok FROM nx)
SELECT user_id, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM k GROUP BY 1
""")
def toe_off_filter(spark, sf):
    from ..operators.segments import next_after
    c = user_contacts(spark, sf)
    w = next_after(c, ["user_id"], ["start"], {"b": F.col("start")}, "day")
    ok = F.coalesce((F.col("end") > F.col("start")) & (F.col("end") < F.col("b")), F.lit(False))
    return w.groupBy("user_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("single_changepoint", """
WITH m AS (SELECT o_orderpriority AS p, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS x, avg(o_totalprice) AS y
           FROM orders GROUP BY 1, 2),
c AS (SELECT *, y - avg(y) OVER (PARTITION BY p) AS c, row_number() OVER (PARTITION BY p ORDER BY x DESC) AS i,
             count(*) OVER (PARTITION BY p) AS n, lead(x) OVER (PARTITION BY p ORDER BY x DESC) AS low FROM m),
s AS (SELECT *, sum(c) OVER w AS s1, sum(c * c) OVER w AS q1, sum(c) OVER (PARTITION BY p) AS S,
             sum(c * c) OVER (PARTITION BY p) AS Q FROM c
      WINDOW w AS (PARTITION BY p ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (q1 - s1 * s1 / i) + ((Q - q1) - (S - s1) * (S - s1) / (n - i)) AS cost FROM s WHERE i < n)
SELECT p AS o_orderpriority, i::BIGINT AS i, x AS high, low, (x + low) / 2 AS mid, round(cost / 1e6, 2) AS cost
FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(cost, 3), i) AS rk FROM k) WHERE rk = 1
""")
def single_changepoint(spark, sf):
    x = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double")
    m = table(spark, sf, "orders").groupBy("o_orderpriority", x.alias("x")).agg(F.avg("o_totalprice").alias("y"))
    m = m.withColumn("back", -F.col("x")).withColumn("decade", F.floor(F.col("back") / 120))
    best = changepoint.single_mean_shift(m, ["o_orderpriority"], ["back"], "x", "y", chunk="decade")
    return best.select("o_orderpriority", "i", "high", "low", "mid", r(F.col("cost") / 1e6, 2).alias("cost"))


@query("hinge_breakpoint", """
WITH p AS (SELECT c_nationkey AS g, c_acctbal / 1000 AS x, log(1 + abs(c_acctbal)) + (c_custkey % 7)::DOUBLE / 7 AS y FROM customer),
e AS (SELECT g, min(x) + 1e-9 AS lo, max(x) - 1e-9 AS hi, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p
      GROUP BY g HAVING count(*) >= 3 AND max(x) - min(x) > 1e-9),
b AS (SELECT e.*, k, lo + k * ((hi - lo) / 1999) AS bp FROM e, range(2000) AS t(k)),
s AS (SELECT b.g, k, bp, n, sum((x - mx) * (x - mx)) AS vxx, sum((x - mx) * (y - my)) AS vxy, sum((y - my) * (y - my)) AS vyy,
             sum(greatest(bp - x, 0)) AS sh, sum(greatest(bp - x, 0) * greatest(bp - x, 0)) AS shh,
             sum(greatest(bp - x, 0) * (x - mx)) AS vxh, sum(greatest(bp - x, 0) * (y - my)) AS vhy
      FROM b JOIN p ON p.g = b.g GROUP BY b.g, k, bp, n),
v AS (SELECT *, shh - sh * sh / n AS vhh FROM s),
f AS (SELECT *, CASE WHEN abs(vxx * vhh - vxh * vxh) > 1e-12 * vxx * greatest(vhh, 1e-300)
   THEN vyy - (vxy * vxy * vhh - 2 * vxy * vhy * vxh + vhy * vhy * vxx) / (vxx * vhh - vxh * vxh)
   ELSE vyy - vxy * vxy / vxx END AS sse FROM v)
SELECT g AS c_nationkey, round(bp, 7) AS bp, round(sse, 4) AS sse
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(sse, 6), k) AS rk FROM f) WHERE rk = 1
""")
def hinge_breakpoint(spark, sf):
    y = F.log10(1 + F.abs("c_acctbal")) + (F.col("c_custkey") % 7).cast("double") / 7
    pts = table(spark, sf, "customer").select("c_nationkey", (F.col("c_acctbal") / 1000).alias("x"), y.alias("y"))
    best = changepoint.hinge_breakpoint(pts, ["c_nationkey"], "x", "y", n_grid=2000, ties=6)
    return best.select("c_nationkey", r("bp", 7).alias("bp"), r("sse", 4).alias("sse"))


@query("participant_index", """
SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)::BIGINT AS idx FROM customer
""")
def participant_index(spark, sf):
    from ..operators.segments import row_numbers
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment",
                                               F.floor(F.col("c_custkey") / 500).alias("chunk"))
    numbered = row_numbers(rows, ["c_mktsegment"], ["c_custkey"], "rn", chunk="chunk")
    return numbered.select("c_custkey", "c_mktsegment", (F.col("rn") - 1).alias("idx"))


@query("interval_sums", """
WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 21600000000 AS b FROM events WHERE event_type = 'error')
SELECT w.event_id, count(*) AS n, round(sum(e.value), 4) AS total
FROM w JOIN events e ON e.user_id = w.user_id AND epoch_us(e.ts) >= a AND epoch_us(e.ts) < b GROUP BY 1
""")
def interval_sums(spark, sf):
    """What a user does in the six hours after an error: events and windows meet by hour."""
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    windows = events.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("window_id"), F.col("at").alias("a"), (F.col("at") + 21_600_000_000).alias("b"))
    met = intervals.interval_join(events.select("user_id", "at", "value"), windows, ["user_id"], "at", "a", "b", 3_600_000_000)
    return met.groupBy(F.col("window_id").alias("event_id")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("window_sums", """
WITH w AS (SELECT vec_id, embedding, k, (vec_id * 7 + k * 13) % 60 AS a, (vec_id * 7 + k * 13) % 60 + (vec_id + k * 17) % 50 AS b
  FROM embeddings, range(3) AS t(k))
SELECT vec_id, k::INT AS k, least(b, 64) - a AS n, round(list_sum(list_transform(embedding[a + 1:b], lambda v: v::DOUBLE * v::DOUBLE)), 6) AS total
FROM w WHERE b > a
""")
def window_sums(spark, sf):
    """Sums of squares in windows of signals that are cut into chunks of ten samples."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    windows = rows.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    a = (F.col("vec_id") * 7 + F.col("k") * 13) % 60
    windows = windows.select("vec_id", "k", a.alias("a"), (a + (F.col("vec_id") + F.col("k") * 17) % 50).alias("b"))
    sums = intervals.window_sums(intervals.chunked(rows, ["vec_id"], "v", 10), windows, ["vec_id"], ["k"], 10, lambda v: v * v)
    return sums.select("vec_id", "k", "n", r("total").alias("total"))


@query("draw_sizes", """
SELECT l_suppkey, least(40, count(*))::BIGINT AS n_drawn FROM lineitem GROUP BY 1
""")
def draw_sizes(spark, sf):
    """Forty order lines of every supplier, drawn without replacement."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    sizes = rows.select("l_suppkey").distinct().withColumn("size", F.lit(40))
    picked = draws.drawn(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], sizes, F.lit(5))
    return picked.groupBy("l_suppkey").agg(F.count("*").alias("n_drawn"))
