"""Factorisation, projection, resampling and similarity over the embedding table.

Each 64-number vector is one stride of 8 channels by 8 points. Labels become
conditions: two subjects (label parity) at five speeds.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import factorise, matrices
from ..plans import extraction, fidelity, reliability, sensitivity
from ..plans.extraction import KEY
from ..session import cut_lineage
from . import query, table
from .relational import r

SPEEDS = (500, 400, 333, 300, 278)


def whole_vectors(spark, sf):
    """All vectors; one that has not 64 numbers is an error."""
    odd = F.raise_error(F.concat(F.lit("not 64 numbers: vector "), F.col("vec_id").cast("string"))).cast("array<float>")
    return table(spark, sf, "embeddings").withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding")).otherwise(odd))


def blocks(spark, sf):
    """All vectors as stride blocks keyed by (dataset, subject, trial, speed_key)."""
    speed = F.element_at(F.array(*[F.lit(s) for s in SPEEDS]), F.floor(F.col("label") / 2).cast("int") % 5 + 1)
    keyed = whole_vectors(spark, sf).select(
        F.lit("vectors").alias("dataset"), F.concat(F.lit("S"), F.col("label") % 2).alias("subject"),
        F.lit(0).alias("trial"), speed.alias("speed_key"), F.col("vec_id").alias("block_id"), F.lit(8).alias("m"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("x"))
    from ..operators.segments import row_numbers
    # strides are numbered 0, 1, ... in each condition
    numbered = row_numbers(keyed.withColumn("_c", F.floor(F.col("block_id") / 10000)), KEY, ["block_id"], "_rn", "_c")
    return numbered.select(*KEY, (F.col("_rn") - 1).alias("block_id"), "m", F.lit(64).cast("bigint").alias("cells"), "x")


def ready_blocks(spark, sf):
    """Blocks as a written table, which is how stages hand them on."""
    return cut_lineage(blocks(spark, sf))


def fits_for(spark, sf, rule, n_starts: int, k: int = 3):
    """Fits with the iteration limit, tolerance and number of starts of the stage that uses the rule."""
    b = ready_blocks(spark, sf)
    wanted = b.select(*KEY).distinct().select(*KEY, F.lit(k).alias("k"), F.array(
        *[F.lit(i).cast("bigint") for i in range(n_starts)]).alias("seeds"))
    fits = factorise.fit_conditions(b, KEY, wanted, rule, n_starts, normalise=True)
    return factorise.explained(fits, 1e-8).select(
        *KEY, "k", "seed", "iters", "converged", *[r(c).alias(c) for c in ("sse", "vaf_total", "vaf_min")])


@query("nmf_frobenius")
def nmf_frobenius(spark, sf):
    return fits_for(spark, sf, kernels.EXTRACTION, 10)


@query("nmf_shifted")
def nmf_shifted(spark, sf):
    return fits_for(spark, sf, kernels.SENSITIVITY, 5)


@query("nmf_kl")
def nmf_kl(spark, sf):
    return fits_for(spark, sf, kernels.SENSITIVITY_KL, 5)


@query("nmf_ridge")
def nmf_ridge(spark, sf):
    return fits_for(spark, sf, kernels.EXTERNAL, 10)


@query("nmf_svd_start")
def nmf_svd_start(spark, sf):
    return fits_for(spark, sf, kernels.ENVELOPE, 10)


@query("nmf_coordinate")
def nmf_coordinate(spark, sf):
    return fits_for(spark, sf, kernels.WITHIN, 20)


STEPS = 3
_X = """x AS (SELECT label, vec_id, (u - 1)::INT AS i, abs(embedding[u])::DOUBLE AS v
  FROM embeddings, range(1, 65) AS t(u)),
w0 AS (SELECT label, i, c, 1 + ((i * 7 + c * 13) % 10) / 10.0::DOUBLE AS w
  FROM (SELECT DISTINCT label FROM embeddings), range(64) AS a(i), range(2) AS b(c)),
h0 AS (SELECT label, vec_id, c, 1 + ((vec_id * (c + 3)) % 7) / 10.0::DOUBLE AS h FROM embeddings, range(2) AS b(c))"""


def _steps_sql() -> str:
    """The multiplicative updates unrolled as joins and sums over (row, column, value) tables."""
    parts = [_X]
    for s in range(STEPS):
        parts.append(f"""
g{s} AS (SELECT a.label, a.c, b.c AS d, sum(a.w * b.w) AS g FROM w{s} a JOIN w{s} b ON a.label = b.label AND a.i = b.i GROUP BY 1, 2, 3),
n{s} AS (SELECT x.label, vec_id, c, sum(w * v) AS num FROM x JOIN w{s} w ON w.label = x.label AND w.i = x.i GROUP BY 1, 2, 3),
d{s} AS (SELECT h.label, h.vec_id, g.c, sum(g * h) AS den FROM h{s} h JOIN g{s} g ON g.label = h.label AND g.d = h.c GROUP BY 1, 2, 3),
h{s + 1} AS (SELECT h.label, h.vec_id, h.c, h * num / (den + 1e-8) AS h FROM h{s} h JOIN n{s} n ON n.label = h.label AND n.vec_id = h.vec_id AND n.c = h.c
  JOIN d{s} d ON d.label = h.label AND d.vec_id = h.vec_id AND d.c = h.c),
p{s} AS (SELECT x.label, x.i, c, sum(v * h) AS num FROM x JOIN h{s + 1} h ON h.label = x.label AND h.vec_id = x.vec_id GROUP BY 1, 2, 3),
q{s} AS (SELECT a.label, a.c, b.c AS d, sum(a.h * b.h) AS g FROM h{s + 1} a JOIN h{s + 1} b ON a.label = b.label AND a.vec_id = b.vec_id GROUP BY 1, 2, 3),
e{s} AS (SELECT w.label, w.i, q.c, sum(w * g) AS den FROM w{s} w JOIN q{s} q ON q.label = w.label AND q.d = w.c GROUP BY 1, 2, 3),
w{s + 1} AS (SELECT w.label, w.i, w.c, w * num / (den + 1e-8) AS w FROM w{s} w JOIN p{s} p ON p.label = w.label AND p.i = w.i AND p.c = w.c
  JOIN e{s} e ON e.label = w.label AND e.i = w.i AND e.c = w.c)""")
    return f"WITH {','.join(parts)} SELECT label, i::INT AS channel, c::INT AS module, round(w, 5) AS weight FROM w{STEPS}"


@query("nmf_block_steps", _steps_sql())
def nmf_block_steps(spark, sf):
    """Block-distributed multiplicative updates from a stated start, three passes."""
    ids = ["label", "k"]
    rows = table(spark, sf, "embeddings").select(
        "label", "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("v"))
    packed = rows.withColumn("b", F.floor(F.col("vec_id") / 64)).groupBy("label", F.col("b").alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("_c"))
    start_h = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda c: F.transform(
        "_c", lambda s: 1 + ((s["vec_id"] * (c + 3)) % 7) / 10))
    state = packed.select("label", F.lit(2).alias("k"), "block_id", F.lit(1).alias("weight"), F.flatten(start_h).alias("h"))
    data = factorise.placed(packed.select("label", "block_id", F.lit(64).alias("m"), F.flatten(F.transform(
        "_c", lambda s: s["v"])).alias("x")), ["label"])
    start_w = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda j: 1 + (
        (F.floor(j / 2) * 7 + (j % 2) * 13) % 10) / 10)
    factors = rows.select("label").distinct().select("label", F.lit(2).alias("k"), F.lit(64).alias("m"), start_w.alias("w"))
    rule = replace(kernels.EXTRACTION, max_iter=STEPS)
    out, _ = factorise.iterate_large(factors, state, data, ["label"], ids, rule)
    return out.select("label", F.posexplode("w").alias("j", "v")).select(
        "label", F.floor(F.col("j") / 2).cast("int").alias("channel"), (F.col("j") % 2).cast("int").alias("module"),
        r("v", 5).alias("weight"))


@query("nnls_fidelity", """
WITH x AS (SELECT label, vec_id, ((u - 1) // 8)::INT AS p, ((u - 1) % 8)::INT AS i, abs(embedding[u])::DOUBLE AS v
           FROM embeddings, range(1, 65) AS t(u)),
w AS (SELECT label, i, avg(v) AS a, stddev_pop(v) AS b FROM x GROUP BY 1, 2),
g AS (SELECT label, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM w GROUP BY 1),
c AS (SELECT x.label, vec_id, p, sum(v * v) AS vv, sum(v * a) AS va, sum(v * b) AS vb FROM x JOIN w ON w.label = x.label AND w.i = x.i GROUP BY 1, 2, 3),
s AS (SELECT c.*, aa, ab, bb, (va * bb - vb * ab) / (aa * bb - ab * ab) AS ha, (vb * aa - va * ab) / (aa * bb - ab * ab) AS hb FROM c JOIN g USING (label)),
e AS (SELECT label, vv, CASE WHEN ha >= 0 AND hb >= 0
  THEN vv - 2 * (ha * va + hb * vb) + ha * ha * aa + 2 * ha * hb * ab + hb * hb * bb
  ELSE vv - greatest(va * va / aa, vb * vb / bb) END AS sse FROM s)
SELECT label, round(1 - sum(sse) / sum(vv), 6) AS fidelity FROM e GROUP BY 1
""")
def nnls_fidelity(spark, sf):
    """Reconstruction of every label's strides through two fixed channel profiles of that label."""
    rows = table(spark, sf, "embeddings").select(
        "label", "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("x"))
    long = rows.select("label", F.posexplode("x").alias("u", "v"))
    profile = long.groupBy("label", (F.col("u") % 8).alias("i")).agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"))
    factors = profile.groupBy("label").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "a", "b"))), lambda s: F.array(s["a"], s["b"]))).alias("w"))
    errors = matrices.block_errors(rows.withColumn("m", F.lit(8)).join(factors, "label"))
    return errors.groupBy("label").agg(r(1 - F.sum("sse") / F.sum("sst")).alias("fidelity"))


SWEEPS = 2
#: a start for every label's 64 channels and its vectors, as two columns beside each other
_STATED = """x AS (SELECT label, vec_id, (u - 1)::INT AS i, abs(embedding[u])::DOUBLE AS v
  FROM embeddings, range(1, 65) AS t(u)),
w0 AS (SELECT label, i, 1 + (i * 7 % 10) / 10.0::DOUBLE AS a, 1 + ((i * 7 + 13) % 10) / 10.0::DOUBLE AS b
  FROM (SELECT DISTINCT label FROM embeddings), range(64) AS r(i)),
h0 AS (SELECT label, vec_id, (10 + vec_id * 3 % 7) / 500.0::DOUBLE AS a, (10 + vec_id * 4 % 7) / 500.0::DOUBLE AS b FROM embeddings)"""
#: eps of the rules below, and how one side (o: old values, n: sums against the data, g: sums over the other side) moves
_EPS = 1e-10
_MOVES = {
    "frobenius_shifted": ("o.a * n.a / (g.aa * o.a + g.ab * o.b + {e} * g.a + {e})",
                          "o.b * n.b / (g.ab * o.a + g.bb * o.b + {e} * g.b + {e})"),
    "kullback": ("o.a * n.a / (g.a + {e})", "o.b * n.b / (g.b + {e})"),
    "ridge": ("greatest(o.a * (n.a / ((g.aa + {e}) * o.a + g.ab * o.b + {e})), {e})",
              "greatest(o.b * (n.b / (g.ab * o.a + (g.bb + {e}) * o.b + {e})), {e})"),
    "coordinate": ("CASE WHEN g.aa = 0 THEN o.a ELSE greatest(o.a - (g.aa * o.a + g.ab * o.b - n.a) / g.aa, 0) END",
                   "CASE WHEN g.bb = 0 THEN o.b ELSE greatest(o.b - (g.ab * ({first}) + g.bb * o.b - n.b) / g.bb, 0) END")}


def _sweeps_sql(rule: str) -> str:
    """Whole sweeps of a rule with two modules: activations from factors, then factors from the new activations."""
    value = f"greatest(v, {_EPS}) / (w.a * h.a + w.b * h.b + {_EPS})" if rule == "kullback" else "v"
    first, second = (m.format(e=_EPS, first="{first}") for m in _MOVES[rule])
    second = second.replace("{first}", first)
    parts = [_STATED]

    def side(s: str, old: str, other: str, place: str, w: str, h: str) -> None:
        parts.append(f"""
g{s} AS (SELECT label, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a) AS a, sum(b) AS b FROM {other} GROUP BY 1),
n{s} AS (SELECT x.label, x.{place}, sum({other[0]}.a * {value}) AS a, sum({other[0]}.b * {value}) AS b FROM x
  JOIN {w} w ON w.label = x.label AND w.i = x.i JOIN {h} h ON h.label = x.label AND h.vec_id = x.vec_id GROUP BY 1, 2)""")
        name = f"{old[0]}{int(old[1:]) + 1}"
        parts.append(f"""
{name} AS (SELECT o.label, o.{place}, {first} AS a, {second} AS b FROM {old} o
  JOIN n{s} n ON n.label = o.label AND n.{place} = o.{place} JOIN g{s} g ON g.label = o.label)""")
    for k in range(SWEEPS):
        side(f"h{k}", f"h{k}", f"w{k}", "vec_id", f"w{k}", f"h{k}")
        side(f"w{k}", f"w{k}", f"h{k + 1}", "i", f"w{k}", f"h{k + 1}")
    return (f"WITH {','.join(parts)} SELECT label, i::INT AS channel, m::INT AS module, round(CASE m WHEN 0 THEN a ELSE b END, 5) AS weight "
            f"FROM w{SWEEPS}, range(2) AS t(m)")


def _sweeps(spark, sf, rule):
    """Factors after whole sweeps of ``rule`` over all vectors of every label, from the stated start."""
    rows = table(spark, sf, "embeddings").select(
        "label", "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("x"))
    data = factorise.placed(rows.select("label", F.col("vec_id").alias("block_id"), F.lit(64).alias("m"), "x"), ["label"])
    start_h = F.array(*[(10 + F.col("vec_id") * (c + 3) % 7) / 500 for c in range(2)])
    state = rows.select("label", F.lit(2).alias("k"), F.col("vec_id").alias("block_id"), F.lit(1).alias("weight"), start_h.alias("h"))
    start_w = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda j: 1 + ((F.floor(j / 2) * 7 + (j % 2) * 13) % 10) / 10)
    factors = rows.select("label").distinct().select("label", F.lit(2).alias("k"), F.lit(64).alias("m"), start_w.alias("w"))
    out, _ = factorise.iterate_large(factors, state, data, ["label"], ["label", "k"], replace(rule, eps=_EPS, max_iter=SWEEPS, tol=-1.0))
    return out.select("label", F.posexplode("w").alias("j", "v")).select(
        "label", F.floor(F.col("j") / 2).cast("int").alias("channel"), (F.col("j") % 2).cast("int").alias("module"), r("v", 5).alias("weight"))


@query("nmf_sweeps_shifted", _sweeps_sql("frobenius_shifted"))
def nmf_sweeps_shifted(spark, sf):
    return _sweeps(spark, sf, kernels.SENSITIVITY)


@query("nmf_sweeps_kl", _sweeps_sql("kullback"))
def nmf_sweeps_kl(spark, sf):
    return _sweeps(spark, sf, kernels.SENSITIVITY_KL)


@query("nmf_sweeps_ridge", _sweeps_sql("ridge"))
def nmf_sweeps_ridge(spark, sf):
    return _sweeps(spark, sf, kernels.EXTERNAL)


@query("nmf_sweeps_coordinate", _sweeps_sql("coordinate"))
def nmf_sweeps_coordinate(spark, sf):
    return _sweeps(spark, sf, kernels.WITHIN)


def stated_tables(spark, sf):
    """Blocks, conditions and two stated modules of each: mean and deviation of every channel.

    The queries below look at one stage each. They begin from these factors, so that a stage runs with its own counts
    but without the fits of the stages before it; ``module_extraction`` is the query that fits.
    """
    b = ready_blocks(spark, sf)
    long = b.select(*KEY, F.posexplode("x").alias("u", "v"))
    profile = long.groupBy(*KEY, (F.col("u") % 8).alias("i")).agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"))
    factors = profile.groupBy(*KEY).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "a", "b"))), lambda s: F.array(s["a"], s["b"]))).alias("w"))
    factors = cut_lineage(factors.select(*KEY, F.lit(2).alias("k"), "w", F.lit(8).alias("m")))
    stable = factors.select(*KEY, "k").join(factorise.shapes(b, KEY), KEY).withColumn("pass_stability", F.lit(True))
    return b, cut_lineage(stable), factors


@query("module_extraction")
def module_extraction(spark, sf):
    summary = cut_lineage(extraction.extract(ready_blocks(spark, sf)))
    return summary.select(*KEY, "k", "m", "n_strides", "iters", "converged", "ok", "fail_reason",
                          *[r(c).alias(c) for c in ("vaf_total", "vaf_min", "vaf_median", "vaf_mean")])


@query("consensus_stability")
def consensus_stability(spark, sf):
    b, stable, factors = stated_tables(spark, sf)
    summary = factors.join(stable.select(*KEY, "n_strides", "points"), KEY)
    out = extraction.stability(b, factors.select(*KEY, F.col("k").alias("chosen_k")), summary)
    return out.select(*KEY, "k", "n_strides", "n_boot_success", "cophenetic", "dispersion", "w_cosine_median",
                      "w_cosine_min", "pass_stability", "fail_reason")


#: fidelity of every ordered pair of conditions (p: the condition of the factors, q: that of the data), two modules
_PAIRS = """x AS (SELECT 'S' || (label % 2) AS subject, [500, 400, 333, 300, 278][(label // 2) % 5 + 1] AS speed, vec_id,
    ((u - 1) // 8)::INT AS p, ((u - 1) % 8)::INT AS i, abs(embedding[u])::DOUBLE AS v FROM embeddings, range(1, 65) AS t(u)),
w AS (SELECT subject, speed, i, avg(v) AS a, stddev_pop(v) AS b FROM x GROUP BY 1, 2, 3),
g AS (SELECT subject, speed, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM w GROUP BY 1, 2),
c AS (SELECT x.subject, w.speed AS p, x.speed AS q, vec_id, x.p AS at, sum(v * v) AS vv, sum(v * a) AS va, sum(v * b) AS vb
      FROM x JOIN w ON w.subject = x.subject AND w.i = x.i AND w.speed <> x.speed GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT c.*, aa, ab, bb, (va * bb - vb * ab) / (aa * bb - ab * ab) AS ha, (vb * aa - va * ab) / (aa * bb - ab * ab) AS hb
      FROM c JOIN g ON g.subject = c.subject AND g.speed = c.p),
e AS (SELECT subject, p, q, vv, CASE WHEN ha >= 0 AND hb >= 0
  THEN vv - 2 * (ha * va + hb * vb) + ha * ha * aa + 2 * ha * hb * ab + hb * hb * bb
  ELSE vv - greatest(va * va / aa, vb * vb / bb) END AS sse FROM s),
f AS (SELECT subject, p, q, 1 - sum(sse) / sum(vv) AS fid FROM e GROUP BY 1, 2, 3),
n AS (SELECT subject, speed, count(DISTINCT vec_id)::INT AS n FROM x GROUP BY 1, 2)"""


@query("pairwise_fidelity", f"""WITH {_PAIRS}
SELECT 'vectors' AS dataset, f.subject, 0 AS trial, p / 100.0::DOUBLE AS speed_a_mps, q / 100.0::DOUBLE AS speed_b_mps, 2 AS k_a, 2 AS k_b,
  a.n AS n_strides_a, b.n AS n_strides_b, round(fid, 6) AS fidelity_a_to_b, '' AS notes
FROM f JOIN n a ON a.subject = f.subject AND a.speed = p JOIN n b ON b.subject = f.subject AND b.speed = q""")
def pairwise_fidelity(spark, sf):
    b, stable, factors = stated_tables(spark, sf)
    return fidelity.pairwise(stable, factors, b).withColumn("fidelity_a_to_b", r("fidelity_a_to_b"))


@query("reference_fidelity", f"""WITH {_PAIRS},
top AS (SELECT subject, max(speed) AS speed FROM n GROUP BY 1)
SELECT 'vectors' AS dataset, f.subject, 0 AS trial, p / 100.0::DOUBLE AS ref_speed_mps, q / 100.0::DOUBLE AS q_speed_mps, 2 AS k_ref, 2 AS k_q,
  a.n AS n_strides_ref, b.n AS n_strides_q, round(fid, 6) AS fidelity_ref_to_q,
  (SELECT round(o.fid, 6) FROM f o WHERE o.subject = f.subject AND o.p = f.q AND o.q = f.p) AS fidelity_q_to_ref, '' AS notes
FROM f JOIN top ON top.subject = f.subject AND top.speed = p JOIN n a ON a.subject = f.subject AND a.speed = p
  JOIN n b ON b.subject = f.subject AND b.speed = q""")
def reference_fidelity(spark, sf):
    b, stable, factors = stated_tables(spark, sf)
    out = fidelity.reference(stable, factors, b)
    return out.withColumns({c: r(c) for c in ("fidelity_ref_to_q", "fidelity_q_to_ref")})


@query("surrogate_null")
def surrogate_null(spark, sf):
    b, stable, factors = stated_tables(spark, sf)
    fid = cut_lineage(fidelity.reference(stable, factors, b))
    return fidelity.surrogates(fid, factors, b)


@query("module_similarity")
def module_similarity(spark, sf):
    b, stable, factors = stated_tables(spark, sf)
    fid = cut_lineage(fidelity.reference(stable, factors, b))
    return fidelity.similarity(fid, b)


@query("half_split_reliability")
def half_split_reliability(spark, sf):
    b, stable, _ = stated_tables(spark, sf)
    return reliability.within_speed(stable, b)


@query("reference_envelope")
def reference_envelope(spark, sf):
    b, stable, _ = stated_tables(spark, sf)
    out, _ = reliability.envelope(stable, b)
    return out


@query("external_reliability")
def external_reliability(spark, sf):
    b = ready_blocks(spark, sf)
    trials = b.select(*KEY).distinct()
    out, _ = reliability.external(trials, b)
    return out


@query("emg_chain")
def emg_chain(spark, sf):
    """Signal conditioning of every vector taken as a short 1 kHz channel."""
    from ..config import Preprocess
    from ..functions import signal
    from ..plans.preprocess import emg_chain as chain
    rows = whole_vectors(spark, sf).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(1000.0).alias("fs"))
    done = rows.select("vec_id", signal.clip_fraction("v").alias("clip_frac"), chain(Preprocess())("v", "fs").alias("_e"))
    return done.select("vec_id", "clip_frac", r(F.array_max("_e.env")).alias("peak"),
                       r(signal.rms("_e.filtered")).alias("rms"), "_e.notch_freq", "_e.ratio_pre_max")


def variant_inputs(spark, sf):
    """The envelope's bounds and the surrogates' null thresholds of the stated factors, with all replicates of both."""
    b, stable, factors = stated_tables(spark, sf)
    fid = cut_lineage(fidelity.reference(stable, factors, b))
    null = cut_lineage(fidelity.surrogates(fid, factors, b))
    bounds, _ = reliability.envelope(stable, b)
    return b, stable, cut_lineage(bounds), null


@query("variant_floors")
def variant_floors(spark, sf):
    b, stable, bounds, null = variant_inputs(spark, sf)
    return sensitivity.variant_floors(sensitivity.VARIANTS, stable, bounds, null, b)


@query("breakpoint_crosscheck")
def breakpoint_crosscheck(spark, sf):
    """Hinge and mean-shift breakpoints of each nation's price curve over order years."""
    from ..plans import changepoint
    from .statistics import year_profile
    within, pairs = year_profile(spark, sf)
    group = ["dataset", "subject", "trial"]
    curve = cut_lineage(pairs.groupBy(*group, F.col("speed_b_mps").alias("q_speed_mps")).agg(
        F.avg("fidelity_a_to_b").alias("fidelity_ref_to_q"), F.max("fidelity_a_to_b").alias("fidelity_q_to_ref")))
    floors = within.groupBy(*group).agg(F.min("speed_mps").alias("floor_speed_mps"))
    return changepoint.crosscheck(curve, floors)
