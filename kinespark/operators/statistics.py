"""Agreement, rank and paired statistics on wide per-subject tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def friedman(df: DataFrame, block: Sequence[str], treatment: str, measure: str,
             family: Sequence[str] = ()) -> DataFrame:
    """Friedman chi-square with tie correction over complete blocks, and its p-value.

    ``df`` has one row per (block, treatment). Ranks are formed inside a block
    (a handful of rows); everything after that is a map-side combined sum.
    """
    cell = Window.partitionBy(*family, *block).orderBy(measure)
    tie = Window.partitionBy(*family, *block, measure)
    ranked = df.select(
        *family, *block, treatment,
        (F.rank().over(cell) + (F.count("*").over(tie) - 1) / 2).alias("_r"),
        F.count("*").over(tie).alias("_t"))
    per_treatment = ranked.groupBy(*family, treatment).agg(
        F.sum("_r").alias("_R"), F.count("*").alias("_n"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    agg = per_treatment.groupBy(*family) if family else per_treatment
    sums = agg.agg(F.sum(F.col("_R") * F.col("_R")).alias("_RR"), F.max("_n").cast("double").alias("n"),
                   F.count("*").cast("double").alias("k"), F.sum("_ties").alias("_T"))
    n, k = F.col("n"), F.col("k")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_RR") - 3.0 * n * (k + 1)
    chi = raw / (1.0 - F.col("_T") / (n * k * (k * k - 1)))
    return sums.select(*family, chi.alias("chi2"), special.chi2_sf(chi, k - 1).alias("p"),
                       n.cast("bigint").alias("n"), k.cast("bigint").alias("k"))


def paired_tests(wide: DataFrame, columns: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Paired t-tests of all column pairs of a complete-case table.

    One aggregate over the table yields the moments of every difference; the
    pairs are then unpacked from that single row, so subjects are never paired.
    """
    pairs = list(combinations(columns, 2))
    measures = []
    for i, (a, b) in enumerate(pairs):
        d = F.col(f"`{a}`") - F.col(f"`{b}`")
        measures += [F.avg(d).alias(f"d{i}"), F.stddev_samp(d).alias(f"s{i}")]
    means = [F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]
    grouped = wide.groupBy(*family) if family else wide
    one = grouped.agg(F.count("*").alias("n"), *means, *measures)
    at = {c: f"m{i}" for i, c in enumerate(columns)}
    rows = F.array(*[F.struct(
        F.lit(f"{a} vs {b}").alias("comparison"), F.lit(i).alias("_ord"),
        F.col(at[a]).alias("mean_drop_a"), F.col(at[b]).alias("mean_drop_b"),
        F.col(f"d{i}").alias("mean_difference"), F.col(f"s{i}").alias("_sd"))
        for i, (a, b) in enumerate(pairs)])
    long = one.select(*family, "n", F.explode(rows).alias("_p")).select(*family, "n", "_p.*")
    dz = F.when(F.col("_sd") > 0, F.col("mean_difference") / F.col("_sd"))
    return (long.withColumn("df", F.col("n") - 1).withColumn("dz", dz)
            .withColumn("t_statistic", F.col("dz") * F.sqrt("n"))
            .withColumn("p_uncorrected", special.t_two_sided("t_statistic", "df")).drop("_sd"))


def effect_interval(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add the noncentral-t confidence interval of ``dz`` from ``t_statistic`` and ``n``."""
    low, high = (special.nct_delta("t_statistic", "df", p) / F.sqrt("n")
                 for p in (1 - alpha / 2, alpha / 2))
    return df.withColumn("dz_ci_low", F.least(low, high)).withColumn("dz_ci_high", F.greatest(low, high))


def holm(df: DataFrame, p: str, family: Sequence[str] = (), tie: Sequence[str] = (),
         name: str = "p_holm") -> DataFrame:
    """Holm-Bonferroni adjusted p-values inside each family of comparisons."""
    ordered = Window.partitionBy(*family).orderBy(p, *tie)
    m = F.count(p).over(Window.partitionBy(*family))
    step = df.withColumn("_step", (m - F.row_number().over(ordered) + 1) * F.col(p))
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn(name, F.least(F.lit(1.0), F.max("_step").over(upto))).drop("_step")


def independent_t(df: DataFrame, group: str, first, second, measure: str) -> DataFrame:
    """Equal-variance two-sample t-test with Cohen's d over the mean of the variances."""
    def side(name, value):
        v = F.when(F.col(group) == value, F.col(measure))
        return [F.avg(v).alias(f"mean_{name}"), F.stddev_samp(v).alias(f"sd_{name}"),
                F.count(v).alias(f"n_{name}")]
    one = df.agg(*side("a", first), *side("b", second))
    na, nb = F.col("n_a"), F.col("n_b")
    va, vb = F.col("sd_a") * F.col("sd_a"), F.col("sd_b") * F.col("sd_b")
    gap = F.col("mean_a") - F.col("mean_b")
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    t = gap / F.sqrt(pooled * (1 / na + 1 / nb))
    out = one.select("*", t.alias("t"), (na + nb - 2).alias("df"),
                     (gap / F.sqrt((va + vb) / 2)).alias("cohens_d"))
    return out.withColumn("p", special.t_two_sided("t", "df"))


def icc21(wide: DataFrame, raters: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """ICC(2,1) of complete rows, clipped to [0, 1].

    Mean squares are linear in the variances of the row means and of the raters,
    so one aggregate is enough.
    """
    rows = wide.where(reduce(lambda a, b: a & b, [F.col(f"`{r}`").isNotNull() for r in raters]))
    k = float(len(raters))
    cols = [F.col(f"`{r}`").cast("double") for r in raters]
    mean = _total(cols) / k
    within = _total([(c - mean) * (c - mean) for c in cols])
    grouped = rows.groupBy(*family) if family else rows
    one = grouped.agg(F.count("*").alias("n"), F.var_samp(mean).alias("_vr"), F.avg(mean).alias("_g"),
                      F.sum(within).alias("_w"),
                      *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    n = F.col("n").cast("double")
    ms_rows = k * F.col("_vr")
    ss_cols = n * _total([(F.col(f"_m{i}") - F.col("_g")) ** 2 for i in range(len(cols))])
    ms_cols = ss_cols / (k - 1)
    ms_err = (F.col("_w") - ss_cols) / ((n - 1) * (k - 1))
    icc = (ms_rows - ms_err) / (ms_rows + (k - 1) * ms_err + (k / n) * (ms_cols - ms_err))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), icc))
    return one.select(*family, F.when(n >= 2, clipped).alias("icc_2_1"), "n")


def bland_altman(wide: DataFrame, baseline: str, variant: str, family: Sequence[str] = ()) -> DataFrame:
    """Mean difference, its spread and the 95 % limits of agreement."""
    rows = wide.dropna("any", subset=[baseline, variant])
    d = F.col(f"`{variant}`") - F.col(f"`{baseline}`")
    grouped = rows.groupBy(*family) if family else rows
    one = grouped.agg(F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"), F.count("*").alias("_n"))
    enough = F.col("_n") >= 2
    m, s = F.when(enough, F.col("_m")), F.when(enough, F.col("_s"))
    return one.select(*family, m.alias("mean_diff"), s.alias("sd_diff"), (m - 1.96 * s).alias("loa_lower"),
                      (m + 1.96 * s).alias("loa_upper"),
                      F.when(enough, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n"))


def group_summary(df: DataFrame, label: str, measure: str, labels: DataFrame, order: str,
                  winners: DataFrame, winner_label: str) -> DataFrame:
    """Mean, spread and count per label, share of groups peaking there, ratio to the first label.

    ``labels`` is the literal dimension (label, order, ...) and drives the row set.
    """
    stats = df.groupBy(label).agg(F.avg(measure).alias(f"{measure}_mean"),
                                  F.stddev_samp(measure).alias(f"{measure}_sd"), F.count(measure).alias("n"))
    wins = winners.groupBy(F.col(winner_label).alias(label)).agg(F.count("*").alias("n_max_here"))
    joined = F.broadcast(labels).join(stats, label, "left").join(wins, label, "left")
    hits = F.coalesce(F.col("n_max_here"), F.lit(0)).cast("bigint")
    # the label dimension is a short literal table, so one window over it is small
    whole = Window.partitionBy(F.lit(1))
    base = F.min_by(f"{measure}_mean", order).over(whole)
    total = F.greatest(F.sum(hits).over(whole), F.lit(1))
    return joined.select(
        *labels.columns, f"{measure}_mean", f"{measure}_sd", F.coalesce("n", F.lit(0)).alias("n"),
        hits.alias("n_max_here"), (hits / total * 100.0).alias("pct_max_here"),
        F.when(F.abs(base) > 1e-12, F.col(f"{measure}_mean") / base).alias("ratio_to_first"))
