"""Breakpoint searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .segments import ordered_scan


def single_mean_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str,
                      chunk: str | None = None) -> DataFrame:
    """Best split of an ordered series into two constant means (first minimum wins).

    Costs come from running sums of y and y squared about the key's mean, so
    every split is priced in one ordered pass.
    """
    stats = cut_lineage(df.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.count("*").alias("_n")))
    centred = df.join(stats.where("_n >= 2"), list(keys)).withColumn("_y", F.col(y) - F.col("_mean"))
    totals = centred.groupBy(*keys).agg(F.sum("_y").alias("_sum"), F.sum(F.col("_y") * F.col("_y")).alias("_sumsq"))
    scan = ordered_scan(centred, keys, order, after={"_low": F.col(x)}, chunk=chunk, sums={
        "i": F.lit(1).cast("bigint"), "_s": F.col("_y"), "_q": F.col("_y") * F.col("_y")}).join(totals, list(keys))
    rest = F.col("_n") - F.col("i")
    left = F.col("_q") - F.col("_s") * F.col("_s") / F.col("i")
    tail = F.col("_sum") - F.col("_s")
    right = (F.col("_sumsq") - F.col("_q")) - tail * tail / rest
    priced = scan.where(rest > 0).select(
        *keys, "i", F.col(x).alias("high"), F.col("_low").alias("low"), (left + right).alias("cost"))
    best = priced.groupBy(*keys).agg(F.min_by(
        F.struct("i", "cost", "high", "low"), F.struct(F.round("cost", 9), "i")).alias("_b"))
    return best.select(*keys, "_b.i", "_b.cost", "_b.high", "_b.low",
                       ((F.col("_b.high") + F.col("_b.low")) / 2).alias("mid"))


def hinge_breakpoint(df: DataFrame, keys: Sequence[str], x: str, y: str, n_grid: int = 2000,
                     ties: int = 9) -> DataFrame:
    """Grid search of y = a + b x + c max(0, bp - x), first minimum of the squared error.

    Points are summed into the grid cell they fall in (map-side combine), so a
    key becomes at most ``n_grid + 1`` rows however many points it has. Running
    sums over the cells give, for every breakpoint, the moments of the points
    below it, and the two-regressor least squares has a closed form in those.
    A collinear hinge leaves the straight-line fit, as the minimum-norm solution does.
    """
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.count("*").alias("_n"))
    ends = ends.where((F.col("_n") >= 3) & (F.col("_x1") - F.col("_x0") > 1e-9))
    lo, hi = F.col("_x0") + 1e-9, F.col("_x1") - 1e-9
    step = (hi - lo) / F.lit(float(n_grid - 1))
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(ends, list(keys))
    cx, cy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    # first grid index whose breakpoint lies above the point, and the hinge height there
    cell = F.greatest(F.lit(0), F.floor((F.col(x) - lo) / step) + 1).cast("bigint")
    h = F.greatest(F.lit(0.0), lo + F.col("g") * step - F.col(x))
    names = {"c1": F.lit(1.0), "cx": cx, "cy": cy, "h": h, "hh": h * h, "hx": h * cx, "hy": h * cy,
             "xx": cx * cx, "xy": cx * cy, "yy": cy * cy}
    cells = pts.withColumn("g", cell).groupBy(*keys, "g").agg(*[F.sum(e).alias(n) for n, e in names.items()])
    indexes = F.sequence(F.lit(0).cast("bigint"), F.lit(n_grid - 1).cast("bigint"))
    grid = ends.select(*keys, F.explode(indexes).alias("g"))
    # grid rows carry zeros so that every breakpoint sees the cells at or below it
    merged = grid.withColumn("_bp", F.lit(True)).unionByName(cells, allowMissingColumns=True)
    per_cell = merged.groupBy(*keys, "g").agg(
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names], F.bool_or("_bp").alias("_bp"))
    upto = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # moving the breakpoint one step raises every hinge below it by one step, so the
    # hinge moments are nested running sums of same-signed terms and lose no digits
    flat = per_cell.select(*keys, "g", "_bp", *[F.sum(n).over(upto).alias(n) for n in ("c1", "cx", "cy", "h", "hh", "hx", "hy")],
                           *[F.sum(n).over(whole).alias(f"t{n}") for n in ("xx", "xy", "yy")])
    flat = flat.join(ends, list(keys))

    def earlier(n: str):
        return F.coalesce(F.sum(n).over(before), F.lit(0.0))

    raised = flat.select(
        "*", *[(F.col(a) + step * earlier(b)).alias(c) for a, b, c in (
            ("h", "c1", "sh"), ("hx", "cx", "vxh"), ("hy", "cy", "vhy"))])
    raised = raised.withColumn("_rise", 2 * step * F.col("sh") + step * step * F.col("c1"))
    run = raised.withColumn("shh", F.col("hh") + earlier("_rise")).where("_bp").withColumn("bp", lo + F.col("g") * step)
    vhh, vxh, vhy = F.col("shh") - F.col("sh") * F.col("sh") / F.col("_n"), F.col("vxh"), F.col("vhy")
    vxx, vxy, vyy = F.col("txx"), F.col("txy"), F.col("tyy")
    det = vxx * vhh - vxh * vxh
    line = vyy - vxy * vxy / vxx
    gain = (vxy * vxy * vhh - 2 * vxy * vhy * vxh + vhy * vhy * vxx) / det
    sse = F.when(F.abs(det) > 1e-12 * vxx * F.greatest(vhh, F.lit(1e-300)), vyy - gain).otherwise(line)
    priced = run.select(*keys, "g", "bp", F.greatest(sse, F.lit(0.0)).alias("sse"))
    best = priced.groupBy(*keys).agg(
        F.min_by(F.struct("bp", "sse"), F.struct(F.round("sse", ties), "g")).alias("_b"))
    return best.select(*keys, "_b.bp", "_b.sse")
