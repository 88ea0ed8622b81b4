"""Run one stage on tables: ``spark-submit -m kinespark STAGE --in FOLDER --out FOLDER``.

Inputs and outputs are Parquet tables under the two folders, named as in the
README. Exit codes: 0 done, 1 some inputs failed or files differ, 2 nothing usable.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .plans import (changepoint, extraction, fidelity, floors, manifests, preprocess, reliability, reorganisation,
                    sensitivity)
from .functions import kernels
from .operators.matrices import pack_profiles
from .session import build_session, cut_lineage
from .sinks import tables as sinks
from .functions.keys import speed_key
from .sources import npz
from .sources.files import read_manifest, read_table
from .sources.tables import read_csv, read_signal_text

FAILED, UNUSABLE = 1, 2
REGISTRY = "dataset string, subject string, trial double, speed_mps double, file_matched_resolved string, file_matched string"


class Run:
    """Folders and options of one stage run."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, config.input_roots(self.args.input), name)

    def read_result(self, name: str) -> DataFrame | None:
        """What an earlier run of the stage wrote, if any."""
        try:
            return self.spark.read.parquet(f"{self.args.out}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def blocks(self) -> DataFrame:
        return self.read("stride_blocks")

    def write(self, df: DataFrame, name: str, **how) -> None:
        sinks.write_table(df, f"{self.args.out}/{name}", overwrite=self.args.overwrite, **how)


def _report(run: Run, name: str, title: str, facts: dict[str, object], tables: dict[str, DataFrame]) -> None:
    """Parameters and small aggregated tables of a stage as a text of its own."""
    known = {"input": run.args.input, "dataset": run.args.dataset or "all", **facts}
    sinks.write_text(run.spark, f"{run.args.out}/{name}", sinks.summary_text(title, known, tables))


def _counts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("subjects")).orderBy(F.desc("subjects"), name)


def run_preprocess(run: Run) -> int:
    out = preprocess.preprocess(run.read("signals"), run.read("channel_map"), config.load_config(run.args.params))
    # one partition per subject, so rerunning a subject replaces its rows only
    sinks.upsert_partitions(out.qc, f"{run.args.out}/preprocessing_qc", ["subject"])
    sinks.upsert_partitions(out.full, f"{run.args.out}/stride_profiles_full", ["subject"])
    sinks.upsert_partitions(out.matched, f"{run.args.out}/stride_profiles", ["subject"])
    sinks.upsert_partitions(pack_profiles(out.matched, extraction.KEY), f"{run.args.out}/stride_blocks", ["subject"])
    return 0


def run_pack(run: Run) -> int:
    """Stride profiles from elsewhere into the block table all later stages read."""
    run.write(pack_profiles(run.read("stride_profiles"), extraction.KEY), "stride_blocks")
    return 0


def run_extract(run: Run) -> int:
    done = run.read_result("nmf_summary") if run.args.resume else None
    out = cut_lineage(extraction.extract(run.blocks(), done))
    if done is not None:
        # a condition without any feasible rank has a row whose k is NULL: it is known too
        known = done.select(*extraction.KEY, "k").distinct().alias("_done")
        same = [F.col(f"_out.{c}").eqNullSafe(F.col(f"_done.{c}")) for c in [*extraction.KEY, "k"]]
        fresh = cut_lineage(out.alias("_out").join(known, same, "left_anti"))
        out = fresh.unionByName(done, allowMissingColumns=True)
        sinks.append_rows(fresh, f"{run.args.out}/nmf_summary")
    else:
        run.write(out, "nmf_summary")
    return FAILED if out.where(~F.col("ok")).take(1) else 0


def run_rank(run: Run) -> int:
    targets = {n: v for n, v in (("total_target", run.args.total_target), ("channel_target", run.args.channel_target)) if v is not None}
    out = cut_lineage(extraction.choose_rank(run.read("nmf_summary"), **targets))
    run.write(out, "chosen_k")
    return FAILED if out.where("chosen_k IS NULL").take(1) else 0


def run_stability(run: Run) -> int:
    summary = run.read("nmf_summary")
    out = cut_lineage(extraction.stability(run.blocks(), run.read("chosen_k"), summary))
    run.write(out, "stability_summary")
    weights = cut_lineage(extraction.module_weights(out, summary))
    run.write(weights, "final_synergies")
    names = run.args.muscles.split(";") if run.args.muscles else []
    if names:
        labels = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("muscle_idx", "muscle")
        muscles = weights.select(*extraction.KEY).distinct().select(*extraction.KEY, labels)
        run.write(extraction.wide_modules(weights, muscles, names), "final_synergies_wide")
    chosen = out.select(*extraction.KEY, "k").join(summary.select(*extraction.KEY, "k", "w", "m"), [*extraction.KEY, "k"])
    run.write(chosen, "factors")
    return 0


def run_fidelity(run: Run) -> int:
    run.write(fidelity.reference(run.read("stability_summary"), run.read("factors"), run.blocks()), "coordination_fidelity")
    return 0


def run_pairwise(run: Run) -> int:
    run.write(fidelity.pairwise(run.read("stability_summary"), run.read("factors"), run.blocks()), "full_pairwise_fidelity")
    return 0


def run_envelope(run: Run) -> int:
    out, dist = reliability.envelope(run.read("stability_summary"), run.blocks(), run.args.n or reliability.ENVELOPE_BOOT,
                                     run.args.n_ci or reliability.ENVELOPE_CI)
    out = cut_lineage(out)
    if not out.take(1):
        return FAILED
    run.write(out, "reliability_envelope")
    run.write(dist, "reliability_distributions")
    return 0


def run_surrogates(run: Run) -> int:
    fid = run.read("coordination_fidelity")
    if run.args.test:
        fid = fid.orderBy("dataset", "subject", "trial", "q_speed_mps").limit(1)
    n = 10 if run.args.test else run.args.n or fidelity.N_SURROGATES
    run.write(fidelity.surrogates(fid, run.read("factors"), run.blocks(), n), "surrogate_baseline")
    return 0


def run_similarity(run: Run) -> int:
    run.write(fidelity.similarity(run.read("coordination_fidelity"), run.blocks()), "spatial_temporal_metrics")
    return 0


def run_floors(run: Run) -> int:
    gates, table = floors.detect(run.read("reliability_envelope"), run.read("coordination_fidelity"),
                                 run.read("surrogate_baseline"), run.read("spatial_temporal_metrics"))
    run.write(gates, "coordination_floor_gates_by_speed")
    run.write(table, "coordination_floors")
    return 0


def run_changepoint(run: Run) -> int:
    gates = run.read("coordination_floor_gates_by_speed")
    run.write(changepoint.fidelity_curve(gates, run.args.dataset), "fidelity_curve")
    grid = run.args.n or 2000
    out = cut_lineage(changepoint.crosscheck(gates, run.read("coordination_floors"), grid, run.args.dataset))
    run.write(out, "changepoint_crosscheck")
    _report(run, "changepoint_summary", "Breakpoint cross-check", {
        "rows": out.count(), "curve": "smaller of both fidelities by tested speed", "hinge": f"grid of {grid} breakpoints",
        "mean shift": "one change, midway between neighbouring tested speeds"}, {
        "Nearest tested speed of the hinge": _counts(out, F.col("segmented_breakpoint_nearest_tested_speed_mps"), "speed_mps"),
        "Mean shift": _counts(out, F.round("pelt_breakpoint_mid_mps", 2), "speed_mps")})
    return 0


def run_sensitivity(run: Run) -> int:
    out = cut_lineage(sensitivity.all_variants(
        run.read("coordination_floors"), run.read("stability_summary"), run.read("reliability_envelope"),
        run.read("surrogate_baseline"), run.blocks()))
    icc, limits = sensitivity.agreement(out)
    run.write(out, "sensitivity_comparison")
    run.write(icc, "icc_summary")
    run.write(limits, "bland_altman_summary")
    floor = F.col("floor_speed_mps")
    by_variant = out.groupBy("variant").agg(F.count(floor).alias("subjects"), F.avg(floor).alias("mean"), F.stddev_samp(floor).alias("sd"),
                                            F.min(floor).alias("min"), F.max(floor).alias("max")).orderBy("variant")
    _report(run, "sensitivity_summary", "Floors under other choices", {
        "subjects": out.select("dataset", "subject", "trial").distinct().count(), "starts": sensitivity.N_STARTS, "seed": sensitivity.SEED,
        "share of strides in stride_half": sensitivity.HALF}, {
        "Floors": by_variant, "ICC(2,1), good agreement from 0.75": icc, "Bland-Altman limits against the baseline": limits})
    return 0


def run_external(run: Run) -> int:
    blocks = run.blocks()
    done = run.read_result("external_reliability") if run.args.resume else None
    results, failed = reliability.external(blocks.select(*extraction.KEY).distinct(), blocks, done)
    sinks.append_rows(results, f"{run.args.out}/external_reliability")
    sinks.append_rows(failed, f"{run.args.out}/external_failed")
    return 0


def run_compare(run: Run) -> int:
    """Bounds of the two data sets side by side, with the two-sample test of their difference."""
    summary, test = reliability.compare_datasets(
        run.read("external_reliability"), run.read("reliability_envelope"), "external", run.args.dataset or "main")
    run.write(summary, "dataset_bounds", fmt="csv")
    run.write(test, "dataset_test", fmt="csv")
    return 0


def run_within(run: Run) -> int:
    seed = reliability.WITHIN_SEED if run.args.seed is None else run.args.seed
    n, starts = run.args.n or reliability.WITHIN_BOOT, run.args.starts or reliability.WITHIN_STARTS
    rule = replace(kernels.WITHIN, max_iter=run.args.max_iter or kernels.WITHIN.max_iter, tol=run.args.tol or kernels.WITHIN.tol)
    stable = run.read("stability_summary")
    if run.args.dataset:
        stable = stable.where(F.col("dataset") == run.args.dataset)
    out = cut_lineage(reliability.within_speed(stable, run.blocks(), n, starts, seed, rule))
    code = sinks.write_guarded(out, f"{run.args.out}/within_speed_reliability", "n_boot_success",
                               run.args.allow_empty_output, run.args.overwrite)
    done = F.col("within_fid_mean")
    speeds = out.groupBy("speed_mps").agg(F.count(done).alias("conditions"), F.avg(done).alias("mean"), F.min(done).alias("min"),
                                          F.max(done).alias("max")).orderBy(F.desc("speed_mps"))
    _report(run, "within_speed_summary", "Half-split reliability", {
        "conditions": out.count(), "with a result": out.where(done.isNotNull()).count(), "replicates": n, "starts": starts, "seed": seed,
        "iterations": rule.max_iter, "tolerance": rule.tol}, {
        "Fidelity by speed": speeds, "Conditions without a result": _counts(out.where("notes <> ''"), F.col("notes"), "reason")})
    return code


def run_reorganisation(run: Run) -> int:
    drops = cut_lineage(reorganisation.transition_drops(
        run.read("within_speed_reliability"), run.read("full_pairwise_fidelity"), run.args.dataset))
    top = cut_lineage(reorganisation.max_reorganisation(drops))
    tests, fried = reorganisation.transition_tests(drops), reorganisation.friedman_test(drops)
    group = reorganisation.group_summary(drops, top)
    run.write(drops, "subject_transition_drops")
    run.write(top, "subject_max_reorganization")
    run.write(group, "group_reorganization_summary", fmt="csv")
    run.write(tests, "transition_statistics", fmt="csv")
    run.write(reorganisation.beyond_matrix(drops), "transition_drop_beyond_matrix", fmt="csv")
    text = sinks.summary_text("Reorganisation profile", {"subjects": top.count()},
                              {"Transitions": group, "Friedman": fried, "Paired tests": tests})
    sinks.write_text(run.spark, f"{run.args.out}/reorganization_summary", text)
    return 0


def run_manifest(run: Run) -> int:
    n, size = sinks.write_manifest(manifests.create(run.spark, run.args.input), f"{run.args.out}/manifest")
    print(f"{n} files, {size} bytes")
    return 0


def run_manifests(run: Run) -> int:
    """One manifest table for all release folders below the input."""
    run.write(manifests.create_all(run.spark, run.args.input), "manifests")
    return 0


def run_verify_releases(run: Run) -> int:
    """Files of every release against the manifests in the output folder; 2 if a release has none, 1 on any error."""
    files = cut_lineage(manifests.create_all(run.spark, run.args.input))
    known = run.spark.read.parquet(f"{run.args.out}/manifests")
    status = cut_lineage(manifests.verify_releases(known, files, files.select("release").distinct()))
    sinks.write_table(status, f"{run.args.out}/release_status", overwrite=True)
    return manifests.exit_code(status)


def run_pack_archives(run: Run) -> int:
    """Archived condition matrices and signal text (.dat), found through the registry, into the block table of all later stages."""
    registry = read_csv(run.spark, run.args.params, REGISTRY)
    columns = ["path", "block_id", "m", "x"]
    points = run.args.n or config.load_config().stride.time_norm_len
    blocks = npz.read_blocks(run.spark, run.args.input).select(*columns).unionByName(
        read_signal_text(run.spark, run.args.input, points).select(*columns))
    local = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    paths = npz.resolve_inputs(registry, blocks.select("path").distinct()).where("input_path IS NOT NULL").select(
        "dataset", "subject", F.col("trial").cast("int").alias("trial"), speed_key("speed_mps").alias("speed_key"), "input_path")
    packed = blocks.withColumn("_p", local).join(paths, F.col("_p") == F.col("input_path")).select(
        *extraction.KEY, "block_id", "m", F.size("x").cast("bigint").alias("cells"), "x")
    run.write(packed, "stride_blocks")
    return 0


def run_verify(run: Run) -> int:
    manifest = read_manifest(run.spark, run.args.params)
    status = manifests.verify(manifest, manifests.create(run.spark, run.args.input))
    return FAILED if status.where("status <> 'OK'").take(1) else 0


STAGES = {name[4:].replace("_", "-"): fn for name, fn in list(globals().items()) if name.startswith("run_")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinespark")
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("--in", dest="input", required=True, help="folder of input tables")
    p.add_argument("--out", required=True, help="folder of output tables")
    p.add_argument("--params", help="YAML parameters (preprocess) or manifest CSV (verify)")
    p.add_argument("--dataset", help="restrict to one dataset")
    p.add_argument("--n", type=int, help="surrogates, replicates or grid points; points of a stride in signal text")
    p.add_argument("--starts", type=int, help="starts of a fit")
    p.add_argument("--seed", type=int, help="seed of the draws")
    p.add_argument("--max-iter", type=int, help="passes of a fit (within)")
    p.add_argument("--tol", type=float, help="tolerance of a fit (within)")
    p.add_argument("--n-ci", type=int, help="resamples of a bound (envelope)")
    p.add_argument("--total-target", type=float, help="explained variance a rank must reach in total (rank)")
    p.add_argument("--channel-target", type=float, help="explained variance a rank must reach in every channel (rank)")
    p.add_argument("--muscles", help="channel names in order, joined by ';' (wide module table)")
    p.add_argument("--test", action="store_true", help="one pair, ten surrogates")
    p.add_argument("--resume", action="store_true", help="skip finished conditions")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--allow-empty-output", action="store_true")
    args = p.parse_args(argv)
    # a master given by spark-submit wins over the local default
    spark = build_session(f"kinespark-{args.stage}", os.environ.get("KINESPARK_MASTER"))
    return STAGES[args.stage](Run(spark, args))


if __name__ == "__main__":
    raise SystemExit(main())
