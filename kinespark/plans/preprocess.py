"""Raw signals to screened, normalised and matched strides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Preprocess
from ..functions import kernels, signal
from ..functions.keys import condition_speed, speed_key, speed_suffix
from ..operators import contacts as steps
from ..operators.draws import drawn
from ..operators.intervals import chunked, window_sums
from ..operators.joins import nearest_lookup, shifted_channels
from ..operators.quantiles import drift_union, duration_screen
from ..operators.segments import row_numbers
from ..operators.selection import choose_parity, common_items, top_row
from ..session import cut_lineage

TRIAL = ["subject", "speed_key", "fs"]
# Force channel labels, and the early and late burst channels that tell the legs apart.
FORCE = ("Force.Fz1", "Force.Fz2")
EARLY, LATE = "Tibialis", "Sol"
UNUSABLE_SCORE = 1e9
# samples of a chunk of a signal
CHUNK = 1 << 14

DOUBLES = T.ArrayType(T.DoubleType())
EMG_FIELDS = T.StructType([
    T.StructField("env", DOUBLES), T.StructField("filtered", DOUBLES), T.StructField("notch_freq", T.DoubleType()),
    T.StructField("ratio_pre_max", T.DoubleType()), T.StructField("ratio_post_max", T.DoubleType())])


@dataclass(frozen=True)
class Preprocessed:
    """Quality rows, all strides, and strides matched across speeds (both as stride profiles)."""

    qc: DataFrame
    full: DataFrame
    matched: DataFrame


def _same_shape(values: pd.Series, fs: pd.Series) -> dict[tuple[int, float], list[int]]:
    """Row numbers by (length, rate): such channels are filtered together."""
    groups: dict[tuple[int, float], list[int]] = {}
    for i, (v, f) in enumerate(zip(values, fs)):
        groups.setdefault((len(v), float(f)), []).append(i)
    return groups


def emg_chain(p: Preprocess):
    """Column function (values, fs): demean, band-pass, conditional notch, rectified envelope."""

    @F.pandas_udf(EMG_FIELDS)
    def run(values: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(values)
        for (_, rate), rows in _same_shape(values, fs).items():
            X = np.stack([values.iloc[i] for i in rows]).astype(float)
            X = kernels.zero_phase(*kernels.butterworth(p.bandpass_order, p.bandpass_hz, rate, "bandpass"),
                                   X - X.mean(axis=1, keepdims=True))
            mains = p.notch_freqs_hz or ()
            pre = np.array([[kernels.mains_ratio(x, rate, f) for f in mains] for x in X]).reshape(len(X), -1)
            best = pre.argmax(axis=1) if pre.size else np.zeros(len(X), dtype=int)
            top = pre.max(axis=1, initial=0.0)
            hum = np.flatnonzero((top >= p.notch_ratio_threshold) & p.notch_enabled & bool(mains))
            for f in set(best[hum]):
                which = hum[best[hum] == f]
                X[which] = kernels.zero_phase(*kernels.notch(mains[f], p.notch_q, rate), X[which])
            post = np.array([max([kernels.mains_ratio(x, rate, f) for f in mains], default=0.0) for x in X])
            env = kernels.zero_phase(*kernels.butterworth(p.envelope_order, p.envelope_lowpass_hz, rate, "lowpass"),
                                     np.abs(X))
            for j, i in enumerate(rows):
                freq = mains[best[j]] if j in hum else None
                out[i] = (np.maximum(env[j], 0), X[j], freq, top[j], post[j])
        return pd.DataFrame(out, columns=EMG_FIELDS.fieldNames())

    return run


def low_pass(cutoff: float, order: int = 4):
    """Column function (values, fs): zero-phase low-pass."""

    @F.pandas_udf(DOUBLES)
    def run(values: pd.Series, fs: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        for (_, rate), rows in _same_shape(values, fs).items():
            X = np.stack([values.iloc[i] for i in rows]).astype(float)
            Y = kernels.zero_phase(*kernels.butterworth(order, cutoff, rate, "lowpass"), X)
            for j, i in enumerate(rows):
                out[i] = Y[j]
        return pd.Series(out)

    return run


def bind_channels(signals: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Signals of the mapped channels by name.

    A trial without its own mapping row borrows the nearest mapped speed of the
    subject; numbers beyond the file's channels are shifted as a block.
    """
    trials = signals.groupBy("subject", "speed_key").agg(F.first("n_analogs").alias("n_analogs"))
    sheet = channel_map.withColumn("map_speed", condition_speed("condition")).where("map_speed IS NOT NULL")
    wanted = trials.select("subject", "speed_key", (F.col("speed_key") / 100).alias("map_speed"))
    nearest = nearest_lookup(wanted, sheet.select("subject", "map_speed"), ["subject"], "speed_key", "map_speed").select(
        "subject", "speed_key", F.col("nearest").alias("map_speed"))
    bound = nearest.join(sheet, ["subject", "map_speed"]).join(trials, ["subject", "speed_key"])
    fixed = shifted_channels(bound, ["subject", "speed_key"], "channel_num", F.col("n_analogs"))
    return fixed.select("subject", "speed_key", "muscle", "channel_num").join(
        signals.select("subject", "speed_key", "channel_num", "fs", "values"), ["subject", "speed_key", "channel_num"])


def conditioned(signals: DataFrame, channel_map: DataFrame, config: Config) -> DataFrame:
    """One row per trial and channel: envelope, filtered signal and quality flags."""
    p = config.preprocess
    bound = bind_channels(signals, channel_map).where(F.col("muscle").isin(*config.muscles))
    rows = bound.withColumn("_e", emg_chain(p)("values", "fs"))
    rows = rows.select(
        *TRIAL, "muscle", "channel_num", signal.clip_fraction("values", p.clip_abs_v, p.clip_tol_v).alias("clip_frac"),
        "_e.*")
    rows = rows.withColumn("clip_fail", F.col("clip_frac") >= p.clip_frac_max).withColumn(
        "notch_applied", F.col("notch_freq").isNotNull()).withColumn(
        "residual_mains_fail", F.col("notch_freq").isNotNull() & (F.col("ratio_post_max") >= p.notch_ratio_threshold_post))
    return rows


def force_contacts(signals: DataFrame, config: Config) -> DataFrame:
    """Contacts (start, end) per trial from the summed vertical forces."""
    s = config.stride
    exact, name = F.col("label"), F.lower("label")
    plates = signals.where(name.isin(*[f.lower() for f in FORCE]))
    plates = top_row(plates.withColumn("_plate", name), [*TRIAL, "_plate"],
                     [(~exact.isin(*FORCE)).cast("int"), F.col("channel_num")], lowest=True)
    both = plates.groupBy(*TRIAL).agg(
        *[F.first(F.when(F.col("_plate") == f.lower(), signal.standardise_sign("values")), True).alias(f"f{i}")
          for i, f in enumerate(FORCE)])
    total = both.select(*TRIAL, F.zip_with("f0", "f1", lambda a, b: a + b).alias("fz"))
    smooth = total.select(*TRIAL, low_pass(s.force_lowpass_hz)("fz", "fs").alias("fz"))
    trace = smooth.select(*TRIAL, F.posexplode(signal.standardise_sign("fz")).alias("i", "v"))
    trace = trace.withColumn("part", F.floor(F.col("i") / 65536))
    found = steps.contacts(trace, TRIAL, ["i"], "v", "i", s.grf_threshold_n, s.grf_threshold_n * s.thr_off_ratio, "part")
    gap = F.bround(F.lit(s.min_strike_interval_s) * F.col("fs"))
    return steps.spaced_contacts(found.select(*TRIAL, "start", "end"), TRIAL, gap)


def _segments(rows: DataFrame, windows: DataFrame, keys: list[str], make) -> DataFrame:
    """Evaluate ``make(window)`` for every window of a trial against each channel row.

    Windows travel as one short array per trial, so a channel's signal is read
    where it is and never copied per window.
    """
    w = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b", *[
        c for c in windows.columns if c not in [*keys, "a", "b"]]))).alias("_w"))
    return rows.join(w, keys).withColumn("_out", F.transform("_w", make))


def _piece(values: str, start: Column, stop: Column) -> Column:
    return F.slice(values, (start + 1).cast("int"), (stop - start).cast("int"))


def parity_scores(emg: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """Timing score per trial and parity: burst spread plus a penalty for a late-before-early order."""
    T_len = config.stride.time_norm_len
    keys = [*TRIAL, "parity"]
    ranked = row_numbers(windows, keys, ["a"], "_rn")
    kept = windows.groupBy(*keys).agg(F.count("*").alias("kept"))
    first = ranked.where(F.col("_rn") <= 30).drop("_rn")
    bursts = emg.where(F.col("muscle").isin(EARLY, LATE)).select(*TRIAL, "muscle", "env")
    w = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_w"))
    peaks = bursts.join(w, TRIAL).select(*keys, "muscle", F.posexplode(F.transform("_w", lambda x: signal.argmax(
        signal.time_normalise(_piece("env", x["a"], x["b"]), T_len)))).alias("_j", "peak"))
    both = peaks.groupBy(*keys, "_j").agg(F.max(F.when(F.col("muscle") == EARLY, F.col("peak"))).alias("early"),
                                          F.max(F.when(F.col("muscle") == LATE, F.col("peak"))).alias("late"))
    scored = both.groupBy(*keys).agg(
        F.stddev_pop("early").alias("_e"), F.stddev_pop("late").alias("_l"),
        F.avg((F.col("late") <= F.col("early")).cast("double")).alias("_o"))
    raw = F.col("_e") + F.col("_l") + 50.0 * F.col("_o")
    out = kept.join(scored, keys, "left")
    return out.select(*keys, "kept", F.when(F.col("kept") >= 5, F.coalesce(raw, F.lit(UNUSABLE_SCORE))).otherwise(
        UNUSABLE_SCORE).alias("score"))


def baseline_medians(emg: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """Median of the filtered signal just before each stride; strides starting too early are dropped."""
    s = config.stride
    pre, end = (F.bround(F.lit(v) * F.col("fs")).cast("int") for v in (s.baseline_pre_s, s.baseline_end_s))
    usable = windows.where((F.col("a") - pre >= 0) & (pre > end))

    def median(w: Column) -> Column:
        ordered = F.array_sort(_piece("filtered", w["a"] - pre, w["a"] - end))
        mid = signal.let(ordered, lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int"))
                                             + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)
        return F.struct(w["a"].alias("a"), mid.alias("base"))

    rows = _segments(emg.select(*TRIAL, "muscle", "filtered"), usable, TRIAL, median)
    return rows.select(*TRIAL, "muscle", F.explode("_out").alias("_o")).select(*TRIAL, "muscle", "_o.*")


def signal_to_noise(emg: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """Median over strides of active over baseline RMS, per trial and channel."""
    s, eps = config.stride, config.preprocess.snr_eps
    pre, end = (F.bround(F.lit(v) * F.col("fs")).cast("int") for v in (s.baseline_pre_s, s.baseline_end_s))
    usable = windows.where((F.col("toe") > F.col("a")) & (F.col("a") - pre >= 0))
    both = usable.select(*TRIAL, F.col("a").alias("stride"), F.explode(F.array(
        F.struct(F.lit(True).alias("active"), F.col("a").alias("a"), F.col("toe").alias("b")),
        F.struct(F.lit(False).alias("active"), (F.col("a") - pre).alias("a"), (F.col("a") - end).alias("b")))).alias("_w")).select(
        *TRIAL, "stride", "_w.*")
    chunks = chunked(emg, [*TRIAL, "muscle"], "filtered", CHUNK)
    sums = window_sums(chunks, both, TRIAL, ["stride", "active"], CHUNK, lambda v: v * v, signal=["muscle"])
    level = F.sqrt(F.col("total") / F.col("n"))
    ratios = sums.groupBy(*TRIAL, "muscle", "stride").agg(
        (F.max(F.when(F.col("active"), level)) / (F.max(F.when(~F.col("active"), level)) + eps)).alias("snr"))
    # one number per stride of a trial
    return ratios.groupBy(*TRIAL, "muscle").agg(F.median("snr").alias("snr_median"))


def matched_strides(strides: DataFrame, seed: int) -> DataFrame:
    """Strides (subject, speed_key, stride_idx) kept so that all speeds of a subject have equally many, with ``matched_idx``."""
    key = ["subject", "speed_key"]
    counts = strides.groupBy(*key).agg(F.count("*").alias("n"))
    sizes = counts.join(counts.groupBy("subject").agg(F.min("n").alias("size")), "subject").select(*key, "size")
    kept = drawn(strides.select(*key, "stride_idx"), key, ["stride_idx"], sizes, F.lit(seed))
    placed = row_numbers(kept.withColumn("_chunk", F.floor(F.col("stride_idx") / 10_000)), key, ["stride_idx"], "_rn", "_chunk")
    return placed.select(*key, F.col("stride_idx").cast("bigint").alias("stride_idx"), (F.col("_rn") - 1).alias("matched_idx"))


def preprocess(signals: DataFrame, channel_map: DataFrame, config: Config = Config(),
               dataset: str = "vanhooren") -> Preprocessed:
    """The whole chain for every subject at once.

    A subject yields strides only when every speed is usable and enough channels
    pass at all of them; quality rows are produced for everyone.
    """
    s = config.stride
    signals = signals.withColumn("speed_key", speed_key("speed_mps"))
    emg = cut_lineage(conditioned(signals, channel_map, config))
    ref = emg.where(F.col("speed_key") == round(config.reference_speed * 100)).select(
        "subject", "muscle", F.array_max("env").alias("ref_peak"),
        (~F.col("clip_fail") & ~F.col("residual_mains_fail")).alias("ref_ok"))
    flags = emg.drop("env", "filtered").join(ref, ["subject", "muscle"], "left").withColumn(
        "ref_ok", F.coalesce("ref_ok", F.lit(True)))
    flags = flags.withColumn("pre_fail", F.col("clip_fail") | F.col("residual_mains_fail") | ~F.col("ref_ok"))
    touch = cut_lineage(force_contacts(signals, config))
    windows = steps.stride_windows(touch, TRIAL).withColumn("duration", (F.col("b") - F.col("a")) / F.col("fs"))
    screened = cut_lineage(duration_screen(windows, [*TRIAL, "parity"], "duration", s.stride_duration_min_s,
                                           s.stride_duration_max_s, s.stride_duration_mad_k, small_groups=True).drop("duration"))
    scores = parity_scores(emg, screened, config)
    chosen = cut_lineage(choose_parity(scores, TRIAL, s.min_strides))
    toes = touch.select(*TRIAL, F.col("start").alias("a"), F.col("end").alias("toe"))
    picked = screened.join(chosen.select(*TRIAL, "parity"), [*TRIAL, "parity"]).select(*TRIAL, "a", "b")
    valid = picked.join(toes, [*TRIAL, "a"], "left").where((F.col("toe") > F.col("a")) & (F.col("toe") < F.col("b")))
    valid = cut_lineage(valid)
    passing = emg.join(flags.where(~F.col("pre_fail")).select(*TRIAL, "muscle"), [*TRIAL, "muscle"], "left_semi")
    base = cut_lineage(baseline_medians(passing, valid, config))
    kept, drift = drift_union(base, TRIAL, "muscle", "a", "base", s.drift_mad_z, s.drift_channel_fail_frac,
                              small_groups=True)
    # a trial with no channel left to check keeps its windows
    checked = passing.select(*TRIAL).distinct()
    final = cut_lineage(valid.join(kept, [*TRIAL, "a"], "left_semi").unionByName(
        valid.join(checked, TRIAL, "left_anti")))
    channels = flags.join(drift.select(*TRIAL, "muscle", F.col("outlier_frac").alias("drift_outlier_frac"), "drift_fail"),
                          [*TRIAL, "muscle"], "left").withColumn("drift_fail", F.coalesce("drift_fail", F.lit(False)))
    channels = cut_lineage(channels.withColumn("usable", ~F.col("pre_fail") & ~F.col("drift_fail")))
    snr = signal_to_noise(emg.join(channels.where("usable").select(*TRIAL, "muscle"), [*TRIAL, "muscle"], "left_semi"),
                          final, config)
    per_trial = snr.groupBy(*TRIAL).agg(F.median("snr_median").alias("_snr"))
    count = {"n_step_contacts": touch, "n_strides_pre_toeoff": picked, "n_strides_post_toeoff": valid,
             "n_strides_post_drift": final}
    trial = channels.groupBy(*TRIAL).agg(F.count_if("usable").alias("_channels"))
    for name, rows in count.items():
        trial = trial.join(rows.groupBy(*TRIAL).agg(F.count("*").alias(name)), TRIAL, "left").withColumn(
            name, F.coalesce(name, F.lit(0)))
    parities = scores.groupBy(*TRIAL).agg(*[F.coalesce(F.max(F.when(F.col("parity") == i, F.col("kept"))), F.lit(0)).alias(
        f"parity{i}_kept") for i in (0, 1)])
    trial = trial.join(parities, TRIAL, "left").join(
        chosen.select(*TRIAL, F.col("parity").alias("parity_chosen")), TRIAL, "left").join(per_trial, TRIAL, "left")
    trial = trial.withColumn("speed_ok", (F.col("n_strides_post_drift") >= s.min_strides)
                             & F.col("parity_chosen").isNotNull() & (F.col("_channels") >= 2))
    trial = cut_lineage(trial.withColumn("low_snr_flag_speed", F.coalesce(F.col("_snr") < config.preprocess.snr_floor, F.lit(False))))
    n_speeds = len(config.speeds)
    whole = trial.groupBy("subject").agg(F.count_if("speed_ok").alias("_ok"), F.count("*").alias("_n")).where(
        (F.col("_ok") == n_speeds) & (F.col("_n") == n_speeds)).select("subject")
    shared = common_items(channels.where("usable").join(whole, "subject", "left_semi").select("subject", "muscle", "speed_key"),
                          ["subject"], "muscle", "speed_key", n_speeds, s.min_muscles)
    order = emg.sparkSession.createDataFrame([(m, i) for i, m in enumerate(config.muscles)], "muscle STRING, _order INT")
    ranked = row_numbers(shared.join(F.broadcast(order), "muscle"), ["subject"], ["_order"], "_rn")
    output = cut_lineage(ranked.select("subject", "muscle", (F.col("_rn") - 1).cast("int").alias("muscle_idx")))
    qc = (channels.join(trial.drop("_channels"), TRIAL).join(snr, [*TRIAL, "muscle"], "left")
          .join(output.select("subject", "muscle", F.lit(True).alias("_in")), ["subject", "muscle"], "left"))
    qc = qc.select(
        "subject", (F.col("speed_key") / 100).alias("speed"), speed_suffix(F.col("speed_key") / 100).alias("suffix"),
        "muscle", "channel_num", (F.col("usable") & F.col("speed_ok")).alias("passed_speed_qc"), "ref_ok", "clip_frac",
        "clip_fail", "notch_applied", "notch_freq", "ratio_pre_max", "ratio_post_max", "residual_mains_fail",
        "drift_outlier_frac", "drift_fail", "snr_median", "low_snr_flag_speed", "n_step_contacts", "parity0_kept",
        "parity1_kept", "parity_chosen", "n_strides_pre_toeoff", "n_strides_post_toeoff", "n_strides_post_drift",
        "speed_ok", (F.coalesce("_in", F.lit(False)) & F.col("speed_ok")).alias("included_in_output"))
    sources = emg.select(*TRIAL, "muscle", "env").join(output, ["subject", "muscle"]).join(
        ref.select("subject", "muscle", "ref_peak"), ["subject", "muscle"])
    shaped = _segments(sources, final.select(*TRIAL, "a", "b"), TRIAL, lambda w: signal.peak_normalise(
        signal.time_normalise(_piece("env", w["a"], w["b"]), s.time_norm_len), "ref_peak"))
    name = F.concat(F.lit("Sub_"), F.format_string("%02d", F.col("subject")))
    full = cut_lineage(shaped.select("subject", "speed_key", "muscle", "muscle_idx", F.posexplode("_out").alias("stride_idx", "values")))
    keep = matched_strides(full.where("muscle_idx = 0").select("subject", "speed_key", "stride_idx"), s.match_seed)

    def named(df: DataFrame, idx: str) -> DataFrame:
        return df.select(F.lit(dataset).alias("dataset"), name.alias("subject"), F.lit(0).alias("trial"), "speed_key",
                         "muscle", "muscle_idx", F.col(idx).cast("bigint").alias("stride_idx"), "values")

    matched = full.join(keep, ["subject", "speed_key", "stride_idx"]).drop("stride_idx")
    return Preprocessed(qc, named(full, "stride_idx"), named(matched, "matched_idx"))
