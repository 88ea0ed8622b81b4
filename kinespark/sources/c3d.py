"""C3D recordings: analog channels as rows.

The file layout is the public C3D format: 512-byte blocks, a header, a parameter
section, then frames of 3-D points followed by analog samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import speed_suffix
from ..schemas import RAW_SIGNAL
from .npz import read_files

BLOCK = 512


def parameters(data: bytes) -> dict[tuple[str, str], object]:
    """(group, name) -> value; text arrays become lists of stripped strings."""
    pos = (data[0] - 1) * BLOCK + 4
    groups: dict[int, str] = {}
    raw: list[tuple[int, str, object]] = []
    while pos < len(data):
        length, gid = struct.unpack_from("<bb", data, pos)
        length = abs(length)
        if length == 0 or gid == 0:
            break
        name = data[pos + 2:pos + 2 + length].decode("latin-1").strip().upper()
        at = pos + 2 + length
        offset = struct.unpack_from("<h", data, at)[0]
        if gid < 0:
            groups[-gid] = name
        else:
            kind, ndim = struct.unpack_from("<bB", data, at + 2)
            dims = list(data[at + 4:at + 4 + ndim])
            body = at + 4 + ndim
            count = int(np.prod(dims)) if dims else 1
            if kind == -1:
                text = data[body:body + count].decode("latin-1")
                width = dims[0] if dims else 1
                value: object = [text[i:i + width].strip() for i in range(0, count, width)] if width else []
            else:
                value = np.frombuffer(data, {1: "<i1", 2: "<i2", 4: "<f4"}[kind], count, body)
            raw.append((gid, name, value))
        if offset == 0:
            break
        pos = at + offset
    return {(groups.get(g, str(g)), n): v for g, n, v in raw}


def analog_channels(data: bytes) -> tuple[list[str], float, np.ndarray]:
    """Labels, sampling rate and (channels, samples) of a recording."""
    points, per_frame, first, last = struct.unpack_from("<HHHH", data, 2)
    scale, start, subframes, rate = struct.unpack_from("<fHHf", data, 12)
    p = parameters(data)
    channels = per_frame // subframes if subframes else 0
    if not channels:
        raise ValueError("recording has no analog channels")
    labels = [str(v) for k in ("LABELS", "LABELS2") for v in p.get(("ANALOG", k), [])][:channels]
    gain = float(np.ravel(p.get(("ANALOG", "GEN_SCALE"), [1.0]))[0])
    scales = np.ones(channels)
    given = np.ravel(p.get(("ANALOG", "SCALE"), scales))[:channels].astype(float)
    scales[:len(given)] = given
    zero = np.zeros(channels)
    given = np.ravel(p.get(("ANALOG", "OFFSET"), zero))[:channels].astype(float)
    zero[:len(given)] = given
    frames = last - first + 1
    kind = np.dtype("<f4") if scale < 0 else np.dtype("<i2")
    width = 4 * points + per_frame
    words = np.frombuffer(data, kind, frames * width, (start - 1) * BLOCK).reshape(frames, width)
    samples = words[:, 4 * points:].astype(float).reshape(frames * subframes, channels)
    return labels, float(rate) * subframes, ((samples - zero) * scales * gain).T


def _channel_rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    for subject, speed, content in zip(pdf["subject"], pdf["speed_mps"], pdf["content"]):
        labels, fs, signal = analog_channels(bytes(content))
        for i, values in enumerate(signal):
            label = labels[i] if i < len(labels) else ""
            yield subject, speed, label, i + 1, len(signal), fs, values


def read_signals(files: DataFrame) -> DataFrame:
    """One row per analog channel from rows (subject, speed_mps, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["subject", "speed_mps", "label", "channel_num", "n_analogs", "fs", "values"]
        for pdf in batches:
            yield pd.DataFrame(list(_channel_rows(pdf)), columns=names)
    return files.select("subject", "speed_mps", "content").mapInPandas(run, RAW_SIGNAL)


def _preference(name: Column, suffix: Column, subject: Column, speed: Column) -> Column:
    """Rank of a file name for a condition: exact, alternative spelling, loose match, else NULL."""
    sub = F.format_string("%02d", subject)
    exact = F.concat(F.lit("Sub_"), sub, F.lit("_"), suffix, F.lit(".c3d"))
    alternative = F.concat(F.lit("Sub_"), sub, F.lit("_"), F.regexp_replace(suffix, "^333ms$", "333"), F.lit(".c3d"))
    inclined = F.lower(name).rlike("deg|down|up")
    loose = F.startswith(name, F.concat(F.lit("Sub_"), sub)) & F.contains(name, suffix) & ~inclined
    return (F.when(name == exact, 0).when((name == alternative) & (F.abs(speed - 3.33) < 1e-6), 1).when(loose, 2))


def resolve_trials(spark: SparkSession, folder: str, conditions: DataFrame) -> DataFrame:
    """The recording of each (subject, speed_mps) condition; a condition without one is an error."""
    listing = read_files(spark, folder, "*.c3d").select(
        "path", F.regexp_replace("path", r"^.*/", "").alias("name")).where("name LIKE 'Sub_%'")
    listing = listing.withColumn("subject", F.regexp_extract("name", r"^Sub_(\d+)", 1).cast("int"))
    cand = conditions.withColumn("suffix", speed_suffix("speed_mps")).join(listing, "subject", "left")
    rank = _preference(F.col("name"), F.col("suffix"), F.col("subject"), F.col("speed_mps"))
    best = cand.withColumn("_r", rank).groupBy("subject", "speed_mps").agg(
        F.min_by("path", F.when(F.col("_r").isNotNull(), F.struct("_r", "name"))).alias("path"))
    lost = F.raise_error(F.concat(F.lit("no recording for "), F.to_json(F.struct("subject", "speed_mps"))))
    return best.withColumn("path", F.coalesce("path", lost.cast("string")))


def load_trials(spark: SparkSession, folder: str, trials: DataFrame) -> DataFrame:
    """Signals of resolved trials; contents meet conditions by path, so bytes are read once."""
    contents = read_files(spark, folder, "*.c3d").select("path", "content")
    return read_signals(trials.join(contents, "path"))
