"""Run parameters: code defaults, overridden section by section from a YAML file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

# Channels kept by default, in output order.
DEFAULT_MUSCLES = (
    "Sol", "GastrocMed", "GastrocLat", "Tibialis", "VastusMed", "VastusLat", "RectusFem", "BicepsFem",
    "Semitendi/membra", "GlutMax", "GlutMed")
LEVEL_SPEEDS = (2.78, 3.00, 3.33, 4.00, 5.00)


@dataclass(frozen=True)
class Preprocess:
    """Signal conditioning and channel quality."""

    bandpass_hz: tuple[float, float] = (20.0, 450.0)
    bandpass_order: int = 4
    envelope_lowpass_hz: float = 6.0
    envelope_order: int = 4
    notch_enabled: bool = True
    notch_freqs_hz: tuple[float, ...] = (50.0, 60.0)
    notch_q: float = 30.0
    notch_ratio_threshold: float = 0.05
    notch_ratio_threshold_post: float = 0.02
    clip_abs_v: float | None = None
    clip_tol_v: float = 0.05
    clip_frac_max: float = 0.001
    snr_floor: float = 3.0
    snr_eps: float = 1e-8


@dataclass(frozen=True)
class Stride:
    """Contact detection, stride screening and matching."""

    grf_threshold_n: float = 20.0
    thr_off_ratio: float = 0.5
    force_lowpass_hz: float = 20.0
    min_strike_interval_s: float = 0.20
    stride_duration_min_s: float = 0.50
    stride_duration_max_s: float = 1.50
    stride_duration_mad_k: float = 5.0
    baseline_pre_s: float = 0.05
    baseline_end_s: float = 0.01
    drift_mad_z: float = 3.0
    drift_channel_fail_frac: float = 0.20
    time_norm_len: int = 200
    match_seed: int = 20251214
    min_strides: int = 20
    min_muscles: int = 4


@dataclass(frozen=True)
class Config:
    preprocess: Preprocess = field(default_factory=Preprocess)
    stride: Stride = field(default_factory=Stride)
    muscles: tuple[str, ...] = DEFAULT_MUSCLES
    speeds: tuple[float, ...] = LEVEL_SPEEDS
    reference_speed: float = 5.0


def _section(default, values: dict | None):
    known = {f.name for f in fields(default)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items() if k in known}
    return replace(default, **given)


def load_config(path: str | None = None) -> Config:
    """Parameters from a YAML file with sections preprocess, stride and muscles."""
    if path is None:
        return Config()
    import yaml
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    muscles = next((tuple(v) for v in (raw.get("muscles") or {}).values() if v), ())
    if not muscles:
        raise ValueError("no channels are listed under muscles")
    return Config(_section(Preprocess(), raw.get("preprocess")), _section(Stride(), raw.get("stride")), muscles)


def input_roots(default: str) -> list[str]:
    """Folders upstream tables are read from, the first that holds a partition first; ``UPSTREAM_PATH`` names them, joined by ';'."""
    given = [r for r in (os.environ.get("UPSTREAM_PATH") or "").split(";") if r]
    return [*given, default] if len(given) > 1 else given or [default]
