"""Explicit schemas of the exchanged tables."""

from __future__ import annotations

REGISTRY = ("dataset STRING, subject STRING, trial STRING, speed_mps DOUBLE, reference_speed_mps DOUBLE, "
            "is_reference BOOLEAN, muscles_used STRING, common_muscles_global STRING, file_matched_resolved STRING, "
            "file_matched STRING, ok BOOLEAN")
RAW_SIGNAL = ("subject INT, speed_mps DOUBLE, label STRING, channel_num INT, n_analogs INT, fs DOUBLE, "
              "values ARRAY<DOUBLE>")
CHANNEL_MAP = "subject INT, condition STRING, muscle STRING, channel_num INT"
STRIDE_PROFILE = ("dataset STRING, subject STRING, trial INT, speed_key INT, muscle STRING, muscle_idx INT, "
                  "stride_idx BIGINT, values ARRAY<DOUBLE>")
PAIRWISE = ("dataset STRING, subject STRING, trial DOUBLE, speed_a_mps DOUBLE, speed_b_mps DOUBLE, k_a BIGINT, "
            "k_b BIGINT, n_strides_a BIGINT, n_strides_b BIGINT, fidelity_a_to_b DOUBLE, notes STRING")
WITHIN = ("dataset STRING, subject STRING, trial DOUBLE, speed_mps DOUBLE, k BIGINT, n_strides BIGINT, "
          "n_points BIGINT, n_boot BIGINT, n_boot_success BIGINT, within_fid_mean DOUBLE, within_fid_q10 DOUBLE, "
          "notes STRING")
FIDELITY = ("dataset STRING, subject STRING, trial INT, ref_speed_mps DOUBLE, q_speed_mps DOUBLE, k_ref INT, k_q INT, "
            "n_strides_ref INT, n_strides_q INT, fidelity_ref_to_q DOUBLE, fidelity_q_to_ref DOUBLE, notes STRING")
SURROGATE = ("dataset STRING, subject STRING, trial INT, q_speed_mps DOUBLE, F_null_mean DOUBLE, F_null_std DOUBLE, "
             "F_null_95 DOUBLE, fidelity_ref_to_q DOUBLE, fidelity_q_to_ref DOUBLE, pass_surrogate_ref_to_q BOOLEAN, "
             "pass_surrogate_q_to_ref BOOLEAN")
METRICS = ("dataset STRING, subject STRING, trial INT, q_speed_mps DOUBLE, k_ref INT, k_q INT, cosine_median DOUBLE, "
           "cosine_min DOUBLE, cosine_mean DOUBLE, principal_angle_max_deg DOUBLE, principal_angle_mean_deg DOUBLE, "
           "dtw_mean DOUBLE, dtw_max DOUBLE")
BOUNDS = ("dataset STRING, subject STRING, trial INT, L_ref_fidelity DOUBLE, L_ref_cosine_median DOUBLE, "
          "U_ref_dtw_mean DOUBLE, U_ref_principal_angle_max_deg DOUBLE, warning_flag STRING")
MANIFEST = "file STRING, sha256 STRING, size_bytes BIGINT"
