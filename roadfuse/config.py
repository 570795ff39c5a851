"""Tunable settings. The defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

# Engine versions as they are recorded in the run audit.
PRIMARY_ENGINE = "fusion.matlab_port_v1"
FALLBACK_ENGINE = "fusion.python_v1"

# Class taxonomy in ascending energy order.
CLASS_NOT = "not"
CLASS_CRACK = "crack"
CLASS_POTHOLE = "pothole"
CLASSES = (CLASS_NOT, CLASS_CRACK, CLASS_POTHOLE)


@dataclass(frozen=True)
class Config:
    # ingest
    max_batch_size: int = 100
    max_frame_size_bytes: int = 10_485_760
    rate_limit_events_per_hour: int = 100
    rate_limit_frames_per_hour: int = 100
    storage_bucket: str | None = None

    # pairing and fusion
    fusion_engine_version: str = PRIMARY_ENGINE
    fusion_batch_size: int | None = None
    fusion_window_ms: int = 3000
    fusion_window_m: float = 25.0
    fusion_w_s: float = 0.5
    fusion_w_v: float = 0.5
    fallback_ratio_mean: float = 3.0
    fallback_ratio_std: float = 1.0

    # severity proxy
    severity_speed_ref: float = 5.0
    severity_scale: float = 2.0

    # sensor model
    fit_min_observations: int = 200
    fit_k: int = 3
    fit_restarts: int = 10
    iforest_contamination: float = 0.1
    iforest_trees: int = 100
    iforest_sample: int = 256
    random_state: int = 42

    # clustering
    cluster_eps_m: float = 25.0
    cluster_min_points: int = 3
    cluster_window_days: int = 30
    cluster_member_min_confidence: float = 0.5
    cluster_min_distinct_devices: int = 2
