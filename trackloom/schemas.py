"""Schemas of the tables that stages hand on."""

from __future__ import annotations

DETECTIONS = "frame bigint, track_id bigint, cls bigint, conf double, cx double, cy double, w double, h double"
TRAJECTORIES = "track_id bigint, frame bigint, x double, y double, vx double, vy double, ax double, ay double"
CLEANED = f"{TRAJECTORIES}, speed double, accel double"
CLUSTERS = "track_id bigint, cluster bigint"
EXIT_GROUPS = "track_id bigint, exit_group int"
OUTLIERS = "track_id bigint, index bigint, x_entry double, y_entry double, x_exit double, y_exit double, reachability double, is_unreachable boolean"
TUNING = "min_samples int, xi double, max_eps double, n_clusters bigint, n_outliers bigint, pct_outliers double"
NORMALISATION = "x_min double, x_max double, y_min double, y_max double"

#: Values that stand for something missing; they stay values and do not become null.
UNTRACKED, UNKNOWN_CLASS, NOISE, UNLABELLED = -1, -1, -1, -1
