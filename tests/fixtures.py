"""Seeded synthetic catalogues."""

from __future__ import annotations

import numpy as np
import pandas as pd

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01


def frame(lat, lon, t_ms, mag, depth=None) -> pd.DataFrame:
    n = len(lat)
    return pd.DataFrame({"row_idx": np.arange(n), "eventID": [f"e{i}" for i in range(n)], "timeMs": np.asarray(t_ms, np.int64), "latitude": np.asarray(lat, float), "longitude": np.asarray(lon, float), "depth": np.full(n, 10.0) if depth is None else np.asarray(depth, float), "magnitude": np.asarray(mag, float), "locality": "Unknown Location"})


def three_nests(seed: int = 1) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    centres = [(-41, 174), (-43.5, 172.6), (-36.8, 174.7)]
    lat = np.concatenate([c[0] + r.uniform(-0.1, 0.1, 50) for c in centres] + [-40 + r.uniform(0, 10, 20)])
    lon = np.concatenate([c[1] + r.uniform(-0.1, 0.1, 50) for c in centres] + [170 + r.uniform(0, 10, 20)])
    return frame(lat, lon, T0 + np.arange(170) * DAY, 3 + r.uniform(0, 2, 170))


def two_epochs(seed: int = 2) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    t = np.concatenate([r.uniform(0, 1, 10), 30 + r.uniform(0, 1, 10)]) * DAY
    return frame(-41 + r.uniform(-0.01, 0.01, 20), 174 + r.uniform(-0.01, 0.01, 20), T0 + t, np.full(20, 4.0))


def sequence_catalogue(seed: int = 3, n: int = 120, ties: bool = True) -> pd.DataFrame:
    """Small, dense, with repeated times and magnitudes."""
    r = np.random.default_rng(seed)
    t = np.sort(r.uniform(0, 60, n))
    mag = 2 + r.exponential(0.6, n)
    if ties:
        t = np.round(t, 1)
        mag = np.round(mag, 1)
    return frame(-41 + r.normal(0, 0.15, n), 174 + r.normal(0, 0.2, n), T0 + t * DAY, mag)
