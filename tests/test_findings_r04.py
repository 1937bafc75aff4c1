"""Cases of the findings of round 4."""

from __future__ import annotations

import math
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from temblor.functions import geo
from temblor.operators import links, sequences
from tests import naive
from tests.fixtures import DAY, T0, frame


def swarm(n, seed=3, km=9.0, days=40):
    """Events of one place, their magnitudes in steps of 0.1."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.uniform(0, days, n))
    return frame(-41 + rng.uniform(0, km / 111, n), 174 + rng.uniform(0, km / 84, n), (T0 + at * DAY).astype("int64"), np.round(2 + rng.exponential(0.4, n), 1))


def linked(pdf, tau_min=1, **sizes):
    """Groups of :func:`sequences.linked_in_time` by the default rules, numbered by their first members, -1 for single events."""
    crack = lambda m: 0.011 * 10 ** (0.4 * m)

    def ahead(days, top):
        excess = np.maximum(0.5 * top - 1.5, 0.0)
        return np.maximum(tau_min, np.minimum(-math.log(0.01) * days / 10 ** ((excess - 1) * 2 / 3), 10))

    events = pdf.sort_values(["timeMs", "row_idx"]).reset_index(drop=True)
    table = pa.table({"row_idx": events.row_idx, "rank": np.arange(len(events)), "magnitude": events.magnitude, "minute": events.timeMs / 60_000, "latitude": events.latitude, "longitude": events.longitude})
    got = sequences.linked_in_time(table, ahead, lambda m: np.minimum(10 * crack(m), 30.0), lambda m: np.minimum(crack(m), 30.0), 30.0, 2, 10, **sizes).to_pandas().sort_values("rank")
    label = dict(zip(got.row_idx, pd.factorize(got.grp)[0].tolist(), strict=True))
    return [label.get(i, -1) for i in pdf.row_idx]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block, least", [(7, 3), (40, 10), (4000, 1000)])
def test_reasenberg_with_a_crowd(seed, block, least):
    """looking only outside the largest group, in blocks of any size, gives the groups of one scan."""
    pdf = swarm(300, seed, km=6.0 + 12 * seed)
    pdf["magnitude"] += np.where(np.arange(300) % 97 == 50, 2.5, 0)
    assert linked(pdf, block=block, least=least) == naive.reasenberg(pdf)


def test_reasenberg_compares_few_pairs(monkeypatch):
    """events of the largest group are not compared with each other."""
    make, kept = sequences._later, []

    class Counted:
        def __init__(self, *args):
            self.later = make(*args)

        def __getattr__(self, name):
            return getattr(self.later, name)

        def __call__(self, *args, **kwargs):
            out = self.later(*args, **kwargs)
            kept.append(len(out[0]))
            return out

    monkeypatch.setattr(sequences, "_later", Counted)
    n = 20_000
    found = linked(swarm(n, km=30.0))
    assert found.count(0) > n / 2
    assert sum(kept) <= 80 * n, sum(kept) / n


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_nearest_links_copies_few_rows(spark):
    """rows near the edge of their cell go to the cells around, not to cells of every magnitude and distance."""
    rng = np.random.default_rng(6)
    n = 12_000
    at, days = rng.integers(0, 3000, n), np.sort(rng.uniform(0, 30, n))
    pdf = frame(rng.uniform(-46, -34, 3000)[at], rng.uniform(167, 178, 3000)[at], (T0 + days * DAY).astype("int64"), np.round(2 + rng.exponential(0.43, n), 1))
    df = spark.createDataFrame(pdf)
    before = shuffled_rows(spark)
    got = links.nearest_parents(df).toPandas().set_index("row_idx").sort_index()
    moved = shuffled_rows(spark) - before
    p = geo.projected(df).toPandas().set_index("row_idx").sort_index()
    t, x, y, m = (p[c].to_numpy(float) for c in ("timeMs", "x_km", "y_km", "magnitude"))
    for i in range(100, n, 37):
        eta = np.where(t < t[i], (t[i] - t) / DAY * np.maximum(np.hypot(x[i] - x, y[i] - y), links.R_FLOOR) ** 1.6 * 10.0**-m, np.inf)
        assert got.log10_eta[i] == pytest.approx(np.log10(eta.min()), abs=1e-9)
        assert eta[int(got.parent[i])] <= eta.min() * (1 + 1e-12)
    assert moved <= 10 * n, moved / n


def test_step_time_keeps_no_batches():
    """a scan copies what it needs of a batch on the way and holds less than 100 bytes an event."""
    n, size, made, most = 200_000, 2_000, [], []

    def batches():
        rng = np.random.default_rng(1)
        for a in range(0, n, size):
            most.append(sum(m() is not None for m in made))
            r = np.arange(a, a + size)
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (r, r, r % 5, 2024 + r / n, np.full(size, 2.0), rng.uniform(-46, -34, size), rng.uniform(167, 178, size))], names=["row_idx", "rank", "back", "year", "magnitude", "latitude", "longitude"])
            made.append(weakref.ref(batch))
            yield batch
            del batch

    held = sequences._gathered(batches(), ["row_idx", "rank", "back", "year", "magnitude", "latitude", "longitude"], rows=50_000)
    assert max(most) <= 2
    assert all(len(c) == n for c in held.values()) and (held["rank"] == np.arange(n)).all()
    assert sum(c.nbytes for c in held.values()) <= 44 * n
    assert list(sequences.followed_in_time(batches(), 2.0, 0.1)) == []
    assert max(most) <= 2
