"""Cases of the findings of round 3."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from temblor.functions import geo, scalar
from temblor.operators import links, sequences, validation
from temblor.plans import view_queries
from tests import naive
from tests.fixtures import DAY, T0, frame


def events_table(path, users, hours):
    """An events table of one row for each user and hour."""
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), u, "view", 100.0, "{}") for i, (u, h) in enumerate(zip(users, hours, strict=True))]
    con = duckdb.connect()
    con.register("made", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]))
    con.execute(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM made) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("users, hours", [([7] * 9, [0] * 9), ([7, 7, 7], [0, 100, 200]), ([7, 7, 7, 8], [0, 0, 0, 90])])
def test_analysis_summary_as_sql(spark, tmp_path, users, hours):
    """without noise, or without clusters, sums are null and not 0."""
    folder = events_table(tmp_path, users, hours)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    want = con.execute(view_queries.ORACLE_SQL["export_analysis_json"]).fetchall()
    got = view_queries.QUERIES["export_analysis_json"](spark, folder).collect()
    assert [tuple(r) for r in got] == want


def swarm(n, seed=3, km=9.0):
    """Events of one place in 40 days, their magnitudes in steps of 0.1."""
    rng = np.random.default_rng(seed)
    days = np.sort(rng.uniform(0, 40, n))
    return frame(-41 + rng.uniform(0, km / 111, n), 174 + rng.uniform(0, km / 84, n), (T0 + days * DAY).astype("int64"), np.round(2 + rng.exponential(0.4, n), 1))


def labels(df, n):
    got = df.toPandas().set_index("row_idx")["cluster_id"]
    return [int(got[i]) for i in range(n)]


def counting(monkeypatch):
    """Rows of every table that the sequences write."""
    kept, write = [], sequences.written

    def written(df, name="table"):
        out = write(df, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(sequences, "written", written)
    return kept


def test_step_magnitude_of_a_swarm(spark, monkeypatch):
    """batches give the clusters of one scan, and no table has the pairs of a swarm."""
    pdf, kept = swarm(300), counting(monkeypatch)
    got = sequences.step_magnitude(spark.createDataFrame(pdf), 2.0, 1, 4, first=20, growth=6)
    assert labels(got, 300) == naive.step_magnitude(pdf, 2.0, 1 / 365, 4 / 365)
    assert max(kept) <= 5 * 300


def test_step_time_of_a_swarm(spark, monkeypatch):
    """the scan looks neighbours up; no table has the pairs of a swarm, also across 180 degrees."""
    pdf, kept = swarm(300), counting(monkeypatch)
    pdf["longitude"] = (pdf.longitude + 5.95 + 180) % 360 - 180
    assert labels(sequences.step_time(spark.createDataFrame(pdf), 2.0, 1, 4), 300) == naive.step_time(pdf, 2.0, 1 / 365, 4 / 365)
    assert max(kept) <= 5 * 300


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("n, places, sizes", [(12_000, 300, {}), (2_000, 5, {"block_rows": 20, "most": 30, "largest": 10}), (700, 700, {"block_rows": 10, "most": 20, "largest": 5})])
def test_nearest_links_of_repeated_places(spark, n, places, sizes):
    """events at few places, at equal times among them, find the parents of a full search, and few rows are moved for it."""
    rng = np.random.default_rng(5)
    at, days = rng.integers(0, places, n), np.sort(rng.integers(0, 30 * 24, n)) / 24
    pdf = frame(rng.uniform(-46, -34, places)[at], rng.uniform(167, 178, places)[at], (T0 + days * DAY).astype("int64"), np.round(2 + rng.exponential(0.43, n), 1))
    df = spark.createDataFrame(pdf)
    before = shuffled_rows(spark)
    got = links.nearest_parents(df, **sizes).toPandas().set_index("row_idx").sort_index()
    moved = shuffled_rows(spark) - before
    p = geo.projected(df).toPandas().set_index("row_idx").loc[pdf.row_idx]
    order = np.lexsort((p.index, p.timeMs))
    t, x, y, m, ids = (c[order] for c in (p.timeMs.to_numpy(float), p.x_km.to_numpy(), p.y_km.to_numpy(), p.magnitude.to_numpy(), p.index.to_numpy()))
    for i in range(0, n, max(1, n // 1000)):
        eta = np.where(t < t[i], (t[i] - t) / DAY * np.maximum(np.hypot(x[i] - x, y[i] - y), links.R_FLOOR) ** 1.6 * 10.0**-m, np.inf)
        found = got.loc[ids[i]]
        if np.isfinite(eta.min()):
            assert found.log10_eta == pytest.approx(np.log10(eta.min()), abs=1e-9)
            assert found.parent in ids[eta <= eta.min() * (1 + 1e-12)]
        else:
            assert np.isnan(found.parent)
    assert sizes or moved <= 60 * n, moved / n


def test_import_parses_each_value_once(spark):
    """F18 to F23, F25: a filter by ``error`` does not parse again, so the plan has each date pattern once."""
    raw = spark.createDataFrame([(0, "a", "2024-01-02T03:04:05.678Z", "-41", "174", "5", "3")], "row_idx long, id string, time string, lat string, lon string, dep string, mag string")
    good, _ = validation.split_valid(validation.mapped(raw))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MM/dd/yyyy[ HH") == 1
    assert [(r.eventID, r.timeMs, r.latitude) for r in good.collect()] == [("a", 1_704_164_645_678, -41.0)]


def test_guards_of_date_patterns_drop_no_date(spark):
    """F18 to F23, F25: what a pattern's beginning keeps from the parser would not be parsed by it."""
    days = ["02/01/2024", "2/1/2024", "31/12/2024", "2024-01-02", "+2024-01-02", "-2024-01-02", "02-01-2024", "2024/01/02", "2024/1/2", "12024/01/02", "+12024-01-02", "02.01.2024"]
    texts = [d + end for d in days for end in ("", " 03:04:05", " 03:04:05.678", "T03:04:05", " ", "\n", "x")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, begins in scalar.DATE_PATTERNS.items():
        parsed = F.try_to_timestamp("t", F.lit(pattern + "[ HH:mm:ss[.SSS]]"))
        assert df.filter(parsed.isNotNull() & ~F.col("t").rlike(begins)).count() == 0
        assert df.filter(parsed.isNotNull()).count() > 0


def test_reasenberg_of_a_swarm(spark, monkeypatch):
    """the scan looks neighbours up; no table has the pairs of a swarm, also across 180 degrees."""
    pdf, kept = swarm(300), counting(monkeypatch)
    pdf["longitude"] = (pdf.longitude + 5.95 + 180) % 360 - 180
    assert labels(sequences.reasenberg(spark.createDataFrame(pdf)), 300) == naive.reasenberg(pdf)
    assert max(kept) <= 5 * 300


@pytest.mark.parametrize("block, most", [(7, 20), (50, 10_000), (400, 3_000_000)])
def test_later_pairs_in_parts(block, most):
    """parts of any size give the pairs of a full search, at the poles and across 0 and 180 degrees too."""
    rng = np.random.default_rng(8)
    n = 400
    lat, lon = np.concatenate([rng.uniform(-1, 1, 200), rng.uniform(89, 90, 200)]), np.concatenate([rng.choice([0.0, 180.0], 200) + rng.uniform(-1, 1, 200), rng.uniform(-180, 180, 200)])
    mixed = rng.permutation(n)
    lat, lon, reach, until = lat[mixed], lon[mixed], rng.uniform(1, 60, n), np.minimum(np.arange(n) + 150, n)
    lat[5], reach[9] = np.nan, np.nan
    later, start, got = sequences._later(lat, lon, reach, until), 0, []
    while start < n:
        a, b, km, start = later(start, block, most)
        got += list(zip(a.tolist(), b.tolist(), strict=True))
    phi, lam = np.radians(lat), np.radians(lon)
    h = np.sin((phi[:, None] - phi) / 2) ** 2 + np.cos(phi[:, None]) * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2
    near = 6371.0 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= reach[:, None]
    assert got == [(i, j) for i in range(n) for j in range(i + 1, until[i]) if near[i, j]]
