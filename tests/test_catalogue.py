"""Catalogue operators against plain restatements and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from temblor.functions import geo, scalar
from temblor.operators import aftershock_fits, aftershocks, clusters, components, declustering, density, filters, frequency, incremental, links, neighbours, sampling, sequences, statistics, validation
from temblor.sources import feed, readers, sinks
from tests import naive
from tests.fixtures import DAY, T0, frame, sequence_catalogue, three_nests, two_epochs


def labels(df, n):
    got = df.toPandas().set_index("row_idx")["cluster_id"]
    return [int(got[i]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 5])
@pytest.mark.parametrize("law, share", [("gk", 1.0), ("uhrhammer", 0.3)])
def test_window_declustering(spark, seed, law, share):
    pdf = sequence_catalogue(seed)
    cat = spark.createDataFrame(pdf)
    got = declustering.gardner_knopoff(cat, None, share) if law == "gk" else declustering.uhrhammer(cat, share)
    want, dependent = naive.window(pdf, getattr(naive, law), share)
    assert labels(got, len(pdf)) == want
    back = got.toPandas().set_index("row_idx")["dependent"]
    assert [bool(back[i]) for i in range(len(pdf))] == dependent


def test_larger_mainshock_is_taken_back(spark):
    pdf = frame([-41, -41.05], [174, 174.05], [T0, T0 + 900 * DAY], [6.5, 6.49])
    want, _ = naive.window(pdf, naive.gk, 1.0)
    assert labels(declustering.gardner_knopoff(spark.createDataFrame(pdf)), 2) == want


def test_hardebeck(spark):
    pdf = sequence_catalogue(7)
    assert labels(declustering.hardebeck(spark.createDataFrame(pdf), 3.0), len(pdf)) == naive.hardebeck(pdf, 3.0)


def test_dbscan_and_st_dbscan(spark):
    pdf = three_nests()
    cat = spark.createDataFrame(pdf)
    lat0, lon0 = pdf.latitude.mean(), pdf.longitude.mean()
    x, y = (pdf.longitude - lon0) * 111.32 * math.cos(math.radians(lat0)), (pdf.latitude - lat0) * 110.57
    near = lambda i: {j for j in range(len(pdf)) if j != i and math.hypot(x[i] - x[j], y[i] - y[j]) <= 6}
    got = labels(density.dbscan(cat, 6.0, 5), len(pdf))
    want = naive.density(len(pdf), near, 5)
    assert [g < 0 for g in got] == [w < 0 for w in want] and max(got) == max(want)
    three = labels(density.dbscan(cat, 25.0, 5), len(pdf))
    assert 2 <= max(three) + 1 <= 5 and -1 in three
    pdf = two_epochs()
    assert max(labels(density.st_dbscan(spark.createDataFrame(pdf), 25.0, 7.0, 5), 20)) == 1


def test_kmeans_takes_every_row(spark):
    got = density.kmeans(spark.createDataFrame(three_nests()), 3).toPandas()
    assert got.cluster_id.nunique() == 3 and len(got) == 170


@pytest.mark.parametrize("seed, mc, before, after", [(3, 2.0, 1, 30), (4, 2.3, 2, 4), (6, 2.2, 3, 1)])
def test_step_and_link_scans(spark, seed, mc, before, after):
    """Dense catalogues with repeated times and magnitudes, many exactly at the completeness."""
    pdf = sequence_catalogue(seed)
    cat = spark.createDataFrame(pdf)
    assert labels(sequences.step_magnitude(cat, mc, before, after), len(pdf)) == naive.step_magnitude(pdf, mc, before / 365, after / 365)
    assert labels(sequences.step_time(cat, mc, before, after), len(pdf)) == naive.step_time(pdf, mc, before / 365, after / 365)
    for rules in ({}, {"rfact": 60, "tau0": 0.3, "tau_max": 0.5, "tau_min": 0.1}, {"rfact": 3, "tau_max": 20, "xk": 0.1}):
        assert labels(sequences.reasenberg(cat, **rules), len(pdf)) == naive.reasenberg(pdf, **rules)


def test_scans_of_empty_and_single(spark):
    cat = spark.createDataFrame(sequence_catalogue(1))
    for f in (sequences.step_magnitude, sequences.step_time, sequences.reasenberg):
        assert f(cat.limit(0)).count() == 0
        one = f(cat.filter("row_idx = 3")).collect()
        assert [x.cluster_id for x in one] == [-1 if f is sequences.reasenberg else 0]


def test_nearest_links(spark):
    pdf = sequence_catalogue(13, 90)
    got = links.nearest_parents(spark.createDataFrame(pdf), block_rows=16).toPandas().set_index("row_idx")
    lat0, lon0 = pdf.latitude.mean(), pdf.longitude.mean()
    x, y = (pdf.longitude - lon0) * 111.32 * math.cos(math.radians(lat0)), (pdf.latitude - lat0) * 110.57
    order = list(pdf.sort_values(["timeMs", "row_idx"]).row_idx)
    for i in range(len(pdf)):
        best = None
        for j in order:
            days = (pdf.timeMs[i] - pdf.timeMs[j]) / DAY
            if days > 0:
                eta = days * max(math.hypot(x[i] - x[j], y[i] - y[j]), 0.001) ** 1.6 * 10 ** -pdf.magnitude[j]
                if best is None or eta < best[0] * (1 - 1e-12):
                    best = (eta, j)
        if best is None:
            assert pd.isna(got.parent[i])
        else:
            assert got.log10_eta[i] == pytest.approx(math.log10(best[0]), abs=1e-9)
    trees = links.nearest_neighbour_clusters(spark.createDataFrame(pdf)).toPandas()
    sizes = trees[trees.cluster_id >= 0].groupby("cluster_id").size()
    assert (sizes >= 2).all()


def test_otsu_fallback(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "log10_eta double")
    assert links.otsu_threshold(df).first().threshold == 1.0
    assert links.otsu_threshold(df.limit(0)).first().threshold is None


def test_frequency_recovers_b(spark):
    r = np.random.default_rng(4)
    n = 20_000
    pdf = frame(np.zeros(n), np.zeros(n), T0 + np.arange(n) * 1000, np.round(1.95 + r.exponential(1 / (1.0 * math.log(10)), n), 1))  # the half-bin shift of the estimate is made for rounded magnitudes
    row = frequency.fit(spark.createDataFrame(pdf), method="given", mc=2.0).first()
    assert row.b == pytest.approx(1.0, abs=0.03)
    assert frequency.fit(spark.createDataFrame(pdf).limit(1)).count() == 0


def test_decay_fits_recover_parameters(spark):
    r = np.random.default_rng(9)
    k, c, p, horizon = 100.0, 0.05, 1.1, 365.0
    u = r.uniform(0, 1, r.poisson(k * aftershock_fits.integral(0, horizon, c, p)))
    a, b = c ** (1 - p), (horizon + c) ** (1 - p)
    times = (a + u * (b - a)) ** (1 / (1 - p)) - c
    got = aftershock_fits.fit_one(times, horizon, "mle")
    assert got["p"] == pytest.approx(p, abs=0.12) and got["c"] == pytest.approx(c, abs=0.06)
    assert got["p_lo"] < got["p"] < got["p_hi"]
    cat = spark.createDataFrame(frame(np.zeros(len(times)), np.zeros(len(times)), T0 + times * DAY, np.full(len(times), 3.0)))
    seq = aftershocks.sequence(cat, T0)
    for row in aftershock_fits.fit(seq, list(aftershock_fits.METHODS)).collect():
        one = aftershock_fits.fit_one((T0 + times * DAY).astype("int64") / DAY - T0 / DAY, horizon, row.method)
        assert 0.5 < row.p < 1.8 and row.k > 0, row.method
        for name in ("k", "c", "p", "r2"):
            assert row[name] == pytest.approx(one[name], rel=1e-3), (row.method, name)
    assert aftershock_fits.bootstrap(seq, "grid", 4).count() == 4
    assert len(aftershocks.FIT_GRID) == 70 and len(aftershocks.PROFILE_GRID) == 130
    grid = aftershocks.grid_fit(aftershocks.daily_bins(seq)).first()
    one = aftershock_fits.fit_one(times, horizon, "grid")
    assert (grid.p, grid.c) == (one["p"], one["c"])


def test_log_sums_are_exact_between_their_nodes():
    r = np.random.default_rng(11)
    for times in (np.array([0.0011, 0.5, 300.0]), r.uniform(0.001, 0.02, 500), r.exponential(40, 3000) + 0.001):
        sums = aftershock_fits.sums_of(times, 365.0)
        for c in (0.0051, 0.0123, 0.1, 0.77, 1.9, 4.99):
            assert float(sums.log_sum(c)) == pytest.approx(np.log(times + c).sum(), rel=1e-11, abs=1e-9)
            direct = len(times) * math.log(30) - 1.07 * np.log(times + c).sum() - 30 * aftershock_fits.integral(0.001, 365.0, c, 1.07)
            assert aftershock_fits.log_likelihood(sums, 365.0, np.array([30, c, 1.07])) == pytest.approx(direct, rel=1e-10)


def test_several_mainshocks_are_fitted_at_once(spark):
    r = np.random.default_rng(12)
    rows = [(main, float(t)) for main, n in ((1, 60), (2, 400), (3, 4)) for t in r.exponential(8, n) + 0.002]
    seq = spark.createDataFrame(rows, "main bigint, days double").withColumn("row_idx", F.monotonically_increasing_id())
    got = {(x.main, x.method): x for x in aftershock_fits.fit(seq, ["mle", "mle_em", "hybrid"], 100).collect()}
    assert {m for m, _ in got} == {1, 2}
    for (main, method), x in got.items():
        one = aftershock_fits.fit_one(np.array([t for m, t in rows if m == main]), 100, method)
        assert (x.k, x.c, x.p) == pytest.approx((one["k"], one["c"], one["p"]), rel=1e-6)
        if method == "mle_em":
            assert 0.7 <= x.p <= 1.6 and 0.01 <= x.c <= 2


def test_too_small_sequences_give_no_row(spark):
    seq = aftershocks.sequence(spark.createDataFrame(sequence_catalogue(1, 5)), T0 - DAY)
    assert aftershock_fits.fit(seq).count() == 0


def test_stratified_sample(spark):
    r = np.random.default_rng(6)
    n = 5000
    mag = np.where(r.uniform(0, 1, n) < 0.8, 3 + r.uniform(0, 2, n), 6 + r.uniform(0, 2, n))
    cat = spark.createDataFrame(frame(np.zeros(n), np.zeros(n), T0 + np.arange(n) * DAY, mag))
    got = sampling.stratified(cat, 500).toPandas()
    assert len(got) == 500 and abs((got.magnitude < 5).mean() - (mag < 5).mean()) < 0.05
    assert sampling.stratified(cat, 9000).count() == n and sampling.stratified(cat, 0).count() == 0
    assert sampling.uniform(cat, 70, 1).count() == 70


def test_polygons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (5.0, 15.0)], "longitude double, latitude double")
    assert [r[0] for r in df.select(geo.in_polygon(square)).collect()] == [True, False, False]
    wide = [(179, -1), (181, -1), (181, 1), (179, 1)]
    df = spark.createDataFrame([(179.9, 0.0), (-179.9, 0.0), (170.0, 0.0)], "longitude double, latitude double")
    assert [r[0] for r in df.select(geo.in_polygon(wide)).collect()] == [True, True, False]
    assert len(geo.parse_polygon("POLYGON((30 10, 40 40, 20 40, 10 20, 30 10))")) == 5
    assert geo.parse_polygon("# box\n30 10\n40 40\n20 40")[0] == (30.0, 10.0)
    for bad in ("POLYGON(INVALID)", "30 10\nINVALID 40\n1 1", "30 95\n1 1\n2 2", "1 1\n2 2"):
        with pytest.raises(ValueError):
            geo.parse_polygon(bad)


def test_parsing_functions(spark):
    df = spark.createDataFrame([("41°17'10.5\"S",), ("41 17.5 S",), ("-41.5",), ("12.5abc",), ("x",)], "s string")
    got = [r[0] for r in df.select(scalar.dms_degrees(F.col("s"))).collect()]
    assert got[0] == pytest.approx(-(41 + 17 / 60 + 10.5 / 3600)) and got[1] == pytest.approx(-(41 + 17.5 / 60)) and got[2] == -41.5 and got[3] == 12.5 and got[4] is None
    times = [("13/02/2024 10:20:30", "2024-02-13 10:20:30"), ("02/13/2024", "2024-02-13 00:00:00"), ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"), ("1700000000", "2023-11-14 22:13:20"), ("1700000000000", "2023-11-14 22:13:20"), ("nonsense", None)]
    df = spark.createDataFrame([(t,) for t, _ in times], "s string")
    assert [r[0] for r in df.select(F.date_format(scalar.parse_time(F.col("s")), "yyyy-MM-dd HH:mm:ss")).collect()] == [w for _, w in times]
    df = spark.createDataFrame([("31/02/24",)], "s string")
    assert df.select(F.date_format(scalar.parse_time(F.col("s"), "dd/mm/yyyy"), "yyyy-MM-dd")).first()[0] == "2024-03-02"
    df = spark.createDataFrame([("-9", "nan", "3.5")], "a string, b string, c string")
    assert df.select(scalar.first_valid_number(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 3.5


def test_import_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# note\ntime,latitude,longitude,depth,magnitude,eventID,place\n2024-01-01 00:00:00,-41,174,10,4.5,a,"x, ""y"""\nbad,-41,174,10,4,b,z\n2024-01-02 00:00:00,-95,174,10,4,c,z\n2024-01-03 00:00:00,-41,174,10,big,d,z\n')
    raw = readers.read(spark, str(tmp_path / "a.csv"))
    checked = validation.mapped(raw, now_ms=T0 + 400 * DAY)
    errors = {r.eventID: r.error for r in checked.collect()}
    assert errors == {"a": None, "b": "invalid time", "c": "latitude out of range", "d": "invalid magnitude"}
    assert checked.filter("eventID = 'a'").first().locality == 'x, "y"'
    stats = validation.import_statistics(checked).first()
    assert (stats.total, stats.valid, stats.invalid, stats.success_rate) == (4, 1, 3, 25.0) and len(stats.samples) == 3
    good, bad = validation.split_valid(checked)
    assert good.count() == 1 and bad.count() == 3
    with pytest.raises(Exception, match="invalid time"):
        validation.split_valid(checked, fail_fast=True)[0].collect()
    (tmp_path / "b.dat").write_text("time latitude longitude\n2024-01-01T00:00:00 1 2\n2024-01-02T00:00:00 3 4\n")
    assert readers.read(spark, str(tmp_path / "b.dat")).count() == 2
    (tmp_path / "c.txt").write_text("a\tb\n1\t2\n3\t4\n")
    assert readers.preview(spark, str(tmp_path / "c.txt"))["rows"][1]["b"] == "4"
    (tmp_path / "d.json").write_text('[{"time": "2024-01-01", "latitude": -41.5, "depth": 1, "tags": [1]}, {"time": "2024-01-02", "latitude": 1, "depth": 2, "tags": []}]')
    assert readers.read(spark, str(tmp_path / "d.json")).orderBy("row_idx").first().latitude == "-41.5"
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[174.5,-41.5,12.0]},"properties":{"publicid":"p1","magnitude":4.1}}]}')
    row = readers.read(spark, str(tmp_path / "e.geojson")).first()
    assert (row.longitude, row.latitude, row.depth, row.publicid) == ("174.5", "-41.5", "12.0", "p1")
    (tmp_path / "f.qml").write_text('<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2"><eventParameters><event publicID="smi:x/e7"><preferredOriginID>o2</preferredOriginID><origin publicID="o1"><time><value>2024-01-01T00:00:00Z</value></time><latitude><value>1</value></latitude><longitude><value>2</value></longitude></origin><origin publicID="o2"><time><value>2024-01-02T00:00:00Z</value></time><latitude><value>-41</value></latitude><longitude><value>174</value></longitude><depth><value>12000</value></depth></origin><magnitude publicID="m"><mag><value>4.4</value></mag></magnitude><description><type>region name</type><text>Here</text></description></event></eventParameters></q:quakeml>')
    row = readers.read(spark, str(tmp_path / "f.qml")).first()
    assert (row.eventID, row.latitude, row.depth, row.magnitude, row.locality) == ("e7", "-41", "12.0", "4.4", "Here")
    assert readers.format_of("x.bin") is None


def test_split_dates_and_mapping(spark):
    raw = spark.createDataFrame([(0, "2024", "3", "5", "6", "7", "8.5", "-41", "174", "5", "4")], "row_idx bigint, year string, month string, day string, hour string, min string, sec string, lat string, lon string, depth string, mag string")
    row = validation.mapped(raw).first()
    assert row.time.isoformat() == "2024-03-05T06:07:08.500000" and row.error is None and row.eventID == "csv_0"
    assert validation.suggest_mapping(["Lat", "LON ", "mag", "ml"]) == {"Lat": "latitude", "LON ": "longitude", "mag": "magnitude"}
    assert validation.missing_fields({"a": "latitude"}, {"year": "y"}) == ["longitude", "depth", "magnitude"]


def test_feed_pages():
    from datetime import datetime, timezone

    at = lambda *a: datetime(*a, tzinfo=timezone.utc)
    chunks = feed.month_chunks(at(2024, 1, 15), at(2024, 3, 1))
    assert chunks == [(at(2024, 1, 15), at(2024, 2, 15)), (at(2024, 2, 15), at(2024, 3, 1))]
    calls = []

    def fetch(a, b):
        calls.append((a, b))
        days = (b - a).days
        return {"features": [{"properties": {"publicid": str(a)}} for _ in range(max(1, min(days, 5)))]}

    got = list(feed.features(fetch, at(2024, 1, 1), at(2024, 1, 9), full=5))
    assert len(calls) > 1 and all(i is None for _, i in got)
    assert [i for _, i in feed.features(lambda a, b: {"features": [{}] * 9}, at(2024, 1, 1), at(2024, 1, 2), full=5)][0] == "truncated"


def test_exports_and_store(spark, tmp_path):
    cat = spark.createDataFrame(sequence_catalogue(1, 20))
    sinks.write_bundle(cat, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/csv")).collect()]
    assert sum(x != sinks.HEADER for x in lines) == 20 and sinks.HEADER in lines
    assert readers.read(spark, str(tmp_path / "out/csv"), "delimited").count() == 20
    assert "-10.0" in spark.read.text(str(tmp_path / "out/geojson")).first().value
    sinks.store(cat, str(tmp_path / "store"), 3.0)
    assert sinks.stored(spark, str(tmp_path / "store"), 3.0).count() == 20
    labelled = clusters.with_sizes(cat.withColumn("cluster_id", (F.col("row_idx") % 3 - 1).cast("int")))
    sinks.write_analysis(labelled, str(tmp_path / "analysis.csv"), {"algorithm": "x"})
    assert readers.read(spark, str(tmp_path / "analysis.csv")).count() == 20
    assert sinks.analysis_json(labelled, clusters.result_summary(labelled), {"a": "b"}).count() == 21
    assert clusters.declustered_catalogue(cat, labelled.select("row_idx", "cluster_id")).count() > 0


def test_streaming_refresh(spark, tmp_path):
    from temblor.streaming.refresh import append_unseen, windowed_counts

    rows = [("a", 1, 3.0), ("b", 1, 4.0), ("a", 2, 3.5)]
    src = spark.createDataFrame(rows, "eventID string, modificationTime long, magnitude double")
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
        append_unseen(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
        src.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.eventID: r.magnitude for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {"a": 3.5, "b": 4.0}
    batch = spark.createDataFrame([("2024-01-01 01:00:00", 3.0), ("2024-01-01 02:00:00", 5.0)], "t string, magnitude double").withColumn("time", F.to_timestamp("t"))
    assert windowed_counts(batch).first().max_magnitude == 5.0


def test_filters_and_reports(spark):
    cat = spark.createDataFrame(three_nests())
    assert filters.apply(cat, filters.CatalogueFilter(min_magnitude=4.0)).count() < 170
    assert filters.without_noise(cat.withColumn("cluster_id", F.lit(None).cast("int"))).count() == 0
    assert filters.enriched(cat).filter("locality = 'Unknown Location'").count() == 0
    assert statistics.inter_event_stats(cat.limit(1)).count() == 0
    assert incremental.missing_interval(cat.limit(0), 5).first().end_ms is None
    assert validation.quality_errors(cat.limit(0)) == ["no events"]


def test_ranges_equal_plain_sums(spark):
    rng = np.random.default_rng(4)
    n = 700
    pdf = pd.DataFrame({"row_idx": range(n), "timeMs": T0 + rng.integers(0, 300, n) * 1000, "grp": np.where(rng.random(n) < 0.8, "hot", None), "v": rng.integers(0, 40, n) / 4})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None, ["v"])

    ordered = pdf.sort_values(["timeMs", "row_idx"])
    got = statistics.ordered_gaps(df).toPandas().set_index("row_idx")["gap_ms"]
    assert got[ordered.row_idx].fillna(-1).tolist() == ordered.timeMs.diff().fillna(-1).tolist()
    got = statistics.ordered_gaps(df, ["grp"]).toPandas().set_index("row_idx")["gap_ms"]
    assert got[ordered.row_idx].fillna(-1).tolist() == ordered.groupby("grp", dropna=False).timeMs.diff().fillna(-1).tolist()

    points = [0, 0.1, 1 / 3, 0.5, 0.97, 1]
    assert statistics.quantiles(df, points) == pytest.approx(pdf.v.quantile(points).tolist())
    assert statistics.quantiles(df.limit(0), points) == []

    got = {r.grp: r for r in statistics.nearest_rank_stats(df, "v", "grp").collect()}
    for name, part in pdf.groupby("grp", dropna=False):
        row, v = got[name if isinstance(name, str) else None], sorted(part.v.dropna())
        assert row.n == len(part) and row.mean == pytest.approx(part.v.mean())
        assert [row.p50, row.p95, row.p99] == [v[math.ceil(p * len(v)) - 1] for p in (0.5, 0.95, 0.99)]
    assert statistics.nearest_rank_stats(df.limit(0), "v", "grp").count() == 0


def test_time_bounds_reach_another_column(spark):
    pdf = three_nests()
    cat = spark.createDataFrame(pdf).withColumn("time", F.timestamp_millis("timeMs"))
    low, high = (pd.Timestamp(int(x), unit="ms").isoformat() for x in pdf.timeMs.quantile([0.2, 0.7], interpolation="lower"))
    rule = filters.CatalogueFilter(start=low, end=high, whole_end_day=False)
    kept = {r.row_idx for r in filters.apply(cat, rule).collect()}
    assert kept and kept == {r.row_idx for r in filters.apply(cat, rule, "time").collect()}


@pytest.mark.parametrize("local", [0, 5, 300_000])
def test_components_and_roots_in_rounds_or_in_one_task(spark, local):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 90, (70, 2))] + [(i, i + 1) for i in range(200, 260)]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(edges, "a bigint, b bigint"), local=local).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)} | {i: c for i, c in got.items() if i not in top}
    links = [(i, i // 2) for i in range(2, 120)] + [(500, 400)]
    roots = {x.node: x.root for x in components.forest_roots(spark.createDataFrame(links, "child bigint, parent bigint"), local=local).collect()}
    assert roots == {**{i: 1 for i in range(1, 120)}, 400: 400, 500: 400}


def test_full_cells_are_cut_and_lose_no_pair(spark, monkeypatch):
    r = np.random.default_rng(5)
    n = 160
    points = np.concatenate([r.uniform(0, 0.9, (n // 2, 2)), r.uniform(-6, 6, (n // 2, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "row_idx bigint, x_km double, y_km double")
    d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    want = {(i, j) for i in range(n) for j in range(n) if i != j and d[i, j] <= 1.0}
    cut = neighbours.shared_cells
    monkeypatch.setattr(neighbours, "shared_cells", lambda *a: cut(*a, most=7))
    got = [(x.a, x.b) for x in neighbours.planar_pairs(df, 1.0).collect()]
    assert len(got) == len(want) and set(got) == want


def test_gaps_of_groups_across_ranges(spark):
    r = np.random.default_rng(8)
    rows = [(i, int(t), None if k == 3 else f"g{k}") for i, (t, k) in enumerate(zip(r.integers(0, 500, 200), r.integers(0, 4, 200), strict=True))]
    df = spark.createDataFrame(rows, "row_idx bigint, timeMs bigint, grp string").repartition(3)
    for by in (None, ["grp"]):
        want, last = {}, {}
        for i, t, k in sorted(rows, key=lambda x: (x[1], x[0])):
            k = k if by else 0
            want[i] = t - last[k] if k in last else None
            last[k] = t
        assert {x.row_idx: x.gap_ms for x in statistics.ordered_gaps(df, by).collect()} == want


def test_cards_of_all_layouts(spark, tmp_path):
    lines = {
        "hypoinverse": "89101800041530" + "37S 220" + "122E 330" + " 123435" + " " * 31 + "0  37" + " " * 6 + "q",
        "hypo71": "891018 0004 15.30 37S 2.20 122E 3.30  12.34   3.50" + " " * 18 + " 1.2  3.4 A",
    }
    for layout, line in lines.items():
        path = str(tmp_path / f"{layout}.txt")
        spark.createDataFrame([(line,), ("not a card",)], "value string").coalesce(1).write.text(path)
        got, bad = readers.cards(spark, path, layout).orderBy("row_idx").collect()
        assert (got.year, got.month, got.day, got.hour, got.minute, got.second) == (1989, 10, 18, 0, 4, 15.3)
        assert got.latitude == pytest.approx(-(37 + 2.2 / 60)) and got.longitude == pytest.approx(122 + 3.3 / 60)
        assert (got.depth, got.magnitude) == (12.34, 3.5)
        assert bad.year is None
    kept, counts = readers.admitted(readers.cards(spark, str(tmp_path / "hypo71.txt"), "hypo71"), 3.0, 1980, 1990, "remark")
    assert kept.count() == 1 and counts.first().below_magnitude == 1


def test_values_keep_their_own_kind(spark):
    rows = spark.createDataFrame([("12",), (" -1.5e2 ",), ("0x1F",), ("abc",), ("",), ("1d",), ("Infinity",), (None,)], "note string")
    got = [r.t for r in validation.per_value(rows, ["note"]).selectExpr("schema_of_variant(note) as t").collect()]
    assert got == ["DOUBLE", "DOUBLE", "DOUBLE", "STRING", "STRING", "STRING", "DOUBLE", None]


def test_ellipsoid_distance(spark):
    def direct(a, b, c, d):
        x, y = (1.570796 - math.atan(0.993231 * math.tan(v * 1.745329e-02)) for v in (a, c))
        angle = math.acos(math.sin(x) * math.sin(y) * math.cos((d - b) * 1.745329e-02) + math.cos(x) * math.cos(y))
        return angle * 6371.227 * (1 + 3.37853e-3 * (1 / 3 - math.cos(1.570796 - (a + c) * 1.745329e-02 / 2) ** 2))

    r = np.random.default_rng(4)
    rows = [tuple(map(float, x)) for x in np.column_stack([r.uniform(-80, 80, 50), r.uniform(-180, 180, 50), r.uniform(-80, 80, 50), r.uniform(-180, 180, 50)])]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.ellipsoid_km(*map(F.col, "abcd")).alias("km")).collect()
    assert [x.km for x in got] == pytest.approx([direct(*x) for x in rows], abs=1e-6)
    assert spark.range(1).select(geo.ellipsoid_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("km")).first().km == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_density_clusters_without_pairs_of_dense_places(spark, monkeypatch, seed):
    """Dense nests, thin places and a ladder of rows exactly eps apart, with no table of pairs."""
    r = np.random.default_rng(seed)
    monkeypatch.setattr(density, "labels_from_pairs", None)
    lat = np.concatenate([-41 + r.normal(0, 0.004, 60), -41.1 + r.normal(0, 0.1, 160), -40.5 + np.arange(8) * 0.045])
    lon = np.concatenate([174 + r.normal(0, 0.004, 60), 174.1 + r.normal(0, 0.15, 160), np.full(8, 173.0)])
    pdf = frame(lat, lon, T0 + r.integers(0, 40, 228) * DAY, np.full(228, 3.0))
    cat = spark.createDataFrame(pdf)
    lat0, lon0 = pdf.latitude.mean(), pdf.longitude.mean()
    x, y = (lon - lon0) * 111.32 * math.cos(math.radians(lat0)), (lat - lat0) * 110.57
    for eps, least in ((5.0, 5), (3.0, 3)):
        planar = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= eps
        timed = (np.abs(pdf.timeMs.to_numpy()[:, None] - pdf.timeMs.to_numpy()) <= 7 * DAY) & (np.abs(x[:, None] - x) <= 1.15 * eps) & (np.abs(y[:, None] - y) <= 1.15 * eps)
        timed &= np.array([geo.haversine_arrays(a, b, lat, lon) for a, b in zip(lat, lon, strict=True)]) <= eps
        for near, found in ((planar, density.dbscan(cat, eps, least)), (timed, density.st_dbscan(cat, eps, 7.0, least))):
            core = near.sum(1) >= least
            top = np.arange(228)
            for _ in range(228):
                top = np.where(core, np.where(near & core, top, 999).min(1), 999)
            number = {c: i for i, c in enumerate(sorted(set(top[core])))}
            want = [number[top[i]] if core[i] else min((number[top[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(228)]
            got = found.toPandas().sort_values("row_idx")
            assert list(got.cluster_id) == want and list(got.core) == list(core) and core.any()


def test_suppression_in_batches_and_pairs_from_either_side(spark):
    pdf = sequence_catalogue(11, 90)
    cat = spark.createDataFrame(pdf)
    mains = cat.withColumn("radius_km", 5 * geo.rupture_length_km(F.col("magnitude"))).withColumn("before_ms", F.lit(0)).withColumn("after_ms", F.lit(20 * DAY))
    pairs = [{(x.main, x.dep) for x in neighbours.window_pairs(mains, cat, few_events=few).collect()} for few in (False, True)]
    assert pairs[0] == pairs[1] and pairs[0]
    ev = {r.row_idx: r for r in pdf.itertuples()}
    want = {j for i, j in pairs[0] if ev[i].magnitude > ev[j].magnitude and (ev[i].timeMs < ev[j].timeMs or (ev[i].timeMs == ev[j].timeMs and i < j))}
    assert {x.row_idx for x in declustering._suppressed(cat, 20, True, first=5, growth=3).collect()} == want


def test_core_distances_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(density, "planar_pairs", None)
    pdf = three_nests()
    lat0, lon0 = pdf.latitude.mean(), pdf.longitude.mean()
    x, y = ((pdf.longitude - lon0) * 111.32 * math.cos(math.radians(lat0))).to_numpy(), ((pdf.latitude - lat0) * 110.57).to_numpy()
    want = np.sort(np.hypot(x[:, None] - x, y[:, None] - y), axis=1)[:, 4]
    got = density.optics_core_distances(spark.createDataFrame(pdf), 6.0, 5).toPandas().sort_values("row_idx").core_km.to_numpy()
    assert got == pytest.approx(np.where(want <= 6, want, np.nan), abs=1e-9, nan_ok=True) and np.isnan(got).any()
