"""Spanning tree, HDBSCAN and reachability order against restatements over all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from temblor.functions.geo import haversine_arrays
from temblor.operators import density, hierarchy, spanning
from tests import naive
from tests.fixtures import DAY, T0, frame, three_nests


def distances(pdf: pd.DataFrame) -> np.ndarray:
    lat, lon = pdf.latitude.to_numpy(), pdf.longitude.to_numpy()
    return np.array([haversine_arrays(lat[i], lon[i], lat, lon) for i in range(len(pdf))])


def swarm(seed: int, n: int = 160) -> pd.DataFrame:
    """Nests of very different density, a row far away, rows on both sides of the date line, and repeated positions."""
    r = np.random.default_rng(seed)
    k = n // 4
    lat = np.concatenate([-41 + r.normal(0, 0.001, k), -41 + r.normal(0, 0.3, k), -38 + r.normal(0, 0.05, k), -40 + r.uniform(-5, 5, n - 3 * k)])
    lon = np.concatenate([174 + r.normal(0, 0.001, k), 174 + r.normal(0, 0.3, k), 179.99 + r.normal(0, 0.05, k), 172 + r.uniform(-5, 5, n - 3 * k)])
    lat[-1], lon[-1] = 60.0, -20.0
    lat[5:13], lon[5:13] = lat[5], lon[5]
    lat[100:102], lon[100:102] = lat[100], lon[100]
    lon = np.where(lon > 180, lon - 360, lon)
    turn = r.permutation(n)
    return frame(lat[turn], lon[turn], T0 + np.arange(n) * DAY, np.full(n, 3.0))


@pytest.mark.parametrize(("seed", "local_edges", "k"), [(1, 100_000, 5), (2, 20, 5), (3, 0, 3)])
def test_tree_is_the_lightest_one(spark, seed, local_edges, k):
    pdf = swarm(seed)
    tree, cores = spanning.spanning_tree(spark.createDataFrame(pdf), k, local_edges=local_edges)
    core, edges = naive.spanning_edges(distances(pdf), k)
    got = cores.toPandas().sort_values("row_idx")
    assert got.core.to_numpy() == pytest.approx(core, abs=1e-9)
    w = sorted(r.w for r in tree.collect())
    assert w == pytest.approx(sorted(e[0] for e in edges), abs=1e-9)


@pytest.mark.parametrize(("seed", "local_edges", "run"), [(1, 100_000, 200_000), (4, 25, 3)])
def test_merges_and_labels(spark, seed, local_edges, run):
    pdf = swarm(seed)
    # Repeated positions tie at every distance; without them the order of equal weights matters less.
    pdf = pdf.drop_duplicates(["latitude", "longitude"]).reset_index(drop=True).assign(row_idx=lambda x: range(len(x)))
    labels, strength, outlier = naive.hdbscan(distances(pdf))
    got = hierarchy.hdbscan(spark.createDataFrame(pdf), local_edges=local_edges, run=run).toPandas().sort_values("row_idx")
    assert list(got.cluster_id) == list(labels)
    assert got.probability.to_numpy() == pytest.approx(strength, abs=1e-9)
    assert got.outlier_score.to_numpy() == pytest.approx(outlier, abs=1e-9)
    assert labels.max() >= 2


def test_nests_are_found_and_odd_rows_have_a_place(spark):
    pdf = three_nests()
    pdf.loc[3, "latitude"] = np.nan
    cat = spark.createDataFrame(pdf).selectExpr("* except (latitude)", "nanvl(latitude, null) as latitude")
    got = hierarchy.hdbscan(cat).toPandas().sort_values("row_idx")
    assert len(got) == 170 and got.cluster_id.nunique() >= 3
    assert tuple(got.iloc[3][["cluster_id", "probability", "outlier_score"]]) == (-1, 0, 1)
    one = cat.filter("row_idx = 7")
    assert [tuple(r) for r in hierarchy.hdbscan(one).collect()] == [(7, 0, 1.0, 0.0)]
    assert hierarchy.hdbscan(cat.limit(0)).collect() == []
    same = spark.createDataFrame(frame(np.full(9, -41.0), np.full(9, 174.0), T0 + np.arange(9), np.full(9, 3.0)))
    assert {(r.cluster_id, r.probability) for r in hierarchy.hdbscan(same).collect()} == {(0, 1.0)}


@pytest.mark.parametrize("local_edges", [100_000, 30])
def test_reachability_order_cut_gives_density_clusters(spark, local_edges):
    cat = spark.createDataFrame(swarm(6)).filter("latitude < 0")
    n = cat.count()
    order = hierarchy.reachability_order(cat, 60.0, 5, local_edges=local_edges).cache()
    assert sorted(r.position for r in order.collect()) == list(range(n))
    for radius in (5.0, 30.0, 60.0):
        cores = density.dbscan(cat, radius, 5).filter("core").toPandas()
        got = hierarchy.cut(order, radius).filter("first_row is not null").toPandas()
        assert set(got.row_idx) == set(cores.row_idx)
        both = got.merge(cores, on="row_idx")
        first = both.groupby("cluster_id").row_idx.min()
        assert (both.first_row == both.cluster_id.map(first)).all()


def test_merges_in_many_ranges_equal_those_of_one(spark):
    r = np.random.default_rng(1)
    tree = spark.createDataFrame([(float(r.random()), int(r.integers(0, i)), i) for i in range(1, 200)], "w double, a bigint, b bigint")
    want = sorted(tuple(x) for x in spanning.merges(tree, 1000).collect())
    assert len(want) == 199 and max(x[4] + x[5] for x in want) == 200
    assert sorted(tuple(x) for x in spanning.merges(tree, 12).collect()) == want
