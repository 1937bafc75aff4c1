"""Operator 12 against plain k-means over unbounded integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from temblor.llm import centroid_clustering

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster int, distance string, id bigint, v string"


def plain(rows, k, rounds, dim, scale=256):
    """(vec_id, cluster, distance), inertias and centroids by all distances."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    got = [(i, nearest(v)) for i, v in kept]
    inside = {}
    for _, (d, j) in got:
        inside[j] = inside.get(j, 0) + d
    top = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, min(top, d), min(top, inside[j]), min(top, sum(inside.values())), digest[j]) for i, (d, j) in got]


def check(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in rows], SCHEMA).repartition(3)
    out = centroid_clustering.cluster(df, k=k, rounds=rounds, dim=dim)
    key = lambda r: (r[0] is None, r)
    got = out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain(rows, k, rounds, dim), key=str)
    return out


def test_clusters_equal_plain_ones_with_ties_repeats_and_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(150)]
    rows += [(i, list(rows[i][1])) for i in range(20)]  # repeated rows
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(80)]  # a third of all rows at one place
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0]), (2003, [1.0, math.nan, 0.0]), (2004, [math.inf, 0.0, 0.0]), (2005, [1.0, 2.0]), (None, [0.1, 0.2, 0.3])]
    check(spark, rows, 7, 5, 3)


def test_bounds_skip_most_distances_and_lose_nothing(spark):
    r = np.random.default_rng(5)
    centres = r.normal(0, 4, (12, 8))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.2, 8)).tolist()) for i in range(400)]
    out = check(spark, rows, 12, 5, 8)
    assert out.agg({"n_distances": "avg"}).first()[0] < 0.6 * 6 * 12


def test_components_beyond_a_long(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([1.0, -1.0]) * 10 ** r.choice([0, 3, 7, 12, 20, 90, 200]) for _ in range(2)]) for i in range(60)]
    check(spark, rows, 6, 3, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [0.5, 0.25])], [(5, [0.5, 0.25])] * 3])
def test_few_or_no_vectors(spark, rows):
    check(spark, rows, 4, 2, 2)
