"""Operator 12, centroid clustering with Elkan's bounds.

Every vector keeps an upper bound of the distance to its centroid and a lower bound to
each centroid.  After centroids move, bounds are widened by how far they moved; a
centroid is skipped for a vector if a lower bound or half the distance between two
centroids says that it is strictly farther.  Bounds are rounded outwards and pruning is
strict, so ties are always looked at; what decides are exact integer distances.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import discard, materialize
from temblor.llm.topk_search import TOP, _matrix, usable

LIMB = 1 << 32
STATE = "id long, v array<double>, cluster int, upper double, lower array<float>, distance long, n_distances long"


def integers(v: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: longs if they are below 2**62, else Python's unbounded ones."""
    if np.abs(v).max(initial=0) < 2.0**62:
        return v.astype(np.int64)
    out = np.empty(v.shape, object)
    out.flat = [int(x) for x in v.ravel().tolist()]
    return out


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid; unbounded integers where a long might not hold them."""
    most = float(np.abs(v).max(initial=0)) + float(np.abs(c).max(initial=0))
    if most * most * v.shape[1] < 2**53:
        d = v - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    a, b = integers(v), integers(c)
    if most * most * v.shape[1] >= 2**63:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=1)


def root(d2: np.ndarray) -> np.ndarray:
    """Square roots as doubles, right to a few units of 2**-52; infinity beyond all doubles."""
    if d2.dtype != object:
        return np.sqrt(d2.astype(np.float64))
    return np.array([math.sqrt(x) if x < 2**1000 else float(math.isqrt(x)) if x < 2**2000 else math.inf for x in d2.tolist()])


def above(x: np.ndarray) -> np.ndarray:
    """An upper bound of a computed distance, safe against the rounding of a few operations."""
    return x * (1 + 1e-14) + 1e-300


def below(x: np.ndarray) -> np.ndarray:
    """A lower bound of a computed distance; one that is not finite bounds nothing."""
    return np.where(np.isfinite(x), np.maximum(x * (1 - 1e-14), 0.0), 0.0)


def narrow(x: np.ndarray) -> np.ndarray:
    """Doubles as floats that are not larger."""
    f = np.minimum(x, 3e38).astype(np.float32)
    return np.maximum(np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f), np.float32(0))


@dataclass(frozen=True)
class Centroids:
    """Whole centroids as doubles where exact, else objects; distances among them from below; moves from above and below."""

    at: np.ndarray
    apart: np.ndarray
    moved: np.ndarray


def centroids(rows: list[list[int]], before: list[list[int]] | None = None) -> Centroids:
    k, dim = len(rows), len(rows[0]) if rows else 0
    fits = all(abs(x) < 2**53 for r in rows for x in r)
    at = np.array(rows, np.float64 if fits else object).reshape(k, dim)
    apart = np.zeros((k, k))
    for i in range(k):
        apart[i] = below(root(np.array([sum((a - b) ** 2 for a, b in zip(rows[i], r, strict=True)) for r in rows], object)))
    far = np.zeros(k) if before is None else above(root(np.array([sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(rows, before, strict=True)], object)))
    far[[x == y for x, y in zip(rows, before or rows, strict=True)]] = 0.0
    return Centroids(at, apart, far)


def assign(v: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Nearest centroid of each row: (cluster, upper, lower, exact squared distance, distances computed).

    ``upper`` and ``lower`` hold for the centroids as they are now.  A centroid is left
    out only where a bound says that it is strictly farther than the row's own.
    """
    n, k = len(v), len(c.at)
    rows = np.arange(n)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    half = 0.5 * c.apart
    others = half + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
    nearest_other = others.min(axis=1, initial=np.inf)
    most = float(np.abs(v).max(initial=0)) + float(np.abs(c.at).max(initial=0))
    wide = most * most * c.at.shape[1] >= 2**63
    d2 = np.full(n, -1, object if wide else np.int64)
    looked = np.zeros(n, np.int64)

    def measure(at: np.ndarray, j: int) -> np.ndarray:
        looked[at] += 1
        d = squared(v[at], c.at[j])
        return d.astype(object) if wide else d

    def own(at: np.ndarray) -> None:
        """Exact distance to the own centroid of those rows that do not have it yet."""
        at = at[d2[at] < 0]
        for j in np.unique(cluster[at]).tolist():
            mine = at[cluster[at] == j]
            d2[mine] = measure(mine, j)
            r = root(d2[mine])
            upper[mine], lower[mine, j] = above(r), below(r)

    for j in range(k):
        live = np.flatnonzero((cluster != j) & ~(upper < nearest_other[cluster]) & ~(upper < lower[:, j]) & ~(upper < half[cluster, j]))
        if not len(live):
            continue
        own(live)
        live = live[~(upper[live] < lower[live, j]) & ~(upper[live] < half[cluster[live], j])]
        if not len(live):
            continue
        got = measure(live, j)
        r = root(got)
        lower[live, j] = below(r)
        better = (got < d2[live]) | ((got == d2[live]) & (j < cluster[live]))
        won = live[better]
        cluster[won], d2[won], upper[won] = j, got[better], above(r[better])
    return cluster, upper, lower, d2, looked, rows, own


def _step(table: DataFrame, c: Centroids, fresh: bool, last: bool, chunk: int) -> DataFrame:
    """One assignment of all vectors; the last one also gives everybody's exact distance."""
    shared = table.sparkSession.sparkContext.broadcast(c)  # k * dim and k * k numbers

    def run(batches):
        c = shared.value
        k, dim = c.at.shape
        for batch in batches:
            for first in range(0, batch.num_rows, chunk):
                part = batch.slice(first, chunk)
                n = part.num_rows
                v = _matrix(part.column(1), dim)
                if fresh:
                    cluster, upper, lower, seen = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
                else:
                    cluster = part.column(2).to_numpy().astype(np.int64)
                    upper = above(part.column(3).to_numpy() + c.moved[cluster])
                    lower = below(_matrix(part.column(4), k) - c.moved)
                    seen = part.column(6).to_numpy()
                cluster, upper, lower, d2, looked, rows, own = assign(v, c, cluster, upper, lower)
                if last:
                    own(rows)
                    d2 = np.array([min(TOP, x) for x in d2.tolist()], np.int64)
                    lower = np.zeros((n, 0))
                else:
                    d2 = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1) if not last else pa.nulls(n, part.column(1).type),
                        pa.array(cluster, pa.int32()),
                        pa.array(upper),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, max(1, lower.shape[1])) if lower.size else np.zeros(n + 1), pa.int32()), pa.array(narrow(lower).ravel(), pa.float32())),
                        pa.array(d2),
                        pa.array(seen + looked),
                    ],
                    names=["id", "v", "cluster", "upper", "lower", "distance", "n_distances"],
                )

    return table.mapInArrow(run, STATE)


def _sums(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, dict]:
    """Members of each cluster and exact sums of their components.

    A task adds up its own vectors exactly and tells every sum in limbs of 32 bits,
    which Spark adds without overflow; what arrives is bounded by ``k * dim`` sums.
    """

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        members = np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            v = _matrix(batch.column(1), dim)
            members += np.bincount(cluster, minlength=k)
            exact = np.abs(v).max(initial=0) * len(v) < 2.0**53
            for j in np.unique(cluster).tolist():
                mine = v[cluster == j]
                sums = mine.sum(axis=0).tolist() if exact else integers(mine).astype(object).sum(axis=0).tolist()
                for i, x in enumerate(sums):
                    total[j, i] = total.get((j, i), 0) + int(x)
        out = [(int(j), -1, 0, int(members[j])) for j in np.flatnonzero(members)]
        for (j, i), x in total.items():
            sign, x, limb = (-1 if x < 0 else 1), abs(x), 0
            while x:
                out.append((j, i, limb, sign * (x % LIMB)))
                x, limb = x // LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "part", "limb", "x"])

    got = table.select("cluster", "v").mapInArrow(run, "cluster int, part int, limb int, x long").groupBy("cluster", "part", "limb").agg(F.sum("x").alias("x")).collect()  # k * dim sums in limbs
    n, sums = np.zeros(k, np.int64), {}
    for r in got:
        if r.part < 0:
            n[r.cluster] = r.x
        else:
            sums[r.cluster, r.part] = sums.get((r.cluster, r.part), 0) + r.x * LIMB**r.limb
    return n, sums


def seeds(table: DataFrame, k: int, seed: str) -> list[list[int]]:
    """Components of the ``k`` vectors whose ``sha256(seed:id)`` is smallest; rows of one id by components, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = table.select("id", "v", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    return [[int(x) for x in r.v] for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = 4096) -> DataFrame:
    """Cluster, squared distance and centroid of every vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances``.

    Vectors with exactly ``dim`` components, none null or non-finite, are taken; their
    components become floor(scale * x), as integers of any size.  The first centroids
    are the ``k`` vectors with the smallest ``sha256(seed:id)``, or all if there are
    fewer.  Each of ``rounds`` rounds assigns (ties to the smaller number) and moves
    non-empty centroids to the componentwise floor of the mean; a last assignment
    follows.  Repeated ids are rows each, a null id is a row that seeds only after all
    others, other columns play no part, and an empty table gives an empty result.
    Distances and inertias beyond a long are given as its end.  ``n_distances`` tells
    how many of the ``(rounds + 1) * k`` distances of a vector were computed.
    """
    spark = vectors.sparkSession
    table = materialize(usable(vectors, id_col, vec_col, scale, null_ids=True).filter(F.col("dim") == dim).select("id", "v"), "vectors")
    rows = seeds(table, k, seed)
    if not rows:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long")
    now, fresh = centroids(rows), True
    for _ in range(rounds):
        nxt = materialize(_step(table, now, fresh, False, chunk), "state")
        discard(table)
        table, fresh = nxt, False
        n, sums = _sums(table, len(rows), dim)
        moved = [[sums.get((j, i), 0) // int(n[j]) for i in range(dim)] if n[j] else r for j, r in enumerate(rows)]
        now, still, rows = centroids(moved, rows), moved == rows, moved
        if still:  # the same centroids would give the same assignment for ever
            break
    final = materialize(_step(table, now, fresh, True, chunk).select("id", "cluster", "distance", "n_distances"), "clusters")
    discard(table)
    inside = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    held = {r.cluster: int(r.s) for r in inside.collect()}  # a row a centroid
    whole = min(TOP, sum(held.values()))
    told = [(j, min(TOP, s), whole, hashlib.sha256(",".join(map(str, rows[j])).encode()).hexdigest()) for j, s in sorted(held.items())]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
