"""Operator 10, exact top-k search by distributed histogram selection.

For a block of queries every candidate is scored; tasks report, per query, how many
scores fall into each bin of the query's current interval, Spark adds the reports,
and the bin that holds the k-th highest score becomes the next interval until it is
one score wide.  A last pass keeps what lies at or above it, ties to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.llm.common import materialize, unused

TOP, BOTTOM = 2**63 - 1, -(2**63) + 1  # scores beyond a long count as these


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int, null_ids: bool = False, keep: str | None = None) -> DataFrame:
    """``id, dim, v``: vectors with integer components floor(scale * x), held as doubles; others take no part.

    Left out are null vectors, null ids (unless ``null_ids``), and vectors with a null or
    non-finite component (also one whose product with ``scale`` is beyond all doubles).
    ``keep`` names a further column to carry.
    """
    y = lambda c: c.cast("double") * F.lit(float(scale))
    kept = [keep] if keep else []
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"), F.size(vec_col).alias("dim"), *kept)
    fine = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(y(c)) < F.lit(float("inf"))))
    # From 2**52 on every double is a whole number, and beyond a long floor would not hold it.
    whole = F.transform("raw", lambda c: F.when(F.abs(y(c)) < F.lit(2.0**52), F.floor(y(c)).cast("double")).otherwise(y(c)))
    return raw.filter("raw is not null" if null_ids else "id is not null and raw is not null").filter(fine).select("id", "dim", whole.alias("v"), *kept)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products as longs, those beyond a long as its ends.

    By floating point where every partial sum fits 53 bits; else by long arithmetic,
    which is right modulo 2**64 and so wherever the sum of sizes is below 2**62; what
    is left goes through unbounded integers.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q @ v.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        wide = ~(np.abs(q) @ np.abs(v).T < 2.0**62)
    out = np.where(np.abs(q) < 2.0**62, q, 0).astype(np.int64) @ np.where(np.abs(v) < 2.0**62, v, 0).astype(np.int64).T
    exact: dict[int, list[int]] = {}
    for c in np.flatnonzero(wide.any(axis=0)).tolist():
        own = [int(x) for x in v[c].tolist()]
        for k in np.flatnonzero(wide[:, c]).tolist():
            if k not in exact:
                exact[k] = [int(x) for x in q[k].tolist()]
            out[k, c] = max(BOTTOM, min(TOP, sum(a * b for a, b in zip(exact[k], own, strict=True))))
    return out


def _own(q_rows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, candidate) of a query's own row."""
    order = np.argsort(q_rows, kind="stable")
    lo, hi = np.searchsorted(q_rows[order], rows, "left"), np.searchsorted(q_rows[order], rows, "right")
    cand = np.repeat(np.arange(len(rows)), hi - lo)
    rank = np.arange(len(cand)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    return order[lo[cand] + rank], cand


FOUND = "query long, query_id long, vec_id long, score long"


def _select(table: DataFrame, q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, bins: int, chunk: int) -> DataFrame:
    """The top k of one block of queries: rows (query, query_id, vec_id, score), at least those needed."""
    spark = table.sparkSession
    dim, n = q.shape[1], len(q_ids)
    own_dim = table.filter(F.col("dim") == dim).select("id", "v", "row")
    shared_q = spark.sparkContext.broadcast((q_rows, q_ids, q))  # a block: block_queries * dim numbers

    def blocks(batches):
        rows, _, v = shared_q.value
        for batch in batches:
            for first in range(0, batch.num_rows, chunk):
                part = batch.slice(first, chunk)
                c_ids = part.column(0).to_numpy()
                s = _scores(v, _matrix(part.column(1), dim))
                mask = np.ones(s.shape, bool)
                mask[_own(rows, part.column(2).to_numpy())] = False
                yield c_ids, s, mask

    # Cauchy-Schwarz bounds every score, so the first interval needs no pass over the scores.
    top = own_dim.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if top is None:
        return spark.createDataFrame([], FOUND)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.nan_to_num(np.ceil(top * np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)) + 1, nan=2.0**63, posinf=2.0**63)
    reach = [min(TOP, int(x)) for x in norms.tolist()]
    # The k-th score lies in [low, high]; these are whole numbers of any size until they are told to tasks.
    low, high = [-x for x in reach], list(reach)
    need = np.full(n, k, np.int64)  # how many of those in the interval still belong to the top k
    while True:
        width = [max(1, -(-(h - b + 1) // bins)) for b, h in zip(low, high, strict=True)]
        state = spark.sparkContext.broadcast((np.array(low, np.int64), np.array(width, np.uint64), np.array(high, np.int64)))

        def histogram(batches):
            lo, w, up = state.value
            total = np.zeros((n, bins), np.int64)
            for _, s, mask in blocks(batches):
                mask &= (s >= lo[:, None]) & (s <= up[:, None])
                qi, ci = np.nonzero(mask)
                b = ((s[qi, ci].view(np.uint64) - lo[qi].view(np.uint64)) // w[qi]).astype(np.int64)  # differences of longs fit unsigned ones
                total += np.bincount(qi * bins + b, minlength=n * bins).reshape(n, bins)
            # Below a task's own k-th score nothing can be in the top k: at most k bins a query are told.
            beyond = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            qi, b = np.nonzero((total > 0) & (beyond < k))
            yield pa.RecordBatch.from_pydict({"q": qi.astype(np.int64), "bin": b.astype(np.int64), "n": total[qi, b]})

        found = own_dim.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        ranked = found.withColumn("upto", F.sum("n").over(down)).withColumn("before", F.col("upto") - F.col("n"))
        needs = spark.createDataFrame(pa.table({"q": np.arange(n), "need": need}))
        hit = ranked.join(F.broadcast(needs), "q").filter("before < need and upto >= need").select("q", "bin", "before").toArrow()  # one row a query of the block
        qs, bin_, before = (hit[c].to_numpy() for c in ("q", "bin", "before"))
        need = need.copy()
        lost = set(range(n)).difference(qs.tolist())  # fewer than k candidates: everything belongs to the result
        for i, bin_no in zip(qs.tolist(), bin_.tolist(), strict=True):
            low[i] += bin_no * width[i]
            high[i] = min(high[i], low[i] + width[i] - 1)
        for i in lost:
            low[i] = high[i] = BOTTOM - 1
        need[qs] -= before
        if all(b == h for b, h in zip(low, high, strict=True)):
            break
    low = np.array(low, np.int64)
    state = spark.sparkContext.broadcast((low, need))

    def keep(batches):
        lo, still = state.value
        asked, ids, _ = shared_q.value
        ties: list[list] = [[] for _ in range(n)]
        for c_ids, s, mask in blocks(batches):
            qi, ci = np.nonzero(mask & (s > lo[:, None]))
            if len(qi):
                yield pa.RecordBatch.from_pydict({"query": asked[qi], "query_id": ids[qi], "vec_id": c_ids[ci], "score": s[qi, ci]})
            qi, ci = np.nonzero(mask & (s == lo[:, None]))
            for a, c in zip(qi.tolist(), c_ids[ci].tolist(), strict=True):
                ties[a].append(c)
                if len(ties[a]) > 4 * k + 64:
                    ties[a] = sorted(ties[a])[: still[a]]
        rows = [(asked[a], ids[a], c, lo[a]) for a in range(n) for c in sorted(ties[a])[: still[a]]]
        if rows:
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(("query", "query_id", "vec_id", "score"))})

    return own_dim.mapInArrow(keep, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = 4096, bins: int = 512, chunk: int = 2048) -> DataFrame:
    """Each query's k highest inner products over all vectors but its own row.

    ``queries`` is a condition that tells which of the vectors are asked, each row on its
    own: of rows that share an id every other one is a candidate.  Or it is a table of
    the same form as ``vectors``: then all rows of a query's id count as its own, and of
    query rows with one id the one with the smallest components, from the first on, is
    asked.  Returns ``query_id, rank, vec_id, score``: ranks from 1, ties to the smaller
    id, all candidates if there are fewer than k.  Only vectors of equal length are
    compared, those of length 0 with score 0.  Repeated candidate rows are candidates
    each.  Scores beyond a long count as its ends.  Queries are taken in blocks of
    ``block_queries`` in order of their rows, so what is broadcast is bounded; a block's
    scores exist only inside tasks, ``chunk`` candidates at a time, and all blocks write
    to one table.
    """
    spark = vectors.sparkSession
    if isinstance(queries, Column):
        name = unused(vectors, "is_query")
        all_rows = usable(vectors.withColumn(name, queries), id_col, vec_col, scale, keep=name)
        table = materialize(all_rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        asked = materialize(table.filter(name).select("row", "id", "dim", "v"), "queries")
    else:
        table = materialize(usable(vectors, id_col, vec_col, scale).withColumn("row", F.col("id")), "vectors")
        one = usable(queries, id_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m"))
        asked = materialize(one.select(F.col("id").alias("row"), "id", "m.dim", "m.v"), "queries")
    found = materialize(spark.createDataFrame([], FOUND), "found")
    dim = -1
    while (dim := asked.filter(F.col("dim") > dim).agg(F.min("dim")).first()[0]) is not None:  # a pass for each length of vectors
        rows = asked.filter(F.col("dim") == dim)
        after = None
        while True:
            block = (rows if after is None else rows.filter(F.col("row") > after)).orderBy("row").limit(block_queries).select("row", "id", "v").toArrow()
            if not block.num_rows:
                break
            q_rows = block["row"].to_numpy()
            after = int(q_rows[-1])
            _select(table, q_rows, block["id"].to_numpy(), _matrix(block["v"].combine_chunks(), dim), k, bins, chunk).write.mode("append").parquet(found.scratch_path)
            if block.num_rows < block_queries:
                break
    found = spark.read.schema(found.schema).parquet(found.scratch_path)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
