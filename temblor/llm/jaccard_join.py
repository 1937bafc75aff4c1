"""Operator 6, n-gram Jaccard join by multiple-global-order filtering.

A document is its set of word n-grams, as 64-bit hashes.  Two sets of Jaccard
similarity t or more share a token among the first |x| - ceil(t|x|) + 1 tokens of each
under every global token order, and l tokens or more among the first |x| - ceil(t|x|) + l.
Order 1 (rare tokens first) drives an equi-join on prefix tokens; under orders 2 and 3
(two other hashes) a pair must also share enough tokens of such longer prefixes before
its texts are compared exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.llm.common import connected_components, discard, materialize, mix64, prefix_hash, small_batches, span_hash, text_slices

LONG_WORD = 128  # bytes
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """n words a shingle; similarity at least num / den; share of tokens that order 1 counts."""

    n: int = 5
    num: int = 80
    den: int = 100

    @property
    def counted(self) -> float:
        return min(1.0, 1.2 * (1 - self.num / self.den))

    def prefix(self, size):
        return size - -(-(size * self.num) // self.den) + 1

    def depth(self, size):
        """How many common tokens orders 2 and 3 ask for: as many again as the prefix has."""
        return self.prefix(size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashed n-grams of each text; with fewer words, of the whole sequence; empty without words."""
    data = _lower[data]
    blank = _space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    starts = np.flatnonzero(~blank & (before | first[:-1]))
    ends = np.flatnonzero(~blank & (after | first[1:])) + 1
    words = span_hash(prefix_hash(data), starts, ends)
    # Powers modulo 2**64 can't tell some long words apart.
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.searchsorted(starts, offsets)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mix64(grams ^ words[k : k + len(grams)], 11 + k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mix64(h ^ words[k], 100 + int(k - a))
            out.append(mix64(h, 200))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set, as two signed longs."""
    a, b = mix64(tokens, 71).sum(dtype=np.uint64), mix64(tokens, 73).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per document: n, set signature, counted tokens of order 1, longer prefixes of orders 2 and 3.

    Order 1 puts the tokens whose hash is below a fixed share first, by their document
    frequency, then all others by hash.  ``tokens`` has the ``heads`` former by hash and
    behind them those of the latter kind that still belong to the prefix.
    """
    limit = np.uint64(int(rule.counted * (2**64 - 1)))

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in text_slices(batch.column(1), 500_000):
                rows: dict[str, list] = {k: [] for k in ("n", "s1", "s2", "heads", "tokens", "o2", "o3", "l2", "l3")}
                for tokens in shingle_sets(data, offsets, rule.n):
                    s1, s2 = signature(tokens)
                    size = len(tokens)
                    p = rule.prefix(size) if size else 0
                    cut = int(np.searchsorted(tokens, limit))
                    rows["n"].append(size)
                    rows["s1"].append(s1)
                    rows["s2"].append(s2)
                    rows["heads"].append(cut)
                    rows["tokens"].append(tokens[: max(cut, p)].view(np.int64))
                    for name, want, seed in (("o2", "l2", 2), ("o3", "l3", 3)):
                        h = mix64(tokens, seed)
                        long = min(size, p + rule.depth(size) - 1) if size else 0
                        least = np.partition(h, long - 1)[:long] if size else h
                        short = np.unique(least.astype(np.uint16).view(np.int16))
                        rows[name].append(short)
                        # Tokens whose 16 bits coincide count once, so that many fewer are asked for.
                        rows[want].append(rule.depth(size) - (long - len(short)) if size else 0)
                n = len(rows["n"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(rows["n"], pa.int64()), pa.array(rows["s1"], pa.int64()), pa.array(rows["s2"], pa.int64()), pa.array(rows["heads"], pa.int64()), pa.array(rows["tokens"], pa.list_(pa.int64())), pa.array(rows["o2"], pa.list_(pa.int16())), pa.array(rows["o3"], pa.list_(pa.int16())), pa.array(rows["l2"], pa.int32()), pa.array(rows["l3"], pa.int32()), batch.column(2).slice(first, n)],
                    names=["doc_id", "n", "s1", "s2", "heads", "tokens", "o2", "o3", "l2", "l3", "th"],
                )

    return docs.mapInArrow(work, "doc_id long, n long, s1 long, s2 long, heads long, tokens array<long>, o2 array<short>, o3 array<short>, l2 int, l3 int, th long")


def _prefixes(sketch: DataFrame, spare: DataFrame, rule: Rule) -> DataFrame:
    """Order-1 prefix tokens that at least two documents have: (token, row, n, at), at from 0.

    Tokens of one document only are counted but not moved back: they hold prefix
    places and can't match, so most documents send nothing here.  Only one document
    of each class of equal sets goes on; any fixed function of a token makes a global
    order, so the counts may include the copies.
    """
    every = sketch.filter("doc_id is not null").select("row", F.posexplode("tokens").alias("pos", "token"))
    shared = materialize(every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    sizes = sketch.select("row", "n", "heads")
    back = every.join(shared, "token").join(spare.select("row"), "row", "left_anti").join(sizes, "row")
    by_doc = Window.partitionBy("row", "counted")
    placed = (
        back.withColumn("counted", F.col("pos") < F.col("heads"))
        .withColumn("found", F.count("*").over(by_doc))
        .withColumn("rank", F.row_number().over(by_doc.orderBy("df", "token")))
        .withColumn("at", F.when(F.col("counted"), F.col("heads") - F.col("found") + F.col("rank") - 1).otherwise(F.col("pos").cast("long")))
    )
    prefixes = materialize(placed.filter(F.col("at") < _prefix_column(rule)).select("token", "row", "n", "at"), "prefixes")
    discard(shared)
    return prefixes


def _by_rarity(texts: DataFrame, rule: Rule) -> DataFrame:
    """Prefixes of the documents of ``texts`` when all their tokens are ordered by frequency among them.

    Order 1 counts only a share of the tokens of the whole corpus; for the documents
    that are left to compare pair by pair it is replaced by this sharper order, in
    which a document's own words come first and leave no room for the common ones.
    """

    def work(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1), 500_000):
                sets = shingle_sets(data, offsets, rule.n)
                held = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(held), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(np.diff(held), pa.int64()), tokens], names=["row", "n", "tokens"])

    sets = texts.select("row", "text").mapInArrow(work, "row long, n long, tokens array<long>")
    sets = materialize(sets, "sets")
    every = sets.select("row", "n", F.explode("tokens").alias("token"))
    shared = materialize(every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    by_doc = Window.partitionBy("row")
    placed = every.join(shared, "token").withColumn("found", F.count("*").over(by_doc)).withColumn("rank", F.row_number().over(by_doc.orderBy("df", "token")))
    placed = placed.withColumn("at", F.expr("n - found + rank - 1"))
    prefixes = materialize(placed.filter(F.col("at") < _prefix_column(rule)).select("token", "row", "n", "at"), "prefixes")
    discard(sets)
    discard(shared)
    return prefixes


def _prefix_column(rule: Rule):
    return F.expr(f"n - (n * {rule.num} + {rule.den - 1}) div {rule.den} + 1")


def _room(rule: Rule):
    """Whether sizes and places of a common token of x and y leave room for a similar pair.

    The first common token of a similar pair leaves enough tokens behind it on both sides.
    """
    length = (F.col("n_x") * rule.den >= F.col("n_y") * rule.num) & (F.col("n_y") * rule.den >= F.col("n_x") * rule.num)
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    return length & (room * (rule.num + rule.den) >= (F.col("n_x") + F.col("n_y")) * rule.num)


def _sides(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "xy")


def _viable(live: DataFrame, rule: Rule) -> tuple[DataFrame, float, int]:
    """Rows of ``live`` that can be in a similar pair of two components, the pairs they make, and their number.

    Rows of one token that have the same size and place are one cell; cells are
    compared, so that a large bucket costs no more than its distinct sizes and places.
    """
    cells = materialize(live.groupBy("token", "n", "at").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")), "cells")
    x, y = _sides(cells, "n", "at", "c", "lo", "hi")
    apart = F.least("lo_x", "lo_y") != F.greatest("hi_x", "hi_y")
    good = x.join(y, "token").filter(apart & _room(rule)).groupBy("token", F.col("n_x").alias("n"), F.col("at_x").alias("at")).agg(F.max("c_x").alias("c"), F.sum("c_y").alias("partners"))
    good = materialize(good, "viable")
    row = good.agg(F.sum(F.col("c") * F.col("partners")).alias("pairs"), F.sum("c").alias("rows")).first()
    discard(cells)
    return live.join(good.select("token", "n", "at"), ["token", "n", "at"], "left_semi"), (row.pairs or 0) / 2, row.rows or 0


def _verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity, by comparing the whole sets."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))

    def work(batches):
        last: tuple = (None, None)
        for batch in batches:
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                if last[0] != a_ids[i]:
                    last = (a_ids[i], _set_of(batch.column(2).slice(i, 1), rule.n))
                x, y = last[1], _set_of(batch.column(3).slice(i, 1), rule.n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if rule.den * both >= rule.num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": [a_ids[i] for i in keep], "b": [b_ids[i] for i in keep]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(work, "a long, b long")


def _set_of(column: pa.Array, n: int) -> np.ndarray:
    _, data, offsets = next(text_slices(column))
    return shingle_sets(data, offsets, n)[0]


def _filtered(pairs: DataFrame, meta: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs that also share prefix tokens under orders 2 and 3 and pass the length bound."""
    m = meta.select("row", "n", "o2", "o3", "l2", "l3")
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    j = pairs.distinct().join(a, F.col("a") == F.col("row_a")).join(b, F.col("b") == F.col("row_b"))
    ok = (F.col("n_a") * rule.den >= F.col("n_b") * rule.num) & (F.col("n_b") * rule.den >= F.col("n_a") * rule.num)
    both = lambda o, l: F.size(F.array_intersect(f"{o}_a", f"{o}_b")) >= F.least(f"{l}_a", f"{l}_b")  # noqa: E731,E741
    return j.filter(ok).filter(both("o2", "l2")).filter(both("o3", "l3")).select("a", "b")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text", id_col: str = "doc_id", pivots: int = 3, rounds: int = 6) -> DataFrame:
    """Components of the graph that links documents of similarity ``rule.num / rule.den`` or more.

    Returns ``doc_id, n_shingles, component_id`` (smallest linked id, itself included)
    and ``text_xxhash64``, one row per input row.  Words are runs of bytes other than ASCII blanks, with A-Z
    in lower case.  Null, empty and blank texts have no shingles and no links.  Rows
    without an id have a null component and link nothing.  Rows are compared, not ids:
    repeated rows and rows of one id with different texts are nodes of their own, and
    each has the smallest id that it reaches.

    Equal sets are one node.  In a large group of near copies not all pairs are made:
    in each prefix bucket every document is first compared with a few pivots; pairs
    that a chain of verified links joins already need no comparison, and whatever a
    bucket still holds apart after these rounds is compared pair by pair, so no link
    between components is lost and nothing is capped.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    sketch = materialize(_sketches(plain, rule).withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = materialize(sketch.select("row", "doc_id", "th", F.col("n").alias("n_shingles")), "rows")
    key = ["s1", "s2", "n"]
    named = sketch.filter("doc_id is not null and n > 0")
    classes = materialize(named.groupBy(*key).agg(F.min("row").alias("rep"), F.count("*").alias("size")).filter("size > 1"), "classes")
    spare = materialize(named.select("row", *key).join(classes, key).filter("row <> rep").select("row", "rep"), "spare")
    prefixes = _prefixes(sketch, spare, rule)
    meta = materialize(sketch.select("row", "doc_id", "th", "n", "o2", "o3", "l2", "l3").join(prefixes.select("row").distinct(), "row", "left_semi"), "meta")
    texts = plain.join(meta.select("row", "doc_id", "th"), ["doc_id", "th"]).select("row", "text")
    if not named.groupBy("doc_id", "th").agg(F.count("*").alias("times")).filter("times > 1").isEmpty():
        texts = texts.dropDuplicates(["row"])  # of repeated rows one is in meta and meets them all
    texts = materialize(texts, "texts")
    discard(sketch)
    discard(classes)

    links, comp, tested = None, None, None
    before = float("inf")
    for turn in range(rounds + 1):
        live, last = prefixes, False
        if comp is not None:

            def mixed_rows(p: DataFrame) -> DataFrame:
                named = p.join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
                mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
                return materialize(named.join(mixed, "token", "left_semi"), "live")

            whole = mixed_rows(prefixes)
            live, n_pairs, n_rows = _viable(whole, rule)
            if not n_rows:
                break
            if turn == 1:
                left = materialize(live.select("row").distinct(), "left")
                # From here on only these documents meet, so only their texts move.
                fewer = [materialize(table.join(left, "row", "left_semi"), name) for table, name in ((texts, "texts"), (meta, "meta"))]
                for table in (whole, prefixes, texts, meta, left):
                    discard(table)
                texts, meta = fewer
                prefixes = _by_rarity(texts, rule)
                whole = mixed_rows(prefixes)
                live, n_pairs, n_rows = _viable(whole, rule)
                if not n_rows:
                    break
            # Pivots again only while they pay: a bucket of one large group shrinks to almost nothing each time.
            last = turn == rounds or n_pairs <= 10 * n_rows or n_pairs > 0.8 * before
            before = n_pairs
            live = materialize(live, "live")
            discard(whole)
        if last:
            x, y = _sides(live, "row", "n", "at", "component")
            apart = (F.col("row_x") < F.col("row_y")) & (F.col("component_x") != F.col("component_y"))
            pairs = x.join(y, "token").filter(apart & _room(rule)).select(F.col("row_x").alias("a"), F.col("row_y").alias("b"))
        else:
            # A document with few rarer words of its own is near many others; every third pivot is any document.
            mark = [F.xxhash64(F.lit(101 + turn * pivots + i), "row") for i in range(pivots)]
            order = [F.min_by("row", h if i % 3 == 2 else F.struct("at", h.alias("h"))).alias(f"p{i}") for i, h in enumerate(mark)]
            chosen = live.groupBy("token").agg(*order).select("token", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))).alias("pivot"))
            near = live.select("token", "row").join(chosen, "token").filter("row <> pivot")
            pairs = near.select(F.col("pivot").alias("a"), F.col("row").alias("b")).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.first("a").alias("a"), F.first("b").alias("b")).select("a", "b")
        pairs = materialize(_filtered(pairs, meta, rule), "pairs")
        if tested is not None:
            fresh = pairs.join(tested, [(F.least(pairs.a, pairs.b) == tested.lo), (F.greatest(pairs.a, pairs.b) == tested.hi)], "left_anti")
        else:
            fresh = pairs
        found = materialize(_verify(fresh, texts, rule), "links")
        links = found if links is None else links.union(found)
        now_tested = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        tested = now_tested if tested is None else tested.union(now_tested)
        if live is not prefixes:
            discard(live)
        if comp is not None:
            discard(comp)
        comp = materialize(connected_components(links, "a", "b"), "components")
        if last:
            break
    for table in (prefixes, meta, texts):
        discard(table)
    tops = comp.select(F.col("node").alias("rep"), F.col("component").alias("top"))
    copies = spare.join(tops, "rep", "left").select("row", F.coalesce("top", "rep").alias("component"))
    heads = spare.select(F.col("rep").alias("row")).distinct().join(tops.withColumnRenamed("rep", "row"), "row", "left_anti").select("row", F.col("row").alias("component"))
    member = materialize(copies.union(heads).union(comp.select(F.col("node"), "component")), "members")
    least = member.join(rows, "row").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # Written, so that a component with a large part of all rows is one small row against rows that Spark can split.
    least = materialize(least, "least")
    named = member.join(least, "component").select("row", "component_id")
    return rows.join(named, "row", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("th").alias("text_xxhash64"))


def drop_near_copies(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep the document with the smallest id of each component, with all columns.

    Rows without an id stay; repeated rows of a kept id all stay.  Rows of one id with
    different texts are decided on one by one.
    """
    found = jaccard_components(docs, rule, text_col, id_col).filter("component_id <> doc_id")
    gone = materialize(found.select(F.col("doc_id").alias("id"), "text_xxhash64").distinct(), "gone")
    # Columns of the input can have any names; those of ``gone`` are told by the table.
    return docs.join(gone, (docs[id_col] == gone["id"]) & (F.xxhash64(docs[text_col]) == gone["text_xxhash64"]), "left_anti")
