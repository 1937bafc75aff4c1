"""Operator 8, suffix-array dedup: every byte under a long repeated string goes.

A string of ``length`` bytes is assigned to its minimizer, the leftmost smallest hash
of its q-byte substrings: equal strings have equal minimizers at equal places, so all
occurrences of a repeated string meet in the bucket of one q-gram.  Only contexts in
buckets of at least two occurrences are moved.  A bucket too large for one task is
refined by Spark: its contexts are cut into narrower ranges of starts, and each piece
moves to the bucket of the bytes that all strings of its range share, until every bucket
fits.  Inside a task suffixes are sorted by bucket pointers: initial buckets of 8 bytes,
refined by sorting on the bucket identifiers of later offsets, with the identifiers just
renewed reused by the next pass, until the depth reaches ``length``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import discard, materialize, prefix_hash, span_hash, text_slices


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of every window, by doubling."""
    at = np.arange(len(values))
    best, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(best) - step
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        reach += step
    return at


def anchored_spans(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Per minimizer: (text, hash, first start, last start, place) of the strings that it stands for."""
    prefix = prefix_hash(data)
    n_grams = len(data) - q + 1
    empty = np.zeros(0, np.int64)
    if n_grams <= 0:
        return empty, empty, empty, empty, empty
    starts = np.arange(n_grams)
    grams = span_hash(prefix, starts, starts + q)
    owner, key, low, high, place = [], [], [], [], []
    for i in np.flatnonzero(np.diff(offsets) >= length):
        a, b = offsets[i], offsets[i + 1]
        h = grams[a : b - q + 1]
        at = window_minima(h, length - q + 1)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        owner.append(np.full(len(first), i))
        key.append(h[at[first]].view(np.int64))
        low.append(first)
        high.append(last)
        place.append(at[first])
    if not owner:
        return empty, empty, empty, empty, empty
    return tuple(map(np.concatenate, (owner, key, low, high, place)))


def repeated_starts(contexts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each context, which of its starts begin a ``length``-byte string that starts elsewhere too.

    Bucket-pointer refinement over all suffixes of the contexts, cut at ``length``.
    ``bucket[i]`` names the string of ``depth`` bytes at i.  A bucket of one is final;
    only suffixes in larger buckets are sorted again, by the buckets at i and i + depth.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.concatenate(contexts)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))  # bytes left in the context
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    for k in range(8):
        code = (code << np.uint64(8)) | padded[k : k + len(data)]
    code[room < 8] = np.arange((room < 8).sum(), dtype=np.uint64)  # too short for any start: dropped below
    depth = 8
    active = np.flatnonzero(room >= 8)
    _, first = np.unique(code[active], return_inverse=True)
    bucket = np.full(len(data), -1, np.int64)
    bucket[active] = first
    bucket[room < 8] = first.max(initial=-1) + 1 + np.arange((room < 8).sum())
    names = int(bucket.max(initial=-1)) + 1
    while depth < length:
        step = min(depth, length - depth)
        held = np.bincount(bucket, minlength=names)
        active = np.flatnonzero((held[bucket] > 1) & (room >= depth + step))
        short = np.flatnonzero((held[bucket] > 1) & (room < depth + step))
        later = bucket[active + step]
        pair = bucket[active] * np.int64(names + 1) + later  # at most 8 names a suffix: fits 63 bits
        _, refined = np.unique(pair, return_inverse=True)
        top = names
        bucket[active] = top + refined
        names = top + int(refined.max(initial=-1)) + 1
        bucket[short] = names + np.arange(len(short))
        names += len(short)
        depth += step
    held = np.bincount(bucket, minlength=names)
    again = (held[bucket] > 1) & (room >= length)
    return [again[e - n : e - length + 1] for e, n in zip(ends, sizes, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of true flags."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def covered(intervals: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows as maximal disjoint runs, touching ones joined."""
    if not len(intervals):
        return intervals.reshape(0, 2)
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    end = np.maximum.accumulate(intervals[:, 1])
    new = np.r_[True, intervals[1:, 0] > end[:-1]]
    at = np.flatnonzero(new)
    return np.stack([intervals[at, 0], np.r_[end[at[1:] - 1], end[-1]]], axis=1)


#: Starts low to high of a text have their minimizer ``lead`` bytes behind low.
ANCHORS = "array<struct<key:bigint,low:int,high:int,lead:smallint>>"


def _anchored(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(doc_id, sha, n_bytes, anchors) of each text."""
    kind = pa.struct([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("lead", pa.int16())])

    def work(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                owner, key, low, high, place = anchored_spans(data, offsets, length, q)
                n = len(offsets) - 1
                held = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(place - low, pa.int16())], fields=list(kind))
                shas = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(shas, pa.binary()), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(held), items)], names=["doc_id", "sha", "n_bytes", "anchors"])

    return docs.mapInArrow(work, f"doc_id long, sha binary, n_bytes long, anchors {ANCHORS}")


def _contexts(marked: DataFrame, length: int) -> DataFrame:
    """(sha, key, low, lead, name, bytes) of each marked anchor; ``name`` is a 128-bit digest of the bytes.

    Of contexts that repeat within a batch only the first carries its bytes.
    """
    kind = pa.schema([("sha", pa.binary()), ("key", pa.int64()), ("low", pa.int32()), ("lead", pa.int16()), ("name", pa.binary()), ("bytes", pa.binary())])

    def work(batches):
        for batch in batches:
            seen = set()
            out: dict[str, list] = {k: [] for k in kind.names}
            for text, sha, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                for m in marks:
                    cut = data[m["low"] : m["high"] + length]
                    name = hashlib.blake2b(cut, digest_size=16).digest()
                    for k, x in zip(kind.names, (sha, m["key"], m["low"], m["lead"], name, None if name in seen else cut), strict=True):
                        out[k].append(x)
                    seen.add(name)
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return marked.select("text", "sha", "marks").mapInArrow(work, "sha binary, key long, low int, lead short, name binary, bytes binary")


SPANS = "array<struct<first:int,last:int>>"


def _refined(distinct: DataFrame, length: int, budget: int = 1_500_000) -> DataFrame:
    """(key, name, spans) of distinct contexts in buckets that fit a task; spans are (first, last) repeated starts.

    Buckets arrive sorted by key and are refined many at a time: strings of different
    buckets differ, so they never meet in the sort.
    """
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def flush(table: pa.Table) -> pa.RecordBatch:
        parts = [np.frombuffer(b, np.uint8) for b in table["bytes"].to_pylist()]
        spans = [[{"first": int(a), "last": int(b)} for a, b in zip(*runs(flags), strict=True)] for flags in repeated_starts(parts, length)]
        return pa.RecordBatch.from_arrays([table["key"].combine_chunks(), table["name"].combine_chunks(), pa.array(spans, kind)], names=["key", "name", "spans"])

    def work(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.nbytes > budget:
                keys = held["key"].to_numpy()
                sizes = np.cumsum(pc.binary_length(held["bytes"]).to_numpy())
                edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # starts of complete buckets' successors
                if not len(edges):
                    break
                fit = edges[sizes[edges - 1] <= budget]
                cut = int(fit[-1] if len(fit) else edges[0])
                yield flush(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield flush(held)

    ordered = distinct.select("key", "name", "bytes").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(work, f"key long, name binary, spans {SPANS}")


def _pieces(contexts: DataFrame, length: int, q: int, width: int) -> DataFrame:
    """Contexts cut into ranges of starts whose distance to the anchor lies in one block of ``width``.

    Rows (of_key, of_name, shift, key, name, lead, bytes): a piece begins ``shift``
    starts behind its context's first.  All strings of a block share the bytes from
    its nearest start to the end of its farthest start's string, at least
    ``length - width + 1``; these name the piece's new bucket, so equal strings stay
    in one bucket.
    """
    kind = pa.schema([("of_key", pa.int64()), ("of_name", pa.binary()), ("shift", pa.int32()), ("key", pa.int64()), ("name", pa.binary()), ("lead", pa.int16()), ("bytes", pa.binary())])

    def work(batches):
        for batch in batches:
            seen = set()
            out: dict[str, list] = {k: [] for k in kind.names}
            for key, name, lead, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                nearest = lead - (len(data) - length)  # distance of the last start
                for block in range(nearest // width, lead // width + 1):
                    first = lead - min(lead, block * width + width - 1)
                    last = lead - max(nearest, block * width)
                    farthest = min(block * width + width - 1, length - q)
                    shared = data[lead - block * width : lead - farthest + length]
                    bucket = hashlib.blake2b(shared, digest_size=8, key=block.to_bytes(4, "little")).digest()
                    cut = data[first : last + length]
                    own = hashlib.blake2b(cut, digest_size=16).digest()
                    row = (key, name, first, int.from_bytes(bucket, "little", signed=True), own, lead - first, None if (bucket, own) in seen else cut)
                    for k, x in zip(kind.names, row, strict=True):
                        out[k].append(x)
                    seen.add((bucket, own))
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return contexts.select("key", "name", "lead", "bytes").mapInArrow(work, "of_key long, of_name binary, shift int, key long, name binary, lead short, bytes binary")


def _distinct(contexts: DataFrame) -> DataFrame:
    """One row a content in a bucket: key, name, lead, bytes, copies."""
    return contexts.groupBy("key", "name").agg(F.first("lead").alias("lead"), F.first("bytes", ignorenulls=True).alias("bytes"), F.count("*").alias("copies"))


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["first"] + by).alias("first"), (s["last"] + by).alias("last")))


def _repeats(contexts: DataFrame, length: int, q: int, budget: int, widths: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """(key, name, spans) of the contexts that have repeated starts; spans are (first, last) of runs of starts.

    Buckets of up to ``budget`` bytes of distinct contexts are refined in tasks.  The
    contexts of larger ones are cut into pieces (:func:`_pieces`), and so on with
    narrower blocks; what the pieces find is handed back up to their contexts.  With
    blocks of one start a bucket holds one content, so the last level is always done.
    A content that occurs twice repeats wholly, and stays as one row for others to meet.
    """
    distinct = materialize(_distinct(contexts), "distinct_contexts")
    sizes = materialize(distinct.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("held")).filter("n > 1"), "bucket_sizes")
    most = budget if widths else 2**62
    fit, large = sizes.filter(F.col("held") <= most).select("key"), sizes.filter(F.col("held") > most).select("key")
    found = _refined(distinct.join(fit, "key", "left_semi"), length)
    below = []
    if widths and not large.isEmpty():
        pieces = materialize(_pieces(distinct.join(large, "key", "left_semi"), length, q, widths[0]), "pieces")
        spans = _repeats(pieces, length, q, budget, widths[1:])
        up = pieces.select("of_key", "of_name", "shift", "key", "name").join(spans, ["key", "name"])
        found = found.union(up.groupBy(F.col("of_key").alias("key"), F.col("of_name").alias("name")).agg(F.flatten(F.collect_list(_moved(F.col("spans"), F.col("shift")))).alias("spans")))
        below = [pieces, spans]
    alike = distinct.filter("copies > 1").select("key", "name", F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("bytes") - length).cast("int").alias("last"))).cast(SPANS).alias("spans"))
    spans = found.join(alike.select("key", "name"), ["key", "name"], "left_anti").filter(F.size("spans") > 0).union(alike)
    spans = materialize(spans, "spans")
    for table in [distinct, sizes, *below]:
        discard(table)
    return spans


def _cut(marked: DataFrame, length: int) -> DataFrame:
    """(sha, removed, kept_sha): unions the starts' strings and hashes what stays."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for batch in batches:
            removed, shas = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                spans = covered(np.array([(s["first"], s["last"] + length) for s in starts], np.int64))
                keep, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    keep.update(data[at:a])
                    at = b
                keep.update(data[at:])
                removed.append([{"start": a, "end": b} for a, b in spans.tolist()])
                shas.append(keep.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, kind), pa.array(shas, pa.binary())], names=["sha", "removed", "kept_sha"])

    return marked.select("sha", "text", "starts").mapInArrow(work, "sha binary, removed array<struct<start:int,end:int>>, kept_sha binary")


def remove_repeats(docs: DataFrame, length: int = 400, q: int = 64, text_col: str = "text", id_col: str = "doc_id", budget: int = 1_000_000) -> DataFrame:
    """Find every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns one row per input row: ``doc_id, n_bytes, removed, kept_sha256``;
    ``removed`` are the maximal [start, end) byte spans to cut, touching ones joined,
    ``kept_sha256`` is the digest of the remaining bytes.  Texts are UTF-8 bytes, a
    null one is empty; strings never cross rows and are judged on the input.  Rows
    with equal texts (also repeated rows and rows without an id) are each other's
    repeats.  ``length`` must exceed ``q`` and 8.  Other columns play no part, an
    empty table gives an empty result.  ``budget`` is the size in bytes above which a
    bucket is refined by Spark before tasks take it; it does not change the result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_anchored(base, length, q).withColumn("own", F.monotonically_increasing_id()), "anchors")
    # Equal texts are handled once: all their strings repeat, and one of them meets the other texts.
    texts = rows.filter(F.size("anchors") > 0).groupBy("sha").agg(F.min("own").alias("own"), F.count("*").alias("copies"))
    texts = materialize(texts, "distinct")
    marks = rows.select("own", "doc_id", F.explode("anchors").alias("m")).join(texts, "own").select("doc_id", "sha", "copies", "m")
    # Written, so that a hot key is one small row here against rows that Spark can split.
    often = materialize(marks.groupBy(F.col("m.key").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    marks = marks.join(often, F.col("m.key") == F.col("key"), "left_semi").groupBy("doc_id", "sha", "copies").agg(F.collect_list("m").alias("marks"))
    marks = materialize(marks, "marks")
    full = base.withColumn("sha_", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    marked = full.withColumnRenamed("doc_id", "id_").join(marks, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("sha_") == F.col("sha")))
    marked = materialize(marked.select("sha", "copies", "text", "marks"), "marked")
    contexts = materialize(_contexts(marked, length), "contexts")
    spans = _repeats(contexts, length, q, budget)

    single = texts.filter("copies = 1").select("sha")
    starts = contexts.select("sha", "key", "name", "low").join(spans, ["key", "name"]).join(single, "sha", "left_semi")
    starts = starts.groupBy("sha").agg(F.flatten(F.collect_list(_moved(F.col("spans"), F.col("low")))).alias("starts"))
    cuts = materialize(_cut(marked.select("sha", "text").join(starts, "sha"), length).dropDuplicates(["sha"]), "cuts")
    for table in (often, marks, marked, contexts, spans):
        discard(table)

    wholly = texts.filter("copies > 1").select("sha", F.lit(True).alias("whole"))
    out = rows.select("doc_id", "sha", "n_bytes").join(wholly, "sha", "left").join(cuts, "sha", "left")
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))).cast("array<struct<start:int,end:int>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), everything).otherwise(F.coalesce("removed", nothing)).alias("removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )


def cut_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    """What stays of a text's bytes when [start, end) spans are cut."""
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
