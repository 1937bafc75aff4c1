"""Operator 13, mining of collocations from vertical positional inverted lists.

Texts are dealt into blocks.  For every word of a block there is the sorted list of its
positions; a break of a phrase takes a position of its own, so words are neighbours only
if their positions differ by one.  A list's length is the word's frequency in the block,
and Spark adds the lengths up.  What is frequent over all blocks goes back to its blocks,
where the lists of frequent phrases are merged by position: an occurrence that is
followed by one of another frequent phrase, one word on, is an occurrence of the phrase
that is one word longer.  Its lists are the input of the next step.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.llm.common import discard, materialize, text_slices

BREAKS = b".,;:!?\n\x0b\x0c\r"
ONE_BREAK = bytes.maketrans(BREAKS, b"." * len(BREAKS))
#: A row of lists has a block, its lists end to end and their lengths; a row of a key has block * 2**31 + number of its list, and its length.
LISTS = [("block", pa.int64()), ("positions", pa.binary()), ("lengths", pa.binary())]
WORDS = pa.schema([("at", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), *LISTS])
PAIRS = pa.schema([("at", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), *LISTS])
SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


class Numbers(dict):
    """Number of each word met, in the order of appearance; a break is -1."""

    def __init__(self, counter):
        super().__init__({b".": -1})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.counter)
        return n


def grouped(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal owners together, positions ascending inside; and how many each has."""
    return np.argsort(owner, kind="stable"), np.bincount(owner, minlength=n)


def _list_row(schema: pa.Schema, block: int, positions: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    row = {"block": block, "positions": positions.astype(np.int32).tobytes(), "lengths": lengths.astype(np.int32).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema)


def _key_rows(schema: pa.Schema, block: int, columns: dict, rows: int = 50_000):
    n = len(columns["n"])
    whole = {"at": (block << 31) + np.arange(n), **columns}
    arrays = [pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(n, f.type) for f in schema]
    for first in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([a.slice(first, rows) for a in arrays], schema=schema)


def word_lists(docs: DataFrame, lang: Column, text: Column, block_bytes: int) -> DataFrame:
    """Inverted lists of words: for each block a row with all lists and a row for each (lang, word)."""

    def index(langs: dict, parts: list):
        ids = np.concatenate(parts)
        names = [(k, w) for k, numbers in langs.items() for w in numbers if w != b"."]
        number = np.fromiter((langs[k][w] for k, w in names), np.int64, len(names))
        at = np.flatnonzero(ids >= 0)
        order, lengths = grouped(ids[at], len(names))
        block = (TaskContext.get().partitionId() << 12) + index.blocks
        index.blocks += 1
        yield _list_row(WORDS, block, at[order], lengths)
        turn = np.argsort(number)
        word = pa.array([names[i][1] for i in turn], pa.binary()).cast(pa.string())
        yield from _key_rows(WORDS, block, {"lang": [names[i][0] for i in turn], "word": word, "n": lengths.astype(np.int64)})

    def run(batches):
        index.blocks, size, counter, langs, parts = 0, 0, count(), {}, []
        for batch in batches:
            of = batch.column(0).to_pylist()
            for first, data, offsets in text_slices(batch.column(1)):
                for i in range(len(offsets) - 1):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    words = raw.lower().translate(ONE_BREAK).replace(b".", b" . ").split()  # of bytes, so only A-Z and ASCII blanks
                    words.append(b".")
                    if of[first + i] not in langs:
                        langs[of[first + i]] = Numbers(counter)
                    numbers = langs[of[first + i]]
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += int(offsets[-1])
                if size >= block_bytes:
                    yield from index(langs, parts)
                    size, counter, langs, parts = 0, count(), {}, []
        if parts:
            yield from index(langs, parts)

    return docs.select(lang.alias("lang"), text.alias("text")).filter("text is not null").mapInArrow(run, _ddl(WORDS))


def frequent(table: DataFrame, by: list[str], least: int) -> DataFrame:
    """The keys of blocks whose phrase is frequent over all of them: ``at, by..., f, id``.

    ``id`` is the smallest key of the phrase, so the same in all its blocks.  A phrase has
    at most one row a block, and only keys and lengths are moved, never positions.
    """
    w = Window.partitionBy(*by)
    return table.filter("at is not null").select("at", *by, F.sum("n").over(w).alias("f"), F.min("at").over(w).alias("id")).filter(F.col("f") >= least)


def longer(table: DataFrame, alive: DataFrame, keep_lists: bool) -> DataFrame:
    """Lists of the phrases that are one word longer, by merging the lists of the frequent ones block by block."""

    def run(key, lists: pa.Table, alive: pa.Table) -> pa.Table:
        if not lists.num_rows or not alive.num_rows:
            return PAIRS.empty_table()
        block = key[0].as_py()
        positions = np.frombuffer(lists["positions"][0].as_buffer(), np.int32)
        lengths = np.frombuffer(lists["lengths"][0].as_buffer(), np.int32)
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        idx, ids = alive["idx"].to_numpy(), alive["id"].to_numpy()
        n = lengths[idx]
        take = np.repeat(starts[idx] - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)
        at, owner = positions[take], np.repeat(np.arange(len(idx), dtype=np.int32), n)
        order = np.argsort(at).astype(np.int32)
        at, owner = at[order], owner[order]
        hit = np.flatnonzero(at[1:] == at[:-1] + 1).astype(np.int32)
        pair, which = np.unique(owner[hit].astype(np.int64) * len(idx) + owner[hit + 1], return_inverse=True)
        which = which.astype(np.int32)
        order, lengths = grouped(which, len(pair))
        rows = [*_key_rows(PAIRS, block, {"left": ids[pair // len(idx)], "right": ids[pair % len(idx)], "n": lengths.astype(np.int64)})]
        if keep_lists:
            rows.append(_list_row(PAIRS, block, at[hit][order], lengths))
        return pa.Table.from_batches(rows, PAIRS)

    lists = table.filter("block is not null").select("block", "positions", "lengths").groupBy("block")
    keys = alive.select(F.shiftright("at", 31).alias("block"), F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("idx"), "id")
    return lists.cogroup(keys.groupBy("block")).applyInArrow(run, _ddl(PAIRS))


def mine(docs: DataFrame, longest: int = 4, least: int = 30, cover: tuple[int, int] = (80, 100), top: int = 2000, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 32 << 20) -> DataFrame:
    """Best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Letters A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends, and those
    pieces at blanks and tabs.  A phrase of 2 to ``longest`` words with at least ``least``
    occurrences ``a`` (overlaps count) scores floor(2000000 * a / (l + r)), where l and r
    are the occurrences of the two parts at its lowest-scoring cut, the first of those.
    Phrases inside a longer frequent one that has ``cover`` of their occurrences go.  Each
    language keeps ``top`` phrases by score, a, and the phrase's bytes.

    Null and empty texts hold no words; a null language is ``und``.  Repeated rows count
    again, ids and other columns play no part, an empty table gives an empty result.  A
    block holds ``block_bytes`` of text or one longer text; what a task holds is bounded by
    it.  Memory of a word is its own length, however long it is.
    """
    table = materialize(word_lists(docs, F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col), block_bytes), "words")
    totals = materialize(table.filter("at is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    alive = materialize(frequent(table, ["lang", "word"], least), "frequent")
    own = F.col("id") == F.col("at")  # one row of each phrase
    same = F.array("f")
    known = alive.filter(own).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), same.alias("heads"), same.alias("tails"))
    found, inside = [], []
    for size in range(2, longest + 1):
        nxt = materialize(longer(table, alive, size < longest), "phrases")
        discard(table)
        table, alive = nxt, materialize(frequent(nxt, ["left", "right"], least), "frequent")
        one, two = (known.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "last", "heads", "tails")]) for side in ("left", "right"))
        rows = alive.filter(own).select("id", "left", "right", "f").join(one, "left").join(two, "right")
        heads, tails = F.concat("left_heads", same), F.concat("right_tails", same)  # occurrences of the first and of the last 1, 2, ... words
        rows = rows.select("id", "left", "right", "f", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), heads.alias("heads"), tails.alias("tails"))
        known = materialize(rows, "known")
        found.append(known.select(F.lit(size).alias("size"), "id", "lang", "phrase", "f", "heads", "tails"))
        inside += [known.select(F.lit(size - 1).alias("size"), F.col(side).alias("id"), "f") for side in ("left", "right")]
    discard(table)
    phrases, covering = found[0], inside[0]
    for more in found[1:]:
        phrases = phrases.union(more)
    for more in inside[1:]:
        covering = covering.union(more)
    # A longer phrase around the next longer one has no more occurrences than that, so only those are looked at.
    covering = covering.groupBy("size", "id").agg(F.max("f").alias("around"))
    part, whole = cover
    kept = phrases.join(covering, ["size", "id"], "left").filter(f"around is null or {whole} * around < {part} * f")
    score = F.expr("cast(cast(2000000 as decimal(10,0)) * cast(f as decimal(20,0)) div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[size - k - 1] as decimal(20,0))) as bigint)")
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    scored = kept.select("size", "id", "lang", "phrase", "f", "heads", "tails", cuts).withColumn("score", score)
    lowest = scored.groupBy("size", "id").agg(F.min(F.struct("score", "k", F.expr("heads[k - 1]").alias("l"), F.expr("tails[size - k - 1]").alias("r"), "lang", "phrase", F.col("f").alias("a"))).alias("c")).select("c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
