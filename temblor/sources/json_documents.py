"""Large JSON documents read by many tasks.

Spark's text reader cuts a file into splits and, with a closing brace as line end, every
split into pieces; a piece belongs to the split in which it starts.  One pass tells for
each split how it changes the nesting, once as if it began inside a string and once as
if not.  A row a split is enough to know in which state each begins; a second pass then
cuts out the objects of the document's array.  An object that crosses splits is put
together from its fragments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.scratch import scratch_path, written

TOKEN = re.compile(r'[{}\[\]]|"(?:[^"\\]++|\\.)*+("?)', re.S)
REST = re.compile(r'(?:[^"\\]++|\\.)*+("?)', re.S)


@dataclass
class Place:
    """Where in a document a split begins: inside a string, and how many braces and brackets are open."""

    in_string: bool = False
    braces: int = 0
    brackets: int = 0


class Scanner:
    """Goes through a split's text, fed in parts that end in a closing brace."""

    def __init__(self, place: Place):
        self.at = Place(place.in_string, place.braces, place.brackets)
        self.last_string: str | None = None

    def tokens(self, text: str):
        """(position, token, braces, brackets) of every brace and bracket outside strings, with what is open before it."""
        at, pos = self.at, 0
        if at.in_string:
            m = REST.match(text)
            at.in_string = not m.group(1)
            pos = m.end()
        while m := TOKEN.search(text, pos):
            pos, token = m.end(), m.group()
            if token[0] == '"':
                at.in_string = not m.group(1)
                self.last_string = None if at.in_string else token[1:-1]
                continue
            yield m.start(), token, at.braces, at.brackets
            at.braces += (token == "{") - (token == "}")
            at.brackets += (token == "[") - (token == "]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_split(batches):
    """(file, start, text) of runs of pieces of one split, in order."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], starts[i]) != (files[first], starts[first]):
                yield files[first], starts[first], "}".join(values[first:i]) + "}"
                first = i


def _changes(batches):
    """What each split does to the nesting, begun outside (0) or inside (1) a string."""
    now, scans = None, []

    def told():
        return [(*now, begun, s.at.in_string, s.at.braces, s.at.brackets, s.last_string) for begun, s in enumerate(scans)]

    rows = []
    for file, start, text in _by_split(batches):
        if now != (file, start):
            rows += told() if now else []
            now, scans = (file, start), [Scanner(Place()), Scanner(Place(in_string=True))]
        for s in scans:
            for _ in s.tokens(text):
                pass
    rows += told() if now else []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "start", "begun", "in_string", "braces", "brackets", "last_string"])


FOUND = "file string, start long, kind string, array int, n long, value string"


def _objects(places: dict, roots: dict):
    """Pass two: objects (whole), open heads and tails of objects that cross splits, and arrays that begin in a split."""

    def run(batches):
        now, scan, kept, open_at, n, arrays = None, None, [], None, 0, 0
        out: list[tuple] = []

        def close():
            """At the end of a split: what is open goes on in the next one."""
            if open_at is not None:
                out.append((*now, "head" if n else "through", arrays, n, "".join(kept)))

        for file, start, text in _by_split(batches):
            if now != (file, start):
                if now:
                    close()
                now, scan, kept, n, arrays = (file, start), Scanner(places[file, start]), [], 0, 0
                depth = roots[file]
                # Inside an object already, which an earlier split began.
                open_at = 0 if scan.at.braces > depth and scan.at.brackets >= 1 else None
            elif open_at is not None:
                open_at = 0
            for pos, token, braces, brackets in scan.tokens(text):
                if token == "[" and brackets == 0 and braces == depth:
                    arrays += 1
                    out.append((*now, "array", arrays, 0, scan.last_string))
                elif token == "{" and braces == depth and brackets == 1:
                    open_at, n, kept = pos, n + 1, []
                elif token == "}" and braces == depth + 1 and brackets == 1 and open_at is not None:
                    value = "".join(kept) + text[open_at : pos + 1]
                    out.append((*now, "whole" if n else "tail", arrays, n, value))
                    open_at, kept = None, []
            if open_at is not None:
                kept.append(text[open_at:])
            if len(out) > 5000:
                yield _rows(out)
                out.clear()
        if now:
            close()
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "start", "kind", "array", "n", "value"])


def objects(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(value) texts of the objects in each document's array, and whether that is a ``features`` array.

    The array is the document itself, else that under the key ``features``, else the
    first array under a key of the outermost object.  Other elements than objects are
    left out; a document without an array gives none.  A file is one document.
    """
    pieces = _pieces(spark, path)
    head = pieces.filter("start = 0").withColumn("at", F.monotonically_increasing_id())
    head = head.groupBy("file").agg(F.min_by(F.substring(F.regexp_replace("value", "^[\\s\ufeff]+", ""), 1, 1), "at").alias("first"))
    roots = {r.file: 0 if r.first == "[" else 1 for r in head.collect()}  # a row a file
    kinds = "file string, start long, begun int, in_string boolean, braces long, brackets long, last_string string"
    changes = pieces.mapInArrow(_changes, kinds).orderBy("file", "start", "begun").collect()  # two rows a split
    places, spoken, file, at = {}, {}, None, Place()
    for one in range(0, len(changes), 2):
        if changes[one].file != file:
            file, at, said = changes[one].file, Place(), None
        places[file, changes[one].start], spoken[file, changes[one].start] = at, said
        change = changes[one + at.in_string]
        said = change.last_string if change.last_string is not None else said
        at = Place(change.in_string, at.braces + change.braces, at.brackets + change.brackets)
    shared = spark.sparkContext.broadcast((places, roots))  # a row a split
    found = written(pieces.mapInArrow(lambda batches: _objects(*shared.value)(batches), FOUND), "objects")
    # Arrays are numbered over the splits of a file; the wanted one is told by its number.
    begun = found.filter("kind = 'array'").select("file", "start", "array", "value").orderBy("file", "start", "array").collect()  # a row a key of an outermost object
    keys, counts = {}, {}
    for r in begun:
        keys.setdefault(r.file, []).append(r.value if r.value is not None else spoken[r.file, r.start])
        counts[r.file, r.start] = counts.get((r.file, r.start), 0) + 1
    wanted = {f: names.index("features") + 1 if roots[f] and "features" in names else 1 for f, names in keys.items()}
    heads = {(r.file, r.start) for r in found.filter("kind = 'head'").select("file", "start").collect()}  # at most one a split
    rows, base, owner = [], {}, {}
    for f, start in places:
        rows.append((f, start, base.get(f, 0), wanted.get(f, 0), owner.get(f)))
        base[f] = base.get(f, 0) + counts.get((f, start), 0)
        if (f, start) in heads:
            owner[f] = start
    splits = spark.createDataFrame(rows, "file string, start long, base int, wanted int, owner long")
    placed = found.filter("kind <> 'array'").join(F.broadcast(splits), ["file", "start"])  # a row a split
    inside = F.col("base") + F.col("array") == F.col("wanted")
    whole = placed.filter((F.col("kind") == "whole") & inside).select("value")
    parts = placed.filter(F.col("kind") != "whole").withColumn("owner", F.when(F.col("kind") == "head", F.col("start")).otherwise(F.col("owner")))
    parts = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"), F.max(F.when(F.col("kind") == "head", inside)).alias("inside"))
    crossed = parts.filter("inside").select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    features = any(roots[f] and "features" in names for f, names in keys.items())
    return whole.union(crossed), features


def as_lines(values: DataFrame) -> DataFrame:
    """The objects as a table, through a file of one object a line, which splits anywhere."""
    path = scratch_path(values.sparkSession, "objects.json")
    values.select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).write.text(path)
    return values.sparkSession.read.json(path)
