"""Operator 1, licence scans: TF-IDF cosine to templates, then inheritance along paths.

Every line, the whole and every window of words about as long as a template, across
line ends, is a sparse TF-IDF vector over the templates' terms; the best cosine to a
template decides.  A file without a licence of its own
takes that of the nearest directory above it that holds a licence file, by joins on
directory paths.
"""

from __future__ import annotations

import math
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import materialize, text_runs

#: Notices by which licences are declared, after their public texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
}
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LICENSE_FILES = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\.(txt|md|rst))?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Templates:
    """The templates' TF-IDF vectors under given document frequencies of their terms."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n_docs: int):
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        self.vocab = {t: i for i, t in enumerate(sorted({t for texts in templates.values() for x in texts for t in terms(x)}))}
        self.idf = np.array([math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in self.vocab])
        self.unseen = math.log(1 + n_docs) + 1  # of a term that no template has
        matrix = np.zeros((len(self.names), len(self.vocab)))
        for row, (name, i) in enumerate(self.names):
            for t in terms(templates[name][i]):
                matrix[row, self.vocab[t]] += 1
        matrix *= self.idf
        self.matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        # For windows: a term's part in each product; the last two columns are a word no template has, and a text's end.
        self.part = np.hstack([self.matrix * self.idf, np.zeros((len(self.names), 2))])
        self.square = np.concatenate([self.idf**2, [self.unseen**2, np.inf]])
        self.sizes: dict[int, list[int]] = {}  # template rows by length of window: a template's own and up to a quarter more
        for row, (name, i) in enumerate(self.names):
            n = len(terms(templates[name][i]))
            for size in range(n, n + max(1, n // 4) + 1):
                self.sizes.setdefault(size, []).append(row)

    CHUNK = 100_000  # words whose windows are scored at a time

    def _best_windows(self, x: np.ndarray, best: np.ndarray, rows: np.ndarray) -> None:
        """Put the best cosine of the windows from each of the first ``len(best)`` words, and its row, into ``best`` and ``rows``."""
        unknown = len(self.vocab)
        sums: dict[int, np.ndarray] = {}
        norm, again = self.square[x], np.zeros(len(x))  # squared norm of the window from each word; earlier equal words in a window ending there
        twice = np.where(x < unknown, 2 * self.square[x], 0.0)
        for size in range(1, min(max(self.sizes), len(x)) + 1):
            if size > 1:
                # One word more: (c + 1)**2 - c**2 = 2 c + 1 squares for a known word that the window has c times.
                d = size - 1
                same = (x[d:] == x[:-d]) & (x[d:] < unknown)
                again[d:] += np.where(same, twice[d:], 0.0)
                norm = norm[:-1] + self.square[x[d:]] + again[d:]
            if size not in self.sizes:
                continue
            root = np.sqrt(norm[: len(best)])
            for row in self.sizes[size]:
                if row not in sums:
                    sums[row] = np.concatenate([[0.0], np.cumsum(self.part[row][x])])
                cos = (sums[row][size:] - sums[row][:-size])[: len(root)] / root
                better = np.flatnonzero(cos > best[: len(cos)] + 1e-9)
                best[better], rows[better] = cos[better], row

    def windows(self, texts: list[list[str]]) -> list[tuple[float, int, int]]:
        """For each text the highest cosine of a window, its template row and its first word.

        Ties go to the shorter window, then the first template, then the first window; (0.0, -1, -1) if none shares a term.
        """
        unknown, end = len(self.vocab), len(self.vocab) + 1
        get = self.vocab.get
        flat, starts = array("q"), []
        for words in texts:
            starts.append(len(flat))
            flat.extend([get(w, unknown) for w in words])
            flat.append(end)
        x = np.array(flat, np.int64)
        n, most = len(x), max(self.sizes)
        best, rows = np.zeros(n), np.full(n, -1)
        for a in range(0, n, self.CHUNK):
            self._best_windows(x[a : a + self.CHUNK + most - 1], best[a : a + self.CHUNK], rows[a : a + self.CHUNK])
        out = []
        for i, first in enumerate(starts):
            last = starts[i + 1] if i + 1 < len(starts) else n
            at = first + int((best[first:last] > best[first:last].max() - 1e-9).argmax())
            out.append((min(float(best[at]), 1.0), int(rows[at]), at - first if rows[at] >= 0 else -1))
        return out

    def best(self, segments: list[list[str]]) -> tuple[float, int, int]:
        """Highest cosine, its template row and its segment; ties to the first template, then segment.

        Terms unknown to the templates enlarge a segment's norm, each occurrence on its own.
        """
        get = self.vocab.get
        best = (0.0, -1, -1)
        for n, words in enumerate(segments):
            known = [i for w in words if (i := get(w)) is not None]
            if not known:
                continue
            tf = np.bincount(known, minlength=len(self.vocab)) * self.idf
            norm = math.sqrt(float(tf @ tf) + (len(words) - len(known)) * self.unseen**2)
            cos = self.matrix @ tf / norm
            row = int(cos.argmax())
            if cos[row] > best[0] + 1e-12:
                best = (float(cos[row]), row, n)
        return best


def term_frequencies(docs: DataFrame, vocab: set[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each template term stands, over all texts; as many rows as terms."""

    def count(batches):
        held: dict[str, int] = {}
        n = 0
        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                for text in texts:
                    n += 1
                    for t in vocab.intersection(terms(text)) if text else ():
                        held[t] = held.get(t, 0) + 1
        held[""] = n
        yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())})

    rows = docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in rows}
    return df, df.pop("", 0)


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.75, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Licence of each file, its own or its nearest ancestor directory's.

    Returns ``doc_id, path, own_license, score, line, license, via``: ``line`` is the
    0-based line that matched or in which the window that matched begins (-1: the
    whole text or its only line, null: none), ``via`` is ``own``,
    the directory that gave the licence, or null.  A directory's licence is that of
    the licence files in it (names like LICENSE or COPYING) with the highest score,
    ties to the smaller name.  Null and empty texts have no licence of their own; a
    null path has no ancestors.  Of templates that score alike the first counts, of
    lines the first.  Repeated rows are rows; other columns play no part; an empty
    table gives an empty result.
    """
    spark = files.sparkSession
    vocab = {t for texts in templates.values() for x in texts for t in terms(x)}
    df, n = term_frequencies(files, vocab, text_col)
    model = Templates(templates, df, n)
    shared = spark.sparkContext.broadcast(model)  # as large as the templates

    @F.arrow_udf("struct<name:string,score:double,line:int>")
    def matched(column: pa.Array) -> pa.Array:
        m = shared.value
        names, scores, lines = [], [], []
        for _, texts in text_runs(column, 500_000):
            cut = [[TERM.findall(p) for p in text.lower().split("\n")] if text else [] for text in texts]
            asked = [i for i, parts in enumerate(cut) if any(w in m.vocab for words in parts for w in words)]
            whole = [[w for words in cut[i] for w in words] for i in asked]
            found = dict(zip(asked, zip(whole, m.windows(whole) if whole else [], strict=True), strict=True))
            for i, parts in enumerate(cut):
                name, score, line = None, 0.0, None
                if i in found:
                    words, (cos, template, first) = found[i]
                    score, row, at = m.best(parts + [words] if len(parts) > 1 else parts)
                    if cos > score + 1e-9:
                        score, row = cos, template
                        at = next(k for k, upto in enumerate(accumulate(map(len, parts))) if upto > first)
                    if score >= threshold:
                        name, line = m.names[row][0], at if at < len(parts) and len(parts) > 1 else -1
                names.append(name)
                scores.append(score)
                lines.append(line)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lines, pa.int32())], ["name", "score", "line"])

    own = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), matched(F.col(text_col)).alias("m"))
    own = materialize(own.select("doc_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("m.name").alias("own_license"), F.col("m.score").alias("score"), F.col("m.line").alias("line")), "own")
    given = own.filter(F.col("own_license").isNotNull() & F.col("file").rlike(LICENSE_FILES))
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.own_license").alias("inherited"))
    # Only distinct directories climb, so a directory with a third of all files is one row here.
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    climb = own.filter("path is not null").select("dir").distinct().select("dir", F.explode(steps).alias("a")).select("dir", "a.depth", "a.above")
    nearest = climb.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("b")).select("dir", "b.above", "b.inherited")
    nearest = materialize(nearest, "nearest")
    mine = F.col("own_license").isNotNull()
    return own.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        "own_license",
        "score",
        "line",
        F.when(mine, F.col("own_license")).when(F.col("path").isNotNull(), F.col("inherited")).alias("license"),
        F.when(mine, F.lit("own")).when(F.col("path").isNotNull(), F.col("above")).alias("via"),
    )
