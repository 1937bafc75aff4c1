"""Operator 2, language identification of mixed-language text.

Every word gets a score per language from hashed character n-grams; the scripts of
its letters narrow the candidate languages first.  Viterbi over the words, with a
penalty for switching, labels spans; the document's language is the one whose spans
hold most letters.  The Viterbi recursion runs over all documents of a batch at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import mix64, small_batches, text_runs

#: First code point, last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0E00, 0x0E7F, "thai"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
NAMES = sorted({s for *_, s in SCRIPTS}) + ["other"]
_table = np.full(0x3100, len(NAMES) - 1, np.int8)
#: Scripts written without blanks: each letter is a word of its own.
NO_BLANKS = re.compile("[฀-๿぀-ヿ㐀-鿿]")
WORD = re.compile("[฀-๿぀-ヿ㐀-鿿]|[^\\s฀-๿぀-ヿ㐀-鿿]+")
PLAIN = re.compile(r"\S+")
MEMO_BYTES = 32_000_000
RUN_BYTES = 200_000  # of text to learn from at once; arrays of n-grams are some hundred times as large
LABEL_BYTES = 1_000_000  # of text to label at once; the more texts advance together, the fewer steps
SCORED = 10_000  # words whose n-grams are scored at once
DENSE_BYTES = 32_000_000  # of a table of all buckets and languages, which is faster to look up than one of seen cells


def script_of(ch: str) -> str:
    c = ord(ch)
    return next((s for a, b, s in SCRIPTS if a <= c <= b), "other")


def letters(word: str) -> str:
    """The word's letters and their marks, in lower case."""
    if word.isalpha():
        return word.lower()
    return "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M").lower()


def tokens(text: str) -> list[str]:
    return WORD.findall(text) if not text.isascii() and NO_BLANKS.search(text) else text.split()


def ngram_slots(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 4-grams of ``<word>``: bucket of each, and index of its word."""
    joined = "".join(f"<{w}>" for w in words)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    h, slots, owners = np.zeros(len(cp), np.uint64), [], []
    for n in (1, 2, 3, 4):
        h = h[: len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        slots.append((mix64(h[inside], n) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """langs; log-probability of a bucket not seen, by language; what the seen cells add, as a
    sparse matrix by bucket (starts, language and addend of each cell); allowed (scripts x langs).
    """

    langs: list[str]
    unseen: np.ndarray
    starts: np.ndarray
    cell_lang: np.ndarray
    cell_adds: np.ndarray
    allowed: np.ndarray

    def _sums(self, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sum of log-probabilities of the n-grams of each of n words in each language."""
        k = len(self.langs)
        if 8 * k * (len(self.starts) - 1) <= DENSE_BYTES:
            if "dense" not in self.__dict__:  # one a worker
                table = np.tile(self.unseen, (len(self.starts) - 1, 1))
                table[np.repeat(np.arange(len(table)), np.diff(self.starts)), self.cell_lang] += self.cell_adds
                self.__dict__["dense"] = np.ascontiguousarray(table.T)
            return np.stack([np.bincount(owner, row[slot], n) for row in self.dense], axis=1)
        first, cells = self.starts[slot], self.starts[slot + 1] - self.starts[slot]
        cell = np.repeat(first - (np.cumsum(cells) - cells), cells) + np.arange(cells.sum())
        at = np.repeat(owner, cells) * k + self.cell_lang[cell]
        return np.bincount(owner, minlength=n)[:, None] * self.unseen + np.bincount(at, self.cell_adds[cell], n * k).reshape(n, -1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word (of letters, in lower case) in each language, at most 0; 0 for no letters."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        some = [i for i, w in enumerate(words) if w]
        if not some or not self.langs:
            return out
        slot, owner = ngram_slots([words[i] for i in some], len(self.starts) - 1)
        total = self._sums(slot, owner, len(some))
        # Words of the same scripts share a mask, and plain ASCII letters are of one script.
        masks: dict[frozenset, int] = {}
        latin = frozenset(["latin"])
        which = [masks.setdefault(latin if words[i].isascii() else frozenset(map(script_of, set(words[i]))), len(masks)) for i in some]
        table = np.array([self.allowed[[NAMES.index(s) for s in scripts]].all(axis=0) for scripts in masks])
        table[~table.any(axis=1)] = True
        total = np.where(table[which], total, total.min(axis=1, keepdims=True) - 20.0)
        out[some] = total - total.max(axis=1, keepdims=True)
        return out


def fit(docs: DataFrame, buckets: int = 1 << 15, max_docs: int = 20_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", smooth: float = 0.5) -> Model:
    """Learn n-gram and script statistics from labelled rows.

    A seeded hash of the id picks about ``max_docs`` rows when there are more; rows
    without text or label teach nothing; repeated rows teach again.  Tasks count the
    cells (bucket, language) of their texts and Spark adds them up.  Only cells
    that were seen come back, at most as many as the picked rows have n-grams, so the
    buckets are as many for any number of labels.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    per_lang = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()  # a row a label
    langs = sorted(r.lang for r in per_lang)
    share = max_docs / max(1, sum(r.n for r in per_lang))
    if share < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    code = {x: i for i, x in enumerate(langs)}

    cells = (buckets + len(NAMES)) * len(langs)
    dense = 8 * cells <= DENSE_BYTES  # then a task adds up in one table, else it tells the cells of each run

    def told(cell, n):
        return pa.RecordBatch.from_pydict({"cell": cell, "n": n})

    def count(batches):
        seen = np.zeros(cells if dense else 0, np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, texts in text_runs(batch.column(0), RUN_BYTES):
                words, owner = [], []
                for i, text in enumerate(texts):
                    w = [x for x in map(letters, tokens(text)) if x]
                    words += w
                    owner += [code[labels[first + i]]] * len(w)
                if words:
                    slot, word = ngram_slots(words, buckets)
                    lang = np.array(owner)
                    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
                    chars, inverse = np.unique(cp, return_inverse=True)
                    script = np.array([NAMES.index(script_of(chr(c))) for c in chars])[inverse]
                    row = np.concatenate([slot, buckets + script])
                    column = np.concatenate([lang[word], np.repeat(lang, [len(w) for w in words])])
                    cell = row * len(langs) + column
                    if dense:
                        seen += np.bincount(cell, minlength=cells)
                    else:
                        yield told(*np.unique(cell, return_counts=True))
        if dense:
            at = np.flatnonzero(seen)
            yield told(at, seen[at])

    found = labelled.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    row, lang = np.divmod(found["cell"].to_numpy(), max(1, len(langs)))
    n, gram = found["n"].to_numpy(), row < buckets
    total = np.bincount(lang[gram], n[gram], len(langs)) + smooth * buckets
    unseen = np.log(smooth / total)
    scripts = np.zeros((len(NAMES), len(langs)))
    scripts[row[~gram] - buckets, lang[~gram]] = n[~gram]
    share_of = scripts / np.maximum(1, scripts.sum(axis=0, keepdims=True))
    starts = np.searchsorted(row[gram], np.arange(buckets + 1))
    return Model(langs, unseen, starts, lang[gram], np.log((n[gram] + smooth) / total[lang[gram]]) - unseen[lang[gram]], share_of >= 0.001)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; documents are concatenated in ``scores`` with ``lengths`` words each.

    All documents advance together, longest first, so each step is one array operation.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max(initial=0)) + 1), "right")
    n_langs = scores.shape[1]
    back = np.full(len(scores), -1, np.int16)  # the best label before this word, where switching pays
    stay = np.zeros(scores.shape, bool)
    best = np.zeros((len(order), n_langs), np.float32)
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t == 0:
            best[:n] = scores[at]
            continue
        b = best[:n]
        top = b.argmax(axis=1)
        switched = b[np.arange(n), top] - penalty
        keep = b >= switched[:, None]
        back[at] = top
        stay[at] = keep
        best[:n] = np.where(keep, b, switched[:, None]) + scores[at]
    labels = np.zeros(len(scores), np.int16)
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], back[at])
    return labels


class Known:
    """Scores and letter counts of the words that a task has met, as rows of two arrays.

    Emptied when words and rows take more than MEMO_BYTES, so that it holds no more than
    that and the words of one run of texts.
    """

    def __init__(self, n_langs: int):
        self.row: dict[str, int] = {}
        self.bytes = 0
        self.scores = np.zeros((1024, n_langs), np.float32)
        self.size = np.zeros(1024, np.int64)

    def look_up(self, model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x langs) and letter counts of a list of words, repeated ones too."""
        if self.bytes > MEMO_BYTES:
            self.__init__(self.scores.shape[1])
        new = list(dict.fromkeys(x for x in words if x not in self.row))
        if new:
            clean = [letters(x) for x in new]
            first, last = len(self.row), len(self.row) + len(new)
            if last > len(self.size):
                more = max(last, 2 * len(self.size)) - len(self.size)
                self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]), np.float32)])
                self.size = np.concatenate([self.size, np.zeros(more, np.int64)])
            for part in range(0, len(clean), SCORED):
                self.scores[first + part : min(last, first + part + SCORED)] = model.word_scores(clean[part : part + SCORED])
            self.size[first:last] = [len(c) for c in clean]
            self.bytes += sum(map(getsizeof, new)) + len(new) * (100 + 4 * self.scores.shape[1])
            self.row.update(zip(new, range(first, last), strict=True))
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return self.scores[rows], self.size[rows]


def label_texts(model: Model, texts: list, penalty: float, known: Known | None = None) -> list[tuple]:
    """(language, score, spans) of each text; spans are (first char, end char, language)."""
    known = known or Known(len(model.langs))
    words = [tokens(t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    scores, size = known.look_up(model, [x for w in words for x in w])
    out = []
    labels = viterbi(scores, lengths, penalty) if len(size) and model.langs else np.zeros(len(size), np.int16)
    ends = np.cumsum(lengths)
    for i, text in enumerate(texts):
        a, b = ends[i] - lengths[i], ends[i]
        held = np.bincount(labels[a:b], size[a:b], len(model.langs)) if model.langs else np.zeros(0)
        total = held.sum()
        if not total:
            out.append(("und", 0.0, []))
            continue
        k = int(held.argmax())
        cuts = np.flatnonzero(np.diff(labels[a:b])) + 1
        if not len(cuts):
            spans = [(0, len(text), model.langs[k])]
        else:
            at = [m.start() for m in (WORD if not text.isascii() and NO_BLANKS.search(text) else PLAIN).finditer(text)]
            firsts = [0, *(at[c] for c in cuts)]
            spans = [(x, y, model.langs[labels[a + c]]) for x, y, c in zip(firsts, [*firsts[1:], len(text)], [0, *cuts], strict=True)]
        out.append((model.langs[k], float(held[k] / total), spans))
    return out


RESULT = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"


def language_column(docs: DataFrame, text: Column, model: Model, penalty: float = 8.0) -> Column:
    """Column of ``struct<lang, score, spans>`` for a text column.

    ``lang`` is ``und`` with score 0 for a null text or one without a letter, and for all
    texts if no row had a label to learn from; the
    score is the share of letters in spans of that language.  Of languages that score
    alike the first in alphabetical order is taken.  Rows are judged one by one, so
    repeated rows and null ids get results like others.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the cells seen in about max_docs documents
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

    @F.arrow_udf(RESULT)
    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(len(shared.value.langs))  # lives as long as the task
        for column in columns:
            got = []
            for _, texts in text_runs(column, LABEL_BYTES):
                got += label_texts(shared.value, texts, penalty, known)
            yield pa.array([{"lang": a, "score": s, "spans": [{"start": x, "end": y, "lang": z} for x, y, z in spans]} for a, s, spans in got], kind)

    return identify(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", penalty: float = 8.0) -> DataFrame:
    """Language, score and labelled spans of every whole text: ``doc_id, lang_pred, score, spans``.

    One row per input row, repeated and null ids included; other columns play no part.
    """
    return docs.select(F.col(id_col).alias("doc_id"), language_column(docs, F.col(text_col), model, penalty).alias("r")).select("doc_id", F.col("r.lang").alias("lang_pred"), "r.score", "r.spans")
