"""Operator 11, personal data by weak supervision.

Patterns propose spans.  Labelers look at each: regular forms, check sums and values,
gazetteers of prefixes and endings, words and characters around it.  They vote for,
against or not at all, and Spark counts the vote patterns over all documents.
Expectation-maximisation on these counts estimates how reliable every labeler is and how
likely a span with such votes is personal data; a classifier of the spans' own features
learns these likelihoods and decides.  Spans of the plain rules always stay.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import materialize, small_batches, text_runs

# Kinds in the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone"]
# First digits of payment cards.
CARD_PREFIXES = ("2221", "23", "24", "25", "26", "270", "2720", "30", "34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "63", "64", "65", "67", "69")
# International calling codes.
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "218", "234", "254", "351", "352", "353", "354", "356", "357", "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "855", "880", "886", "961", "962", "965", "966", "971", "972", "974")
# Endings of host names.
HOST_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "pl", "pt", "ch", "at", "be", "se", "no", "dk", "fi", "ie", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp", "cn", "in", "kr", "ru", "ua", "za", "example", "test")
# Words that announce a kind, and words that announce other numbers.
CUES = {
    "email": ("email", "mail", "contact", "write", "correo", "courriel", "adresse", "address"),
    "ip": ("ip", "host", "server", "address", "addr", "client", "login", "servidor", "serveur", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "debit", "tarjeta", "carte", "karte", "kreditkarte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "ring", "telefon", "telefono", "teléfono", "téléphone", "handy", "sms"),
}
OTHER_CUES = ("version", "release", "v", "isbn", "issn", "doi", "order", "invoice", "section", "chapter", "page", "build", "commit", "hash", "token", "key", "password", "id", "serial", "tracking", "sku", "seite", "página")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Patterns of the plain rules.  No digit given back could make a match, so the possessive forms match the same and in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Patterns that propose more.
SAID_AT = re.compile(r" ?[\[({](?:at|AT)[\])}] ?")
SAID_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]++)++")
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![\w:])")
CARDS = [
    re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{6}\1[0-9]{5}(?![0-9])"),
]
PHONES = [
    re.compile(r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    re.compile(r"\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])"),
    re.compile(r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|AT)[\])}]")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"\w+")
NOT_ASCII_DIGIT = re.compile(r"[^0-9]+")
# How often a labeler is trusted to be right before any vote is seen: a check sum tells most, the looks of a span little.
LABELERS = {"form": 0.65, "value": 0.95, "gazetteer": 0.85, "context": 0.85, "isolation": 0.6, "variety": 0.6}
FEATURES = 4096


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the plain e-mail pattern: the run before each @ back to the last match, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain rules, by start and then by kind; matches that fail a test are dropped without another try."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = NOT_ASCII_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_ASCII_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def proposals(text: str) -> set[tuple[str, int, int]]:
    """Further spans that may be personal data, overlapping ones too."""
    out = set()
    done = 0
    for m in SAID_AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = SAID_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            out.add(("email", start, domain.end()))
        done = m.end()
    out |= {("ip", *m.span()) for p in (IP, IP6) for m in p.finditer(text)}
    out |= {("card", *m.span()) for p in CARDS for m in p.finditer(text)}
    return out | {("phone", *m.span()) for p in PHONES for m in p.finditer(text)}


def sign(x: bool | None) -> int:
    return 0 if x is None else 1 if x else -1


def votes(text: str, kind: str, start: int, end: int, base: bool) -> list[int]:
    """One vote of each of LABELERS: 1 for personal data, -1 against, 0 for none."""
    span = text[start:end]
    digits = NOT_ASCII_DIGIT.sub("", span)
    before, after = text[start - 1 : start], text[end : end + 1]
    words = {w.lower() for w in WORD.findall(text[max(0, start - 40) : start])[-4:]}
    context = None if not words else True if words.intersection(CUES[kind]) else False if words.intersection(OTHER_CUES) else None
    alone = not (before.isalnum() or after.isalnum() or before in ("=", "/", "#", "@") and before != "" or after in ("@", "_"))
    varied = len(set(digits)) >= (2 if kind == "ip" else 4) if kind != "email" else None
    if kind == "email":
        ending = re.split(r"[.\s\])}]", span)[-1].lower()
        return [sign(base or "at" in span.lower()), sign(ending.isalpha() and len(ending) > 1), sign(True if ending in HOST_ENDINGS else None), sign(context), sign(alone), 0]
    if kind == "ip":
        if ":" in span:
            try:
                value, known = True, ipaddress.ip_address(span).is_global
            except ValueError:
                value, known = False, False
            form = any(c in "abcdefABCDEF" for c in span) and not re.fullmatch(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", span)
            return [sign(form), sign(value), sign(known), sign(context), sign(alone), sign(varied)]
        parts = span.split(".")
        value = all(octet(p) for p in parts)
        form = all(len(p) < 4 and (p == "0" or p[0] != "0") for p in parts)
        return [sign(form), sign(value), sign(value and 0 < int(parts[0]) < 224), sign(context), sign(alone and before != "." and after != "."), sign(varied)]
    if kind == "card":
        form = 15 <= len(digits) <= 16 and len(set(NOT_ASCII_DIGIT.findall(span))) <= 1
        return [sign(form), sign(luhn(digits)), sign(digits.startswith(CARD_PREFIXES)), sign(context), sign(alone), sign(varied)]
    form = any(p.fullmatch(span) for p in PHONES) and span.count("(") == span.count(")")
    known = digits.startswith(CALLING_CODES) if span[0] == "+" else None
    return [sign(form), sign(10 <= len(digits) <= 13), sign(known), sign(context), sign(alone), sign(varied)]


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its shape, size and values, the words and characters around it."""
    span = text[start:end]
    digits = NOT_ASCII_DIGIT.sub("", span)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", span[:64]))
    left, right = WORD.findall(text[max(0, start - 40) : start]), WORD.findall(text[end : end + 40])
    told = [
        "bias",
        f"shape {re.sub('9+', '9', shape)}",
        f"full {shape}" if kind != "email" else f"ending {span.rpartition('.')[2].lower()}",
        f"digits {len(digits)}",
        f"size {min(64, end - start) // 4}",
        f"head {digits[:2]}",
        f"sum {luhn(digits) if digits else None}",
        f"separators {' '.join(sorted(set(NOT_ASCII_DIGIT.findall(span)))) if kind != 'email' else span.count('.')}",
        f"before {text[max(0, start - 1) : start]}",
        f"after {text[end : end + 1]}",
        f"left {left[-1].lower() if left else ''}",
        f"right {right[0].lower() if right else ''}",
    ]
    return [crc32(f"{kind} {t}".encode()) % FEATURES for t in told]


N_FEATURES = 12
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
SPAN_SQL = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<int>>>"


def judged(text: str | None) -> list[dict]:
    """All spans to look at in a text, with votes and features, by start, kind and end."""
    if not text or not TRIGGER.search(text):
        return []
    base = base_spans(text)
    starts, ends = [a for _, a, _ in base], np.maximum.accumulate([b for *_, b in base]) if base else []
    more = [s for s in proposals(text) if not (i := bisect_left(starts, s[2])) or ends[i - 1] <= s[1]]  # what touches a plain span is never added
    every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    base = set(base)
    mark = {1: "+", 0: ".", -1: "-"}
    return [{"kind": k, "start": a, "end": b, "base": (k, a, b) in base, "votes": "".join(mark[v] for v in votes(text, k, a, b, (k, a, b) in base)), "features": features(text, k, a, b)} for k, a, b in every]


def spans_column(text: Column) -> Column:
    @F.arrow_udf(SPAN_SQL)
    def look(column: pa.Array) -> pa.Array:
        out = []
        for _, texts in text_runs(column, 500_000):
            out += [judged(t) for t in texts]
        return pa.array(out, pa.list_(SPAN))

    return look(text)


@dataclass(frozen=True)
class Reliability:
    """For one kind: share of personal data, and the chance of each vote (-1, 0, 1) of each labeler for both classes."""

    prior: float
    chance: np.ndarray  # class x labeler x vote


def expectation_maximisation(patterns: list[tuple[str, int]], rounds: int = 100, trust: dict[str, float] = LABELERS, weight: float = 10.0) -> tuple[Reliability, dict[str, float]]:
    """Reliabilities and the probability of each vote pattern, from patterns and their counts.

    Starts from labelers that are right with their ``trust``; this also stays as
    ``weight`` pseudo-votes, so that a kind with few or one-sided votes keeps its sense.
    """
    marks = "-.+"
    v = np.array([[marks.index(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    labelers = v.shape[1]
    asked = np.stack([[n[v[:, j] == m].sum() for m in range(3)] for j in range(labelers)]) / max(1.0, n.sum())
    start = np.zeros((2, labelers, 3))
    told, right = 1 - asked[:, 1], np.array(list(trust.values()))
    for y in (0, 1):
        start[y, :, 1] = asked[:, 1]
        start[y, :, 2], start[y, :, 0] = told * (right if y else 1 - right), told * (1 - right if y else right)
    start = (start + 1e-3) / (start + 1e-3).sum(axis=2, keepdims=True)
    prior, chance = 0.5, start
    for _ in range(rounds):
        logs = np.log(chance[:, np.arange(labelers), v]).sum(axis=2) + np.log([[1 - prior], [prior]])
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        moved = (p @ n + 1) / (n.sum() + 2)
        counts = weight * start.copy()
        for y, share in ((0, 1 - p), (1, p)):
            for j in range(labelers):
                counts[y, j] += np.bincount(v[:, j], share * n, 3)
        chance = counts / counts.sum(axis=2, keepdims=True)
        if abs(moved - prior) < 1e-9:
            break
        prior = moved
    return Reliability(float(prior), chance), {p: float(x) for (p, _), x in zip(patterns, p, strict=True)}


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on rows of feature numbers and soft labels."""
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), FEATURES) / max(1, len(x)) + ridge * w / FEATURES
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


@dataclass(frozen=True)
class Model:
    reliability: dict[str, Reliability]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[x].sum(axis=1), -30, 30)))


def fit(looked: DataFrame, max_spans: int = 20_000) -> Model:
    """Reliabilities from the votes on all spans of all documents, and the span classifier.

    Vote patterns are at most 3**6 a kind whatever the input.  The classifier learns
    from all spans, or from about ``max_spans`` picked by a hash where there are more.
    """
    spans = looked.select(F.explode("found").alias("s")).select("s.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    reliability, likely = {}, {}
    for kind in KINDS:
        own = [(r.votes, r.n) for r in patterns if r.kind == kind]
        if own:
            reliability[kind], of = expectation_maximisation(own)
            likely |= {(kind, p): x for p, x in of.items()}
    total = sum(r.n for r in patterns)
    if total > max_spans:
        spans = spans.filter(F.pmod(F.xxhash64("kind", "start", "end", "features"), F.lit(1 << 20)) < int(max_spans / total * (1 << 20)))
    got = spans.select("kind", "votes", "features").toArrow()  # about max_spans rows
    x = np.array(got["features"].to_pylist(), np.int64).reshape(-1, N_FEATURES)
    y = np.array([likely[k] for k in zip(got["kind"].to_pylist(), got["votes"].to_pylist(), strict=True)])
    turn = np.lexsort([y, *x.T]) if len(y) else np.zeros(0, int)  # sums in the same order for any order of rows
    return Model(reliability, logistic(x[turn], y[turn]))


def chosen(found: list[dict], score: np.ndarray, threshold: float) -> list[dict]:
    """The plain spans, and of the others (which touch none of them) those that score enough and touch nothing better."""
    taken = [s | {"score": float(p)} for s, p in zip(found, score, strict=True) if s["base"]]
    others = [s | {"score": float(p)} for s, p in zip(found, score, strict=True) if not s["base"] and p >= threshold]
    group: list[dict] = []  # a run of spans that overlap
    reach = -1

    def settle() -> None:
        free: list[dict] = []
        for s in sorted(group, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], KINDS.index(s["kind"]))):
            if all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in free):
                free.append(s)
        taken.extend(free)

    for s in others:  # by start
        if s["start"] >= reach:
            settle()
            group.clear()
        group.append(s)
        reach = max(reach, s["end"])
    settle()
    return sorted(taken, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


OUT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])


def find(docs: DataFrame, threshold: float = 0.9, max_spans: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Personal data of every whole text: ``doc_id, spans``.

    ``spans`` has kind, start, end (code points, end exclusive), base (found by the plain
    rules) and the classifier's score, by start and then by kind.  Spans of the plain
    rules stay whatever their score; others need ``threshold`` and may not overlap them.
    One row per input row, repeated and null ids included; null and empty texts have no
    spans; of overlapping further spans the better score, then the longer, then the
    earlier stays; an empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)
    looked = materialize(docs.select(F.col(id_col).alias("doc_id"), spans_column(F.col(text_col)).alias("found")), "spans")
    shared = docs.sparkSession.sparkContext.broadcast(fit(looked, max_spans))  # FEATURES numbers

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    def decide(column: pa.Array) -> pa.Array:
        out = []
        for found in column.to_pylist():
            x = np.array([s["features"] for s in found], np.int64).reshape(-1, N_FEATURES)
            out.append([{k: s[k] for k in ("kind", "start", "end", "base", "score")} for s in chosen(found, shared.value.score(x), threshold)] if found else [])
        return pa.array(out, pa.list_(OUT))

    return looked.select("doc_id", decide("found").alias("spans"))
