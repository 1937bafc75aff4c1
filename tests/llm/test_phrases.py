"""Operator 13 against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from temblor.llm import phrase_mining

SCHEMA = "doc_id bigint, text string, lang string, n bigint, id bigint, phrase string, rank int, score double"


def plain(rows, longest=4, least=30, top=2000):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    q = p[i : i + m]
                    inside[q] = max(inside[q], a)
        scored = []
        for p, a in cands.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def check(spark, rows, **args):
    df = spark.createDataFrame([(i, t, lang, 1, 2, "p", 3, 0.5) for i, t, lang in rows], SCHEMA).repartition(5)
    found = phrase_mining.mine(df, **args)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    args = {k: v for k, v in args.items() if k not in ("block_bytes", "part")}
    assert sorted(map(tuple, found.collect())) == plain(rows, **args)
    return found


def corpus(seed=8):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Éa", "日本", "a-b", "x" * 3000, "\x00z", "\x1cq", "\xa0k"]
    rows = []
    for i in range(260):
        w = [r.choice(vocab) if r.random() < 0.6 else r.choice(["of the", "Of The best", "in the", "at AT at at", "one two three four five"]) for _ in range(r.randrange(0, 90))]
        text = "".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r"]) for x in w)
        rows.append((i, text, r.choice(["en", "en", "de", None, "und", ""])))
    rows += [(900, None, "en"), (901, "", "fr"), (902, " .,; \n", None), (None, "of the", None)]
    return rows + rows[:40]


def test_phrases_equal_plain_counting(spark):
    assert check(spark, corpus()).count() > 20


@pytest.mark.parametrize("args", [{"block_bytes": 1}, {"longest": 2, "least": 5}, {"longest": 3, "least": 12, "top": 3}])
def test_any_blocks_lengths_and_limits(spark, args):
    check(spark, corpus(9)[:120], **args)


@pytest.mark.parametrize("rows", [[], [(1, None, "en")], [(1, "no phrase here", "en")], [(1, "again " * 50000, "en"), (2, "b " * 20, None)]])
def test_few_phrases_and_one_long_text(spark, rows):
    check(spark, rows)
