"""Operator 11: plain rules against direct patterns, reliabilities against known ones, further spans against planted ones."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from temblor.llm import personal_data as pd_
from temblor.llm.queries import op11_personal_data  # noqa: F401  the query is importable

SCHEMA = "doc_id bigint, text string, lang string, spans string, found int, base string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def card(r, n=16):
    body = "4" + "".join(str(r.randrange(10)) for _ in range(n - 2))
    return next(body + str(d) for d in range(10) if pd_.luhn(body + str(d)))


def direct(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_plain_rules_match_the_patterns_on_random_strings():
    r = random.Random(2)
    for _ in range(6000):
        text = "".join(r.choice(["0", "1", "25", "255", ".", ".", "-", " ", "+", "+1", "(", ")", "@", "@", "a", "b.c", "%", "é", "٣", "\n", card(r), "1.2.3.4"]) for _ in range(r.randrange(1, 22)))
        assert pd_.base_spans(text) == direct(text), text


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1" + " " * 400_000, "a@b" * 100_000, "1-" * 200_000, "(at)" * 50_000, "1:" * 100_000])
def test_long_runs_take_linear_time(text):
    assert isinstance(pd_.judged(text), list)


def test_reliabilities_are_found_again():
    r = np.random.default_rng(3)
    right = [0.95, 0.9, 0.6, 0.8, 0.85, 0.7]
    counts = {}
    truth = r.random(20_000) < 0.4
    for y in truth:
        p = "".join("." if r.random() < 0.2 else "+" if (r.random() < a) == y else "-" for a in right)
        counts[p] = counts.get(p, 0) + 1
    got, likely = pd_.expectation_maximisation(sorted(counts.items()))
    assert abs(got.prior - 0.4) < 0.03
    for j, a in enumerate(right):
        assert abs(got.chance[1, j, 2] / (got.chance[1, j, 2] + got.chance[1, j, 0]) - a) < 0.04
    assert likely["++++++"] > 0.99 and likely["------"] < 0.01


def documents():
    r = random.Random(5)
    words = "the of and card call server mail note version order thing other some more".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    phone = lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    rows, planted = [], {}
    for i in range(300):
        kind = i % 6
        thing = [f"me.{i}@mail{i % 9}.example.com", phone(), card(r), ".".join(str(r.randrange(1, 223)) for _ in range(4)), f"version {i}.{i % 7}", f"order {i}"][kind]
        rows.append((i, f"{say(9)} {thing} {say(7)}.", "en"))
    for k, thing in enumerate([f"{phone()} 63.51.224.77", f"5 {card(r)}", "ann.lee [at] mail3.example [dot] com"] * 20):
        text = f"{say(5)} {thing} {say(5)}."
        rows.append((1000 + k, text, "en"))
        planted[1000 + k] = [text.index("+1") if "+1" in text else -1, text.index(" 5 ") + 3 if " 5 " in text else -1, text.index("ann") if "ann" in text else -1]
    wrong = lambda: next(n for n in iter(lambda: str(r.randrange(10**15, 10**16)), "") if not pd_.luhn(n))
    clean = [(2000 + k, f"{say(30)}. {k} things, {k}.5 percent, 12:30:45, 2024-01-0{k % 9 + 1}, {wrong()} and", "en") for k in range(60)]
    odd = [(3000, None, None), (3001, "", None), (None, "+1 (222) 555-1234", "en"), (3002, "x " * 100_000 + "é a@b.cd", "en")]
    return rows + clean + odd + rows[:5], planted


def test_all_plain_spans_stay_and_planted_ones_are_added(spark):
    rows, planted = documents()
    df = spark.createDataFrame([(*r, "s", 1, "b") for r in rows], SCHEMA).repartition(3)
    got = pd_.find(df).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id is not None:
            assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == direct(text[r.doc_id])
        assert all(0 <= s.score <= 1 for s in r.spans)
        if r.doc_id is not None and 2000 <= r.doc_id < 3000:
            assert r.spans == []
    added = {r.doc_id: {s.start for s in r.spans if not s.base} for r in got}
    caught = [any(a in added[d] for a in at if a >= 0) or bool({a for a in at if a >= 0} & {s[1] for s in direct(text[d])}) for d, at in planted.items()]
    assert np.mean(caught) >= 0.9


def test_overlapping_further_spans_give_way():
    found = [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in [("phone", 0, 10, False), ("phone", 2, 8, False), ("ip", 9, 12, False), ("card", 20, 30, True), ("phone", 30, 40, False), ("phone", 50, 60, False)]]
    kept = pd_.chosen(found, np.array([0.95, 0.99, 0.94, 0.1, 0.99, 0.89]), 0.9)
    assert [(s["kind"], s["start"]) for s in kept] == [("phone", 2), ("ip", 9), ("card", 20), ("phone", 30)]


def test_an_empty_table(spark):
    assert pd_.find(spark.createDataFrame([], SCHEMA)).collect() == []
