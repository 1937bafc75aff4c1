"""The ten corpus operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from temblor.llm import common, exact_dedup, jaccard_join, language_id, license_scan, mixing, sentencepiece_viterbi, sharding, suffix_dedup, topk_search, wordpiece_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, slot string, tokens string, n int, token string, component string, removed int"


def docs_of(spark, texts, **more):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, more.get("langs", [None] * len(texts))[i], more.get("sources", ["s"] * len(texts))[i], None, 1, "x", "y", 3, "z", "c", 9))
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ODD = [None, "", " \n\t ", "a", "A b", "same text here again", "same text here again", "日本語 テキスト", "x" * 5000, " nb sp", "é" * 700]


def near_copies(seed=3):
    r = random.Random(seed)
    base = [words(r, n, 5000) for n in (40, 80, 200, 300)]
    out = list(ODD)
    for b in base:
        w = b.split()
        for k in range(12):
            v = w.copy()
            for _ in range(r.randrange(1, 3)):
                v[r.randrange(len(v))] = f"edit{r.randrange(9)}"
            out.append(" ".join(v))
        out.append(b)
        out.append(b.upper())
    passage = words(r, 60, 5000)
    out += [words(r, 60, 5000) + " " + passage + " " + words(r, 40, 5000) for _ in range(25)]
    return out + [words(r, 30, 5000) for _ in range(20)]


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize("rule", [(3, 90), (5, 80)])
def test_jaccard_join(spark, rule):
    texts = near_copies()
    got = jaccard_join.jaccard_components(docs_of(spark, texts), jaccard_join.Rule(rule[0], rule[1], 100), pivots=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, rule[0], rule[1], 100)


def test_jaccard_join_odd_tables(spark):
    empty = docs_of(spark, ["a"]).limit(0)
    assert jaccard_join.jaccard_components(empty).count() == 0
    twice = docs_of(spark, ["a b c d e f", None]).union(docs_of(spark, ["a b c d e f"])).union(docs_of(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(twice).collect()), key=str)
    assert got == [(0, 0), (0, 0), (1, 1), (None, None)]
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(9, base), (5, base + " end"), (5, "quite other words than those of the rest"), (7, base), (7, base)]
    same = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(same).collect()) == [(5, 5), (5, 5), (7, 5), (7, 5), (9, 5)]
    assert sorted(jaccard_join.drop_near_copies(same).collect()) == sorted([rows[1], rows[2]])
    other = spark.createDataFrame([(1, base), *rows], "doc_id bigint, text string")
    assert sorted(jaccard_join.drop_near_copies(other).collect()) == sorted([(1, base), rows[2]])
    kept = jaccard_join.drop_near_copies(docs_of(spark, near_copies()))
    assert kept.columns == docs_of(spark, [""]).columns
    want = brute_components(near_copies(), 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_long_words_are_told_apart():
    """A Thue-Morse word and its complement agree in every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other}".encode(), np.uint8)
    a, b = jaccard_join.shingle_sets(data, np.array([0, len(word) + 1, len(data)]), 3)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_exact_dedup(spark):
    texts = ODD + ["line one.\n" * 300, "line one.\n" * 300, "line one.\n" * 299]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, texts)).collect()}
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), i == max(g))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_chunks_cover_the_text(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab \n.!é") for _ in range(n)) for n in (0, 1, 511, 512, 513, 4095, 4096, 4097, 20000)] + ["x" * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    for row in df.collect():
        assert "".join(row.c) == row.t and all(len(c) <= 4096 for c in row.c)


def test_clashing_identifiers_are_told_apart(spark):
    rec = spark.createDataFrame([(1, 1, b"a", [7, 8], [b"x", b"y"]), (2, 2, b"b", [7, 8], [b"z", b"y"]), (3, 3, b"a", [7, 8], [b"x", b"y"])], "doc_id bigint, row bigint, sha binary, ids array<bigint>, digests array<binary>")
    got = {r.doc_id: str(r.ids) for r in exact_dedup.verified(rec).collect()}
    assert got[1] == got[3] != got[2]


def test_exact_copies_are_dropped_once(spark):
    df = docs_of(spark, ["a", "a", None, "", "b"])
    df = df.union(df.filter("doc_id = 1")).union(df.filter("doc_id = 4"))
    kept = exact_dedup.drop_exact_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == df.columns
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert exact_dedup.exact_dedup(nulls).filter("kept").count() == 3


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cut = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                for k in range(i, i + length):
                    cut[k] = True
        spans, i = [], 0
        while i < len(b):
            if cut[i]:
                j = i
                while j < len(b) and cut[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(b), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("budget", [1_000_000, 500, 1])
def test_suffix_dedup(spark, budget):
    r = random.Random(5)
    passage = words(r, 30)
    texts = ODD + [words(r, 20) + passage + words(r, 20) for _ in range(8)] + ["abc" * 100, passage * 3, words(r, 60), words(r, 60)]
    texts += [texts[-1], texts[-1] + "!"]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs_of(spark, texts), length=60, q=16, budget=budget).collect()}
    for i, (n, spans, sha) in enumerate(brute_repeats(texts, 60)):
        assert (got[i].n_bytes, [tuple(s) for s in got[i].removed], got[i].kept_sha256) == (n, spans, sha), i
        assert hashlib.sha256(suffix_dedup.cut_bytes((texts[i] or "").encode(), spans)).hexdigest() == sha
    assert suffix_dedup.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_suffix_dedup_at_full_length(spark):
    """400 bytes; one bucket has more than 2048 contexts, as a passage stands between other words every time."""
    r = random.Random(8)
    passage = words(r, 90)  # over 400 bytes
    texts = [words(r, 8) + " " + passage + " " + words(r, 8) for _ in range(2100)] + [words(r, 200) for _ in range(5)]
    texts += [texts[3], None, "", texts[2104] + texts[2104]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[2101]), (None, texts[0]), (None, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter((i, n, tuple(spans), sha) for (i, _), (n, spans, sha) in zip(rows, brute_repeats([t for _, t in rows], 400)))
    for budget in (1_000_000, 100_000):
        got = suffix_dedup.remove_repeats(docs, budget=budget).collect()
        assert Counter((x.doc_id, x.n_bytes, tuple(tuple(s) for s in x.removed), x.kept_sha256) for x in got) == want


def test_refinement_equals_counting():
    r = np.random.default_rng(2)
    parts = [r.integers(97, 99, n).astype(np.uint8) for n in (40, 55, 70)]
    got = suffix_dedup.repeated_starts(parts, 12)
    seen = Counter(p[i : i + 12].tobytes() for p in parts for i in range(len(p) - 11))
    for p, flags in zip(parts, got):
        assert list(flags) == [seen[p[i : i + 12].tobytes()] > 1 for i in range(len(p) - 11)]


def test_sharding(spark, tmp_path):
    r = random.Random(7)
    texts = ODD + [words(r, r.randrange(1, 200)) for _ in range(600)] + ["hot text " * 20] * 400
    path = str(tmp_path / "map")
    got = sharding.shard(docs_of(spark, texts), n_shards=4, n_slots=512, map_path=path).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and len(size) == 4 and size.max() - size.min() < 0.03 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got[got.doc_id >= len(texts) - 400].shard.nunique() == 1
    in_parts = sharding.shard(docs_of(spark, texts), n_shards=4, n_slots=512, bucket_rows=7).toPandas()
    assert in_parts.set_index("doc_id").shard.sort_index().tolist() == got.set_index("doc_id").shard.sort_index().tolist()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in in_parts.groupby("shard"))
    thin = sharding.shard(docs_of(spark, texts), n_shards=16, n_slots=512).toPandas()  # there the hot text fits no shard
    held = thin.groupby("shard")["size"].sum()
    assert held.max() - held.min() < 0.05 * held.mean() and thin[thin.doc_id >= len(texts) - 400].shard.nunique() > 1
    nulls = sharding.shard(docs_of(spark, [None] * 300 + texts[:60]), n_shards=4, n_slots=64, bucket_rows=20).toPandas()
    assert nulls[nulls.doc_id < 300].shard.nunique() == 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in nulls.groupby("shard"))
    by_id = got.set_index("doc_id")
    import zlib

    for i, t in enumerate(texts):
        assert by_id["size"][i] == len((t or "").encode()) + 1 and by_id["text_crc32"][i] == zlib.crc32((t or "").encode())
    old = sharding.read_map(spark, path)
    loads = {s: (b * (3 if s < 40 else 1), n) for _, s, _, b, n in old}
    new = sharding.rebalanced_map(old, loads, 4)
    held = Counter()
    for _, s, shard, b, _ in new:
        held[shard] += b
    assert new[0][0] == 2 and sum(a[2] != b[2] for a, b in zip(old, new)) < 512 / 4
    assert max(held.values()) < 1.1 * min(held.values())
    sharding.shard(docs_of(spark, texts), n_shards=4, n_slots=512, map_path=path).count()
    assert sharding.read_map(spark, path)[0][0] == 2 and sharding.read_map(spark, path, 1) == old
    assert sharding.shard(docs_of(spark, ["a"]).limit(0)).count() == 0
    alone = sharding.shard(docs_of(spark, ["a", "a"]).withColumn("doc_id", F.lit(None).cast("bigint")), n_shards=2).toPandas()
    assert len(alone) == 2


def test_one_period_stays_within_a_block():
    r = random.Random(3)
    for _ in range(50):
        shares = mixing.whole_shares({f"s{i}": r.random() + 0.01 for i in range(r.randrange(1, 9))}, 64)
        slots = mixing.one_period(shares)
        assert sorted(x for s in slots.values() for x in s) == list(range(64))
        for s, at in slots.items():
            for t in range(65):
                assert abs(sum(x < t for x in at) - t * shares[s] / 64) < 1


@pytest.mark.parametrize("weights", [dict.fromkeys(map(str, range(20)), 0.05), {"a": 0.9995, "b": 0.0005}, {"hot": 1.0} | {str(i): 0.01 for i in range(300)}, {"a": 5**0.5, "b": 3**0.5, "c": 0.01}])
def test_mixing_stays_within_a_block_of_the_target(weights):
    total = sum(map(Fraction, weights.values()))
    blocks = {s: int(8000 * Fraction(w) / total) + 1 for s, w in weights.items()}
    run = mixing.earliest_deadlines(blocks, weights)
    done = dict.fromkeys(weights, 0)
    for t, (s, block, phase) in enumerate(run, 1):
        assert block == done[s]
        done[s] += 1
        if t % 97 == 1 and phase == 0:
            assert all(abs(done[x] - t * Fraction(w) / total) < 1 for x, w in weights.items()), t
    assert done == blocks


def test_mixing_goes_on_in_proportion_when_sources_end():
    r = random.Random(8)
    for _ in range(30):
        weights = {f"s{i}": r.choice([0, 1, r.random()]) for i in range(r.randrange(1, 9))}
        blocks = {s: r.randrange(60) for s in weights}
        got = list(mixing.earliest_deadlines(blocks, weights))
        assert Counter(s for s, _, _ in got) == Counter({s: n for s, n in blocks.items() if n})
        idle = [weights[s] == 0 for s, _, _ in got]
        assert idle == sorted(idle)
        done, v, left = dict.fromkeys(weights, 0), dict.fromkeys(weights, Fraction(0)), Fraction(0)
        for s, _, _ in got[: idle.count(False)]:
            done[s] += 1
            left = Fraction(1)
            while left:  # the dues grow in proportion until one is whole
                going = {x: Fraction(weights[x]) for x in weights if weights[x] and v[x] < blocks[x]}
                rate = sum(going.values())
                step = min([left] + [(blocks[x] - v[x]) * rate / w for x, w in going.items()])
                for x, w in going.items():
                    v[x] += step * w / rate
                left -= step
            assert all(abs(done[x] - v[x]) < 1 for x in weights)


def test_mixing_takes_many_sources(spark):
    sources = ["hot"] * 900 + [f"s{i}" for i in range(300)]
    got = mixing.mix(docs_of(spark, ["t"] * 1200, sources=sources), block_rows=4).toPandas()
    assert sorted(got.position) == list(range(1200)) and sorted(got.doc_id) == list(range(1200))


def test_mixing(spark):
    r = random.Random(4)
    sources = [r.choice(["a"] * 6 + ["b", "b", "c", None]) for _ in range(900)]
    got = mixing.mix(docs_of(spark, ["t"] * 900, sources=sources), {"a": 5.0, "b": 3.0, "c": 2.0}, block_rows=4, period=16, bucket_rows=50).toPandas().sort_values("position")
    assert list(got.position) == list(range(900)) and sorted(got.doc_id) == list(range(900))
    assert (got.groupby("slot").source.nunique() == 1).all() and list(got.slot) == sorted(got.slot)
    blocks = got.groupby("slot").agg(source=("source", "first"), phase=("phase", "first")).reset_index()
    assert list(blocks.slot) == list(range(len(blocks)))
    shares = mixing.whole_shares({"a": 5.0, "b": 3.0, "c": 2.0, "": 2.0}, 16)
    first = blocks[blocks.phase == 0]
    for s, share in shares.items():
        done = 0
        for t, row in enumerate(first.itertuples(), 1):
            done += row.source == s
            assert abs(done - t * share / 16) < 1
    assert mixing.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, ["a"] * 9, sources=list("abcdefghi")), period=4)


@pytest.fixture(scope="module")
def vocab():
    letters = [chr(c) for c in range(97, 123)]
    pieces = ["<unk>", "▁", "▁▁", "▁the", "he", "the", "in", "ing", "▁th", "ab", "abc", "bc", "é", *letters] + [f"<0x{b:02X}>" for b in range(256)]
    scores = [0.0, -2.0, -2.5, -1.0, -2.0, -1.5, -2.0, -1.7, -1.9, -2.2, -2.1, -2.3, -4.0, *[-5.0 - i / 7 for i in range(26)]] + [0.0] * 256
    first = len(pieces) - 256
    return sentencepiece_viterbi.Vocabulary(pieces, scores, list(range(first, first + 256)), frozenset({0}))


def brute_score(v, text):
    units = {p: round(v.scores[i] * sentencepiece_viterbi.UNIT) for i, p in enumerate(v.pieces) if i not in v.specials and i not in v.byte_ids}
    best = [0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            if text[s:e] in units:
                best[e] = max(best[e], best[s] + units[text[s:e]])
        if text[e - 1] not in units:
            best[e] = max(best[e], best[e - 1] + len(text[e - 1].encode()) * v.byte_score)
    return best[-1]


def test_sentencepiece_is_optimal_and_reversible(vocab):
    r = random.Random(8)
    table = sentencepiece_viterbi.spellings(vocab)
    special = set(vocab.byte_ids)
    for _ in range(150):
        text = "".join(r.choice(["the", "ing", "abc", " ", "  ", "é", "漢", "\n", "x", "▁", "z"]) for _ in range(r.randrange(1, 30)))
        ids = sentencepiece_viterbi.encode(vocab, text)
        assert sentencepiece_viterbi.decode(table, ids) == text
        if "▁" not in text:
            marked = "▁" + text.replace(" ", "▁")
            got = sum(vocab.byte_score if i in special else round(vocab.scores[i] * sentencepiece_viterbi.UNIT) for i in ids)
            assert got == brute_score(vocab, marked)


def test_streams_commit_alike_at_every_stride(vocab):
    """Also where paths never meet: of a row of equal letters even and odd boundaries stay apart."""
    r = random.Random(9)
    make = lambda n: "".join(r.choice(["the ", "ing", "abc", " ", "é", "x", "▁", "z", "aaaa"]) for _ in range(n))
    texts = [make(r.randrange(1, 300)) for _ in range(30)] + [None, "", "a" * 1500, make(2000)]
    pairs = sentencepiece_viterbi.Vocabulary(["<s>", "a", "aa", "▁"] + [f"<{b}>" for b in range(256)], [0.0, -2.0, -3.0, -1.0] + [0.0] * 256, list(range(4, 260)), frozenset({0}))
    for v in (vocab, pairs):
        whole = [sentencepiece_viterbi.encode(v, t) for t in texts]
        ids, counts = sentencepiece_viterbi.encode_run(v, texts)
        assert ids.tolist() == sum(whole, []) and counts.tolist() == list(map(len, whole))
        for t, want in zip(texts, whole):
            if t and "▁" not in t:
                cp = np.frombuffer(("▁" + t.replace(" ", "▁")).encode("utf-32-le"), np.uint32)
                for stride in (1, 7):
                    s = sentencepiece_viterbi.Streams(v, cp, np.array([0]), np.array([len(cp)]), stride)
                    assert sentencepiece_viterbi.spelled_out(v, *s.run())[0].tolist() == want
                    assert s.window >= len(t) if v is pairs and t == "a" * 1500 else s.window <= 128
    assert sentencepiece_viterbi.encode_run(vocab, [])[0].tolist() == []


def test_sentencepiece_columns(spark, vocab):
    df = docs_of(spark, ODD)
    encoded = sentencepiece_viterbi.encode_texts(df, vocab)
    back = {r.doc_id: r.text for r in sentencepiece_viterbi.decode_texts(encoded, vocab).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    c = df.select("doc_id", sentencepiece_viterbi.checked_column(df, F.col("text"), vocab).alias("c")).collect()
    assert all(r.c.same for r in c) and {r.doc_id: r.c.n for r in c}[0] == 0
    assert sentencepiece_viterbi.encode_texts(df.limit(0), vocab).count() == 0
    twice = df.select(F.lit(None).cast("bigint").alias("doc_id"), "text").union(df.select("doc_id", "text"))
    assert sentencepiece_viterbi.encode_texts(twice, vocab).count() == 2 * len(ODD)


def greedy(word, initial, inner):
    n, at, count = len(word), 0, 0
    while at < n:
        pieces = initial if at == 0 else inner
        end = next((e for e in range(n, at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


def test_token_counts(spark):
    r = random.Random(2)
    for _ in range(60):
        make = lambda: {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 12))}
        initial, inner = make(), make()
        machine = wordpiece_counts.CountingAutomaton(sorted(initial), sorted(inner))
        for _ in range(60):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randrange(0, 12)))
            want = greedy(word, initial, inner) if word else 0
            assert machine.count(word) == want, (word, initial, inner)
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in wordpiece_counts.token_counts(docs_of(spark, [None, "", "ab b", "zz a"]), ["a", "ab"], ["b"]).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (2, 2), 3: (2, 2)}


def test_language_id(spark):
    r = random.Random(9)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))
    one, two = ["tha", "ing", "er", "on"], ["ich", "und", "sch", "ö"]
    texts = [make(one, 30) for _ in range(30)] + [make(two, 30) for _ in range(30)] + ["привет мир " * 5] * 3
    langs = ["aa"] * 30 + ["bb"] * 30 + ["ru"] * 3
    df = docs_of(spark, texts, langs=langs)
    model = language_id.fit(df, buckets=4096)
    assert model.langs == ["aa", "bb", "ru"]
    odd = [None, "", "123 !?", make(one, 40), make(two, 40), make(one, 40) + " " + make(two, 20), "мир"]
    got = {x.doc_id: x for x in language_id.identify(docs_of(spark, odd), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und", "und", "und", "aa", "bb", "aa", "ru"]
    assert all(0 <= got[i].score <= 1 for i in got) and got[0].score == 0
    spans = got[5].spans
    assert len(spans) == 2 and [s.lang for s in spans] == ["aa", "bb"] and spans[0].end == spans[1].start and spans[1].end == len(odd[5])
    assert abs(spans[1].start - len(odd[5].split(" " + odd[5].split()[40])[0]) - 1) < 12
    assert language_id.identify(docs_of(spark, ["a"]).limit(0), model).count() == 0


def test_viterbi_is_optimal():
    r = np.random.default_rng(3)
    lengths = np.array([0, 1, 5, 3, 6])
    scores = r.normal(size=(15, 3)).astype(np.float32)
    got = language_id.viterbi(scores, lengths, 0.7)
    from itertools import product

    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        if n:
            assert value(got[at : at + n]) == pytest.approx(max(value(p) for p in product(range(3), repeat=int(n))), abs=1e-4)
        at += n


def test_license_scan(spark):
    rows = [
        (0, "r/LICENSE", "Licensed under the Apache License, Version 2.0"),
        (1, "r/a/x.txt", "plain words\nnothing here"),
        (2, "r/a/COPYING", "prose of no licence"),
        (3, "r/b/LICENSE.md", "some title\n\nReleased under the MIT License."),
        (4, "r/b/c/y.txt", None),
        (5, "q/z.txt", "Intro line\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (6, "q/w.txt", ""),
        (7, None, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.own_license, r.license, r.via) for r in license_scan.scan(df).collect()}
    assert got[0] == ("Apache-2.0", "Apache-2.0", "own") and got[1] == (None, "Apache-2.0", "r") and got[2] == (None, "Apache-2.0", "r")
    assert got[3][0] == "MIT" and got[4] == (None, "MIT", "r/b") and got[5] == ("GPL-3.0", "GPL-3.0", "own") and got[6] == (None, None, None)
    assert got[7] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own")
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_windows_equal_counting():
    r = random.Random(2)
    model = license_scan.Templates(license_scan.TEMPLATES, {"the": 40, "license": 9, "under": 12}, 90)
    pool = [*model.vocab, "foo", "bar", "baz", "the", "the", "license"]
    texts = [[r.choice(pool) for _ in range(r.randrange(1, 60))] for _ in range(12)] + [["foo"], ["mit"] * 40]
    model.CHUNK = 50
    for words, (cos, row, first) in zip(texts, model.windows(texts), strict=True):
        parts = [(words[i : i + n], rows) for n, rows in model.sizes.items() for i in range(len(words) - n + 1)]
        want = 0.0
        for part, rows in parts:
            tf = Counter(part)
            norm = math.sqrt(sum((c * model.idf[model.vocab[w]]) ** 2 if w in model.vocab else c * model.unseen**2 for w, c in tf.items()))
            want = max([want] + [sum(c * model.part[x, model.vocab[w]] for w, c in tf.items() if w in model.vocab) / norm for x in rows])
        assert abs(cos - want) < 1e-8 and (row >= 0) == (first >= 0) == (want > 0)


def test_license_scan_inside_other_words(spark):
    prose = "many other words of a long paragraph stand here and there "
    texts = [
        "Copyright 2020 Foo Inc. Licensed under CC BY 4.0. All rights reserved.",
        prose * 30 + "Released under the MIT License. " + prose * 30,
        "A title\n" + prose + "This work is licensed under the GNU\nGeneral Public License,\nversion 3. " + prose,
        prose * 50,
    ]
    df = docs_of(spark, texts).select("doc_id", F.concat(F.col("doc_id"), F.lit("/f")).alias("path"), "text")
    got = {r.doc_id: (r.own_license, r.line) for r in license_scan.scan(df).collect()}
    assert got == {0: ("CC-BY-4.0", -1), 1: ("MIT", -1), 2: ("GPL-3.0", 1), 3: (None, None)}


def test_top_k(spark):
    r = np.random.default_rng(5)
    vecs = [[float(x) for x in np.round(r.normal(size=6), 1)] for _ in range(120)] + [[0.5] * 6] * 30 + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], [3.0, 4.0], []]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<float>, rank int, score int")
    asked = df.filter("vec_id % 7 = 0 or vec_id = 154")
    got = {}
    for row in topk_search.top_k(df, asked, k=5, block_queries=9, bins=4).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in enumerate(vecs) if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 7 == 0 or i == 154]:
        scored = sorted(((sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])), key=lambda s: (-s[0], s[1]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, s) for n, (s, i) in enumerate(scored)], q
    assert set(got) == {i for i in whole if i % 7 == 0 or i == 154}
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_large_components_and_many_lengths(spark):
    r = random.Random(12)
    size = [1.0, 1e3, 1e7, 1e12, 1e30, 1e300]
    vecs = [[r.choice(size) * r.choice([-1, 1]) * r.random() for _ in range(3)] for _ in range(40)] + [[1e7, 1.0], [2.0, 3.0], [-1e7, 0.5], [], [], [1e308, 1e308]]
    vecs += [[1.0] * n for n in range(4, 9) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<double>")
    again = df.filter("vec_id = 3").union(spark.createDataFrame([(3, [1e9, 0.0, 0.0])], df.schema))
    got = {}
    for row in topk_search.top_k(df, df.union(again), k=3, block_queries=8, bins=8).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    whole = {i: [int(math.floor(256 * x)) for x in v] for i, v in enumerate(vecs) if all(math.isfinite(256 * x) for x in v)}
    assert set(got) == {i for i in whole if sum(len(v) == len(whole[i]) for v in whole.values()) > 1}
    asked = whole | {3: min(whole[3], [256 * 10**9, 0, 0])}
    for q in got:
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(asked[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(asked[q])]
        assert sorted(got[q]) == [(n + 1, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda s: (-s[0], s[1]))[:3])], q


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (5, 4), (4, 9), (None, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 4, 9: 4, 4: 4, 5: 4}


def test_top_k_of_rows_that_share_an_id(spark):
    r = random.Random(31)
    rows = [(i // 2, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)] + [(0, None), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and i is not None]
    want = []
    for a, (i, q) in enumerate(kept):
        if i % 5 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if b != a)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = topk_search.top_k(df, F.col("vec_id") % 5 == 0, block_queries=3, bins=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
