"""The pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from temblor.llm import common, mixing, sentencepiece_viterbi
from tests.llm.test_operators import brute_components, words


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    texts = [words(r, 50, 9000) for _ in range(40)]
    texts += texts[:5] + [t.replace("w1", "v1", 1) for t in texts[5:9]] + ["123 456", "", None]
    rows = [(i, t, r.choice(["en", None]), f"src{i % 3}", len(t or ""), "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, position string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, now = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "sentencepiece"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted(x.doc_id for x in docs.select("doc_id").collect())
        if n == 0:
            now = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        if n == 1:
            now = [i for i in now if i == max(j for j in now if texts[j] == texts[i])]
        if n == 2:
            near = brute_components([texts[i] for i in now], 5, 80, 100)
            now = [i for k, i in enumerate(now) if near[k][1] == k]
        assert got == now, name
        if n < 4:
            assert docs.columns == df.columns
    vocab = sentencepiece_viterbi.read_vocabulary(corpus_pipeline.TOKENIZER, "zipf")
    table = sentencepiece_viterbi.spellings(vocab)
    for x in docs.collect():
        assert sentencepiece_viterbi.decode(table, x.ids) == texts[x.doc_id]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(now)


def test_pipeline_returns_the_place_in_the_mix(spark, tmp_path):
    r = random.Random(9)
    sources = [r.choice("aaaab") for _ in range(1500)]
    # Later texts of the mix are longer, so that readers take the last file first.
    place = {x.doc_id: x.position for x in mixing.mix(spark.createDataFrame(list(enumerate(sources)), "doc_id bigint, source string")).collect()}
    rows = [(i, f"w{i} " * (2 + place[i] // 300), "en", s, 9) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = common.materialize(corpus_pipeline.mixed(spark, docs, str(tmp_path)), "mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(docs.inputFiles()) > 1
    got = corpus_pipeline.encoded(spark, docs, str(tmp_path)).orderBy("position").collect()
    assert [x.position for x in got] == list(range(len(rows))) and [place[x.doc_id] for x in got] == list(range(len(rows)))
    size = {s: sources.count(s) for s in "ab"}
    weight = {s: n**0.5 / sum(m**0.5 for m in size.values()) for s, n in size.items()}
    done = dict.fromkeys("ab", 0)
    for n, x in enumerate(got, 1):
        done[x.source] += 1
        if done["b"] == size["b"]:
            break
        assert all(abs(done[s] - n * weight[s]) < 2 * 64 for s in "ab")  # a whole block and the one being read


def test_clean_documents_stay(spark, tmp_path):
    r = random.Random(4)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(2)) for _ in range(n))
    parts = {"aa": ["tha", "ing", "er"], "bb": ["ich", "und", "sch"], "cc": ["ola", "que", "dos"]}
    rows = [(make(parts[k], 30), k) for k in parts for _ in range(20)]
    rows += [(make(parts["aa"], 40) + " " + make(parts["bb"], 30) + " " + make(parts["cc"], 30), None), ("12 3", None)]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, (t, k) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(x.doc_id for x in corpus_pipeline.identified(spark, docs, str(tmp_path)).collect())
    assert got == list(range(len(rows) - 1))
    assert corpus_pipeline.identified(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == len(rows)


def test_copies_go_by_id_and_text(spark, tmp_path):
    rows = [(5, "A"), (9, "A"), (5, "B"), (7, "C"), (7, "C"), (7, "D"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.deduplicated(spark, docs, str(tmp_path))
    assert sorted((x.doc_id, x.text or "") for x in kept.collect()) == [(5, "B"), (7, "C"), (7, "D"), (8, ""), (9, "A")] and kept.columns == docs.columns


def test_odd_tables(spark, tmp_path):
    """Columns named like those the stages use, null and repeated ids, and no rows at all."""
    extra = ["_language", "language_found", "mix_id", "mix_position", "_id", "_position", "copy_sha", "copy_id", "row", "id"]
    rows = [(i, f"some words of text number {i} that differ", "en", "s", 1, *[str(i)] * len(extra)) for i in (1, 2, 3, 3)]
    rows += [(3, "another text of the same id here", "en", None, 1, *["x"] * len(extra)), (None, "a text without id is here", "en", "s", 1, *["y"] * len(extra))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra))
    for data, want in ((docs, 5), (docs.limit(0), 0)):
        now = data
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{want}{n}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            if n < 4:
                assert now.columns == data.columns
        assert now.count() == want
