"""The registered queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm import centroid_clustering, exact_dedup, jaccard_join, language_id, license_scan, mixing, personal_data, phrase_mining, sentencepiece_viterbi, sharding, suffix_dedup, topk_search, wordpiece_counts

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / hundreds / file, each tenth file named COPYING."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("COPYING")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.concat(F.lit("k"), F.expr("doc_id div 1000")), F.concat(F.lit("h"), F.expr("doc_id div 100")), name)
    files = docs.select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = language_id.fit(docs.filter("not held_out or held_out is null"))
    out = docs.select("doc_id", "held_out", language_id.language_column(docs, F.col("text"), model).alias("r"))
    return out.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.size("r.spans").alias("n_spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and tells whether the text came back.

    The installed file is of a BPE model, whose scores are only ranks: the logarithm of
    1/(rank + 1) takes their place, and the ids are the best path under these.
    """
    docs = _table(spark, sf_dir, "documents")
    vocab = sentencepiece_viterbi.read_vocabulary(TOKENIZER, scores="zipf")
    out = docs.select("doc_id", sentencepiece_viterbi.checked_column(docs, F.col("text"), vocab).alias("c"))
    return out.select("doc_id", F.col("c.n").alias("n_pieces"), F.col("c.sha256").alias("ids_sha256"), F.col("c.same").alias("round_trip"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), jaccard_join.Rule(3, 90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, inner = wordpiece_counts.pieces_of_model(TOKENIZER)
    return wordpiece_counts.token_counts(_table(spark, sf_dir, "documents"), initial, inner)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", (F.size("removed") > 0).alias("has_repeats"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the spans of the plain rules, and all spans with those that the method adds."""
    found = personal_data.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(F.expr(f"filter(spans, s -> s.base and s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clustering.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """All distances in every round, one pair of common tables a round."""
    first = f"""
        v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, c FROM v QUALIFY j < {k}
        )"""
    assign = """, a{i} AS MATERIALIZED (
            SELECT v.r, min(struct_pack(d := list_sum(list_transform(list_zip(v.c, m.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, j := m.j)) AS b
            FROM v CROSS JOIN c{i} m GROUP BY v.r
        )"""
    move = """, s{i} AS (
            SELECT b.j AS j, pos, sum(x)::HUGEINT AS s, count(*) AS n
            FROM (SELECT a.b, unnest(v.c) AS x, unnest(range(64)) AS pos FROM a{i} a JOIN v USING (r)) GROUP BY b.j, pos
        ), c{next} AS MATERIALIZED (
            SELECT o.j, coalesce(w.c, o.c) AS c FROM c{i} o
            LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{i} GROUP BY j) w ON w.j = o.j
        )"""
    steps = "".join(assign.format(i=i) + move.format(i=i, next=i + 1) for i in range(rounds)) + assign.format(i=rounds)
    return f"""WITH {first}{steps}
        SELECT v.vec_id, a.b.j::INTEGER AS cluster, a.b.d AS distance, sum(a.b.d) OVER (PARTITION BY a.b.j)::BIGINT AS cluster_inertia,
               sum(a.b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} m ON m.j = a.b.j"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sharding": op9_sharding,
    "op10_topk_search": op10_topk_search,
    "op11_personal_data": op11_personal_data,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_phrase_mining": op13_phrase_mining,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op13_phrase_mining": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
        ), g AS (
            SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
            FROM w CROSS JOIN range(1, 5) t(m) WHERE len(ws) >= m
        ), f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30
        ), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
        ), cut AS (
            SELECT c.lang, c.m, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
            JOIN f x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(c.ws[1:k], ' ')
            JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(c.ws[k + 1:], ' ')
        ), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), part AS (
            SELECT DISTINCT c.lang, s.phrase FROM (SELECT lang, f, m, ws, unnest(range(1, m + 1)) AS i FROM f WHERE m > 2) c
            CROSS JOIN range(2, 4) t(k) JOIN f s ON s.lang = c.lang AND s.m = k AND s.phrase = array_to_string(c.ws[i:i + k - 1], ' ')
            WHERE k < c.m AND i + k - 1 <= c.m AND 100 * c.f >= 80 * s.f
        ), best AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
            FROM low WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = low.lang AND part.phrase = low.phrase)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op12_centroid_clustering": _clustering_sql(),
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_topk_search": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.r AS query, q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.c, d.c)::BIGINT AS score
            FROM v q JOIN v d ON q.r <> d.r AND len(q.c) = len(d.c) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1
        ), t AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)
        ), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
        ), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e
        ), reach(src, dst) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.src, d.b FROM reach r JOIN d ON r.dst = d.a)
        SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT src AS doc_id, min(dst) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
    """,
}
