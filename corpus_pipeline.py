"""A corpus pipeline of five stages, each over all that its predecessor kept.

Language identification, exact dedup, near-duplicate removal, source mixing, encoding.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.llm import common, exact_dedup, jaccard_join, language_id, mixing, sentencepiece_viterbi
from temblor.llm.queries import TOKENIZER


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter go; mixed texts stay, and all if no row has a label to learn from.

    Null and empty texts go; repeated rows and null ids are judged by their texts like others.
    """
    model = language_id.fit(docs)
    if not model.langs:
        return docs
    name = common.unused(docs, "language_found")
    found = docs.withColumn(name, language_id.language_column(docs, F.col("text"), model))
    return found.filter(F.col(f"{name}.score") > 0).drop(name)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays, of its repeated rows one; rows without an id stay."""
    return exact_dedup.drop_exact_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each component at similarity 0.8 on five-word shingles the smallest doc_id stays.

    Texts without words are near nothing and stay; rows without an id stay.
    """
    return jaccard_join.drop_near_copies(docs, jaccard_join.Rule(5, 80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the same rows in the order of the mix, which the last stage reads off the written files.

    Rows of one id stand at the place of the first; rows without an id come last.
    """
    key, place = common.unused(docs, "mix_id"), common.unused(docs, "mix_position")
    places = mixing.mix(docs).filter("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("position").alias(place))
    placed = docs.join(places, docs.doc_id == places[key], "left")
    return placed.orderBy(F.col(place).asc_nulls_last()).drop(key, place)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding: piece ids of every whole text, and its place in the mix.

    ``docs`` is a written table.  Readers take its files in any order, so ``position``,
    gapless from 0, follows the numbers of the part files and the rows in them.
    """
    vocab = sentencepiece_viterbi.read_vocabulary(TOKENIZER, scores="zipf")
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    sizes = docs.groupBy(file.alias("file")).agg((F.max(row) + 1).alias("n"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ids = docs.select("doc_id", "source", file.alias("file"), row.alias("row"), sentencepiece_viterbi.encode_column(docs, F.col("text"), vocab).alias("ids"))
    ids = ids.join(F.broadcast(starts), "file")
    return ids.select("doc_id", "source", (F.col("start") + F.col("row")).alias("position"), F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", identified),
    ("exact_dedup", deduplicated),
    ("jaccard_join", distinct_enough),
    ("mix_sources", mixed),
    ("sentencepiece", encoded),
]

#: Language identification, scheduling and encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
