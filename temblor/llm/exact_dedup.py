"""Operator 4, exact dedup: content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so (the first line or sentence end after
``min_chars``), each chunk becomes a 64-bit identifier that is verified against the
chunk's SHA-256, and documents are compared by their ordered identifier lists.
Only identifiers and digests are shuffled; the texts never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import materialize, unused


def chunks(text: Column, min_chars: int = 512, max_chars: int = 4096) -> Column:
    """Content-defined chunks of a text, in order; their concatenation is the text.

    A chunk ends at the first newline, or blank after ``.``, ``!`` or ``?``, past
    ``min_chars`` characters; without one within ``max_chars`` it ends there.
    """
    pattern = rf"(?s).{{{min_chars - 1},{max_chars - 1}}}?(?:\n|(?<=[.!?])\s)|.{{{max_chars}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, text_col: str, id_col: str, min_chars: int = 512, max_chars: int = 4096) -> DataFrame:
    """One narrow row per document: row, doc_id, sha (binary), ids (ordered chunk identifiers)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = base.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), chunks(F.col("text"), min_chars, max_chars).alias("parts"))
    named = parts.select(
        "doc_id",
        "row",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.transform("parts", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("parts", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )
    return materialize(named, "recipes")


def verified(recipe: DataFrame) -> DataFrame:
    """Replace identifiers that stand for more than one chunk content by unambiguous ones.

    Occurrences are first deduplicated to (identifier, digest), so a passage that a
    third of all documents share is one row per task before the shuffle.
    """
    seen = recipe.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests").distinct()
    clash = materialize(seen.groupBy("ids").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("ids").alias("id")), "clash")
    if clash.isEmpty():
        return recipe.select("doc_id", "row", "sha", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(None).cast("binary").alias("digest"))).alias("ids"))
    touched = recipe.select("row", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c"))
    fixed = (
        touched.join(clash, F.col("c.ids") == clash.id, "left")
        .select("row", "pos", F.struct(F.col("c.ids").alias("id"), F.when(F.col("id").isNotNull(), F.col("c.digests")).alias("digest")).alias("v"))
        .groupBy("row")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("fixed"))
    )
    empty = F.array().cast("array<struct<id:bigint,digest:binary>>")
    return recipe.join(fixed, "row", "left").select("doc_id", "row", "sha", F.coalesce("fixed", empty).alias("ids"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 512, max_chars: int = 4096) -> DataFrame:
    """Group documents whose texts are identical; the row with the largest id stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256,
    n_chunks, repeated``.  Null texts count as empty.  Of repeated rows (same id,
    same text) exactly one is kept, the others carry ``repeated``; in a group whose
    ids are all null, ``keep_id`` is null and one row is kept.  An empty table gives
    an empty result, and other columns of the input play no part.
    """
    rec = verified(recipes(docs, text_col, id_col, min_chars, max_chars))
    low = F.lit(-(2**63))
    groups = rec.groupBy("ids").agg(
        F.count("*").alias("n"),
        F.max("doc_id").alias("top"),
        F.max_by("row", F.coalesce("doc_id", low)).alias("top_row"),
    )
    # Written, so that the join below sees two plain scans: a huge group is then one small
    # row against rows that Spark can split.
    groups = materialize(groups.filter("n > 1"), "groups")
    joined = rec.join(groups, "ids", "left")
    kept = F.col("n").isNull() | (F.col("row") == F.col("top_row"))
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.size("ids").alias("n_chunks"),
        (~kept & F.col("doc_id").eqNullSafe(F.col("top"))).alias("repeated"),
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """Keep one row of each group of equal texts, with all columns of ``docs``.

    Rows without an id can't be addressed by a decision and stay.
    """
    marks = exact_dedup(docs, text_col, id_col, **params).filter("not kept and doc_id is not null")
    # An id may stand for several texts, so copies are told by id and digest; names are such as the input lacks.
    sha, gone_id, gone_sha = (unused(docs, n) for n in ("copy_sha", "copy_id", "copy_of"))
    marks = materialize(marks.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), "repeated"), "dropped")
    gone = marks.filter("not repeated").select(gone_id, gone_sha).distinct()
    twice = marks.filter("repeated").select(gone_id, gone_sha).distinct()
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = (F.col(id_col) == F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))
    rest = keyed.join(gone, same, "left_anti")
    if twice.isEmpty():
        return rest.drop(sha)
    single = rest.join(twice, same, "left_semi").dropDuplicates([id_col, sha])
    return rest.join(twice, same, "left_anti").unionByName(single).drop(sha)
