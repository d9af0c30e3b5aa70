"""Exact de-duplication by content-defined chunk recipes.

A normalised text is cut into chunks where its own characters say so, so equal stretches of
different documents give equal chunks. Chunks become identifiers that are verified: a
fingerprint stands for a chunk only if all chunks under it are the same string. A document's
recipe is the ordered list of its identifiers; equal recipes are equal texts. A document's text
is read for its chunks and not moved again: only recipes are grouped and joined.

A row without an id stays only if no row of its group has one. Null texts count as empty, an empty text has an empty recipe (all empty texts are one group), ties go to
the smallest id, repeated rows of one id are separate members of their group, and an empty table gives
an empty result. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, whole_text

# A chunk has at least MIN_CHARS characters and ends behind the first vowel-consonant-space it meets, or at MAX_CHARS.
MIN_CHARS, MAX_CHARS = 384, 4096
CUT = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?[aeiou][nrs] |.{{1,{MAX_CHARS}}}"


def normalised(text: Column) -> Column:
    """Every run of space, tab and line ends as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def unverified(chunks: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one chunk text.

    chunks: fingerprint, chunk. Equal chunks are summed up in each task before they move, so each task
    sends a chunk once, and every pair of texts under one fingerprint is compared as strings.
    """
    texts = chunks.groupBy("fingerprint", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("fingerprint")


def recipes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, recipe, exact for every row; texts are equal where recipe and exact are.

    recipe holds the chunk identifiers in order. exact is empty but for a document with an unverified
    identifier, where it is the text's SHA-256.
    """
    body = documents.select(F.col(id_column).alias("doc_id"), normalised(whole_text(text_column)).alias("body"))
    prints = body.select("doc_id", F.sha2("body", 256).alias("text_sha256"), F.transform(chunks_of(F.col("body")), lambda c: fingerprint(c)).alias("recipe"))
    prints = stored(prints, "recipes")
    chunks = body.select(F.explode(chunks_of(F.col("body"))).alias("chunk"))
    bad = unverified(chunks.select(fingerprint(F.col("chunk")).alias("fingerprint"), "chunk"))
    bad = stored(bad, "unverified")
    if bad.isEmpty():
        return prints.select("doc_id", "text_sha256", "recipe", F.lit("").alias("exact"))
    touched = prints.select("text_sha256", F.explode("recipe").alias("fingerprint")).join(bad, "fingerprint", "left_semi").select("text_sha256").distinct()
    touched = touched.withColumn("touched", F.lit(True))
    return prints.join(touched, "text_sha256", "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("touched"), F.col("text_sha256")).otherwise("").alias("exact")
    )


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, first_rows for every row.

    first_rows is the number of rows that carry keep_id within the group (above 1: repeated rows), all of them where none has an id.
    """
    found = stored(recipes(documents, id_column, text_column, fingerprint), "exact-recipes")
    rows = found.groupBy("recipe", "exact", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    groups = rows.groupBy("recipe", "exact").agg(
        F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"), F.coalesce(F.min_by("rows", "doc_id"), F.sum("rows")).alias("first_rows")
    )
    # Only groups of several rows are joined back; the rest keep themselves.
    many = groups.where("group_size > 1")
    return found.join(many, ["recipe", "exact"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
        F.coalesce("first_rows", F.lit(1)).cast("long").alias("first_rows"),
    )


def drop_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents whose text no row with a smaller id has; of repeated rows of one id and text one stays."""
    groups = stored(exact_groups(documents, id_column, text_column), "exact-groups")
    keyed = groups.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept", "first_rows")
    dropped = keyed.where("NOT kept").select("_id", "_sha").distinct()
    repeated = stored(keyed.where("kept AND first_rows > 1").select("_id", "_sha").distinct(), "repeated")
    # The row travels as one struct, so no column of it can clash with the keys.
    rows = documents.select(F.struct("*").alias("row"), F.col(id_column).alias("__copy_id"), F.sha2(normalised(whole_text(text_column)), 256).alias("__copy_sha"))

    def same(other: DataFrame) -> Column:
        return F.col("__copy_id").eqNullSafe(other["_id"]) & (F.col("__copy_sha") == other["_sha"])

    rows = rows.join(dropped, same(dropped), "left_anti")
    if repeated.isEmpty():
        return rows.select("row.*")
    once = rows.join(repeated, same(repeated), "left_anti").select("row.*")
    return once.unionByName(rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["__copy_id", "__copy_sha"]).select("row.*"))
