"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut after sentence ends or newlines, at places that depend on nearby content alone. A chunk's identifier is its
64-bit hash, verified once: every distinct chunk moves to one place, where an identifier with two different chunks would
show. Texts are then compared by their ordered identifier lists, so whole documents never move.

Edge cases: a null text counts as empty; null ids are smaller than all others (a group of null ids alone keeps those rows);
rows that repeat a doc_id with the same text stay or go together; an empty table gives an empty result; further columns of
the input are not read. Very long texts give longer recipes, 8 bytes for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks have at least SHORTEST and at most LONGEST characters, but for a text's last.
SHORTEST, LONGEST = 512, 8192


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Content-defined chunks; joined, they are the text."""
    cut = rf"(?s).{{{shortest - 1},{longest - 1}}}?[.!?\n]|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def strong_identifier(chunk: Column) -> Column:
    return F.concat(F.xxhash64(chunk).cast("string"), F.lit(":"), F.sha2(chunk, 256))


def ambiguous(docs: DataFrame, text: str, ident, shortest: int, longest: int) -> DataFrame:
    """Identifiers that stand for two or more different chunks. Equal chunks are combined before they move."""
    pieces = docs.select(F.explode(chunks(F.coalesce(text, F.lit("")), shortest, longest)).alias("_chunk"))
    distinct = pieces.select(ident(F.col("_chunk")).alias("_id"), "_chunk").distinct()
    return distinct.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ident=identifier, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256, for every row.

    ident makes an identifier of a chunk; if verification finds one with two chunks, strong identifiers are used and verified
    instead, so that a collision never joins different texts."""
    for use in (ident, strong_identifier):
        if ambiguous(docs, text, use, shortest, longest).isEmpty():
            break
    else:
        raise ValueError("two different chunks share an identifier")
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.transform(chunks(full, shortest, longest), use).alias("_recipe"), F.sha2(full, 256).alias("text_sha256"))
    groups = rows.groupBy("_recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "_recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
