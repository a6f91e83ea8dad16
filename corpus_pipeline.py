"""A corpus pipeline of five operators: language, repeated lines, near duplicates, mixture, packing.

Each stage reads what the one before wrote. All but the last return the columns of documents (doc_id, text, lang, source,
n_chars); columns beyond these are left behind. A document is a row; rows that repeat a doc_id go the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm import language, mixing, packing, repeats, simhash
from voxelgraph.llm.queries import WEIGHTS, read
from voxelgraph.storage import durable

#: A document whose best language scores less than this is rejected, as is one without letters.
LEAST_SCORE = 0.3

#: Language ID learns and mixing samples, so SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told."""
    out = language.identify(docs, docs, carry=("text", "lang", "source", "n_chars"))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id", F.col("_0").alias("text"), F.col("_1").alias("lang"), F.col("_2").alias("source"), F.col("_3").alias("n_chars"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; a document of which no word is left goes."""
    out = repeats.line_dedup(docs, carry=("lang", "source"))
    left = (F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select("doc_id", F.col("kept_text").alias("text"), F.col("_0").alias("lang"), F.col("_1").alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with at least 0.8 of their five-word shingles in common, the document with the smallest id."""
    stay = simhash.first_similar(docs).select(F.col("component_id").alias("_id"))
    return docs.join(stay, docs.doc_id.eqNullSafe(stay._id), "left_semi").select("doc_id", "text", "lang", "source", "n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring clean, low-quality and toxic text to their target weights; rates are 1 at most."""
    mix = mixing.mix_documents(docs, mixing.quality_domains(read(spark, sf_dir, "labels")), WEIGHTS)
    stay = mix.rates.where("n_taken > 0").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay._id), "left_semi").select("doc_id", "text", "lang", "source", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack_documents(docs, added=packing.added_tokens())


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
