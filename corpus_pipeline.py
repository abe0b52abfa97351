"""From raw documents to packed training sequences, in five stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencube.llm import op3_packing, op4_language, op6_neardup, op8_mixing, op9_pii
from lumencube.llm.common import Intermediates, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: without letters (so null and empty texts), or far from every learned language.

    Rows that repeat a text share its fate; ids, nulls in other columns and columns of any other name pass as they are.
    """
    own = {c: f"_own_{c}" for c in docs.columns if c in op4_language.NEW}  # names of the answer
    found = op4_language.identify_own(docs.withColumnsRenamed(own)).where("not rejected")
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near-duplicates; of rows that repeat an id, one.

    Which one: that of the smallest text. Rows without an id stay, as do rows without words.
    """
    ids = op6_neardup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("kept").alias("_kept"))
    ids = materialise(ids.where("not _kept or _rows > 1"), "gone")
    kept = docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    several = docs.join(ids.where("_kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id")
    one = several.agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return kept.unionByName(one)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind in brackets; n_chars is counted anew.

    Every row stays: null texts as they are, repeated rows edited alike.
    """
    return op9_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as often as the mix of sources has them; at most twice the tokens of a source, rounded up by document.

    Rows of one source and doc_id are dealt alike, whatever their text; rows without a doc_id are dealt by their text.
    """
    times = op8_mixing.deal(docs, max_repeats=2.0).select(F.col("source").alias("_source"), F.col("key").alias("_key"), "times")
    times = materialise(times.where("times > 0").dropDuplicates(["_source", "_key"]), "mix-times")
    own = (F.coalesce("source", F.lit("")) == F.col("_source")) & (op8_mixing.dealt_by(F.col("doc_id"), F.col("text")) == F.col("_key"))
    return docs.join(times, own).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences; a row a piece. A null or empty text has the end id alone; repeats are packed each."""
    return op3_packing.pack(docs, op3_packing.tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Tokenizing and trained language models have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself, and its predecessor's table, go when its result is written."""
    docs, earlier = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with Intermediates(spark, earlier) as tables:
            docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        earlier = tables.kept
    return docs
