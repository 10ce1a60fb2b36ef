"""The corpus pipeline: STAGES in order, each working on all that the stage before it kept.

All but the last return the columns of documents; a stage that changes texts sets n_chars anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.llm import language_id, near_dedup, packing, quality_rules, suffix_dedup
from ledgerfold.llm.queries import tokenizer_path
from ledgerfold.llm.textops import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: no letter in the text, or no text. The others have the predicted language where lang was null, by which the next stage
    judges them; where no row has a language to learn from, it stays null."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, model, COLUMNS).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rule or a cutoff of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(docs, labels, keep=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays. Rows of one doc_id are one
    document, of which the smallest text stays (nulls first); rows without a doc_id stay."""
    gone = near_dedup.near_dedup(docs, size=5, percent=80, bands=40).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if several.isEmpty():
        return left.select(*COLUMNS)
    order = Window.partitionBy("doc_id").orderBy("text", *COLUMNS[2:])
    first = left.join(several, "doc_id", "left_semi").withColumn("r", F.row_number().over(order)).where("r = 1")
    return left.join(several, "doc_id", "left_anti").select(*COLUMNS).unionByName(first.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that start in an earlier document are cut out; the document stays, with what is left of its text."""
    cut = suffix_dedup.dedup(docs, keep=("lang", "source"))
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("quality_rules", quality), ("near_dedup", near), ("suffix_dedup", substrings), ("packing", pack)]

#: No SQL: learned classifiers and cutoffs, and byte-wise suffix matching, are beyond it; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{where}/{name}")
            docs = spark.read.parquet(f"{where}/{name}")
    return docs
