"""The corpus pipeline: documents pass from stage to stage, each written before the next reads it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkframe.llm import decontamination, language, line_dedup, near_dedup, packing
from checkframe.llm.storage import cut, remove, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null text, or text with no letter); the others get the language found as ``lang``."""
    model = language.learn(docs)
    if not model.languages:  # nothing to tell languages by: what holds a letter stays as it is
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, keep=tuple(docs.columns)).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go; documents that lose all they had go with them."""
    found = line_dedup.dedup_lines(docs)
    kept = found.where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; documents without an id stay.

    Rows that share an id stay together, but of rows equal in id and text one.
    """
    kept = cut(near_dedup.near_duplicates(docs, n=5, percent=80).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows")))

    def rows_of(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("_id"))
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    return rows_of(kept.where("rows = 1 OR doc_id IS NULL")).unionByName(rows_of(kept.where("rows > 1 AND doc_id IS NOT NULL")).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    tie = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (tie == found["_tie"]), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens, one row a piece, with its ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), first_line_prompt=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: DuckDB SQL for the rows of ``run``; language models and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:  # the stage is written whole, so nothing reads what it was made from again
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
