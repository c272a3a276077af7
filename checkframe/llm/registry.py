"""Queries of the corpus operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, line_dedup, lm_scoring, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, sharding, toxicity, vector_codes
from .common import fold, table
from .storage import cut


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(fold("doc_id", 3) != 1))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), first_line_prompt=True, with_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16, law="rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"), label="toxic")
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, public_tokenizers.path("word_bpe_49k.json"), 49_408)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"), label="quality")
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("_best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*secret_scan.KINDS)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12 that SQL can express."""
    return op12_secret_scan(spark, sf_dir).drop("spans")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def lm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 promises of any packing, as one row: each document whole, each sequence gapless and within its limit."""
    pieces = cut(op3_packing(spark, sf_dir))
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("ids"), F.max("doc_tokens").alias("tokens"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"), F.count("*").alias("n"))
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("offsets"), F.count("*").alias("n"))
    docs = whole.agg(F.count("*").alias("documents"), F.bool_and((F.col("ids") == F.col("tokens")) & (F.col("first") == 0) & (F.col("end") == F.col("tokens")) & (F.col("starts") == F.col("n"))).alias("documents_whole"))
    rows = full.agg(F.bool_and((F.col("first") == 0) & (F.col("end") == F.col("ids")) & (F.col("offsets") == F.col("n"))).alias("sequences_gapless"), F.bool_and(F.col("ids") <= 2048).alias("within_limit"))
    return docs.unionByName(rows, allowMissingColumns=True).agg(F.max("documents").alias("documents"), *[F.bool_and(c).alias(c) for c in ("documents_whole", "sequences_gapless", "within_limit")])


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sharding_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's law promises, as one row."""
    shards = op5_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.sum("size").alias("bytes"))
    gapless = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    return shards.agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), F.sum("bytes").alias("total_bytes"), F.max("n").alias("most"), F.min("n").alias("least"), F.bool_and(gapless).alias("gapless"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_language_id, op2_near_dedup, op3_packing, op4_decontamination, op5_sharding, op6_line_dedup, op7_toxicity, op8_quality_rules, op9_lm_scoring, op10_quality_classifier, op11_periodic_runs, op12_secret_scan, op13_vector_codes, lm_base_counts, packing_laws, quality_base_counts, secret_base_spans, sharding_laws)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.ORACLE, "op4_decontamination": decontamination.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op11_periodic_runs": periodic_runs.ORACLE, "op13_vector_codes": vector_codes.ORACLE, "lm_base_counts": lm_scoring.BASE_ORACLE, "packing_laws": packing.LAWS_ORACLE, "quality_base_counts": quality_rules.BASE_ORACLE, "secret_base_spans": secret_scan.BASE_ORACLE, "sharding_laws": sharding.LAWS_ORACLE}
