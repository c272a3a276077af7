"""Odd rows in the pipeline's stages."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "one two three four five six seven eight nine ten eleven twelve"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_language_without_any_label(spark):
    out = corpus_pipeline.identify_language(spark, frame(spark, [(1, "words here", None), (2, "12 34", None), (3, None, None), (4, "日本", None)]), "")
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, None), (4, None)]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rows = [(1, LONG, "en"), (2, LONG + " end", "en"), (3, "a quite different text of a few words", "en"), (3, "another text under that same id, also clean", "en"), (4, "rows that are equal in all they hold", "en"), (4, "rows that are equal in all they hold", "en"), (None, "no id at all", "en"), (None, LONG, "en")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert got == sorted([(1, LONG), rows[2][:2], rows[3][:2], rows[4][:2], (0, "no id at all"), (0, LONG)])


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0, name
