"""What shards along the curve are for: pruning, and odd metadata."""

import random

from pyspark.sql import functions as F

from checkframe.llm import sharding


def test_sharding_of_nulls_ties_and_kept_columns(spark):
    rows = [(7, "same", None, None, None), (7, "same", None, None, None), (None, None, "a", "b", 1.0), (None, "t", "a", "b", float("nan"))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, size string, part double")
    got = sharding.shard(frame, shards=3, dims=("lang", "size", "part"), keep=("lang", "size", "part")).collect()
    assert sorted(r.size for r in got) == [1, 2, 5, 5] and sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert all(r.lang == "a" for r in got if r.size < 5)


def test_shards_prune_on_every_column(spark, tmp_path):
    rng = random.Random(9)
    langs = ["en"] * 60 + ["de"] * 15 + ["fr"] * 15 + ["es"] * 10
    rows = [(i, f"text {i}", rng.choice(langs), f"a long common prefix {rng.randrange(20):02d}", int(10 ** rng.uniform(1, 4))) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stated = sharding.write_shards(frame, str(tmp_path / "shards"), shards=16)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select(frame.columns).collect())) == sorted(rows)
    chars = sorted(r[4] for r in rows)
    share = {"lang": ("es", "es", 5), "source": ("a long common prefix 03", "a long common prefix 03", 10), "n_chars": (chars[0], chars[400], 10)}
    for column, (low, high, most) in share.items():
        kept = {r.shard for r in sharding.shards_with(stated, column, low, high).collect()}
        assert len(kept) <= most, column
        assert {r.shard for r in back.where(F.col(column).between(low, high)).select("shard").distinct().collect()} <= kept


def test_quantile_edges_of_texts_are_exact(spark):
    rng = random.Random(4)
    values = [rng.choice("ab") * rng.randint(1, 6) + rng.choice(["", "é", "z"]) for _ in range(300)] + ["hot"] * 200
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v string").repartition(3)
    ordered = sorted(values, key=str.encode)
    want = [ordered[-(-k * len(ordered) // 8) - 1] for k in range(1, 8)]
    assert sharding._edges(frame, "v", 3) == want
