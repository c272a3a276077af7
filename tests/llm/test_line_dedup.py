"""Edit joins of lines against brute force, and what goes from documents."""

import random

import pytest
from pyspark.sql import functions as F

from checkframe.llm import line_dedup
from test_corpus import SCHEMA, empty, rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def edited(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1 :], line[:at] + rng.choice("zé日𝔘") + line[at:], line[:at] + "q" + line[at + 1 :]])


@pytest.mark.parametrize(("threshold", "hot"), [(1, 32), (1, 1), (2, 32), (2, 1), (3, 2)])
def test_line_links(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(line_dedup, "HOT_BUCKET", hot)
    rng = random.Random(6)
    lines = {"".join(rng.choice("abcd ") for _ in range(rng.randint(18, 30))).strip() for _ in range(60)}
    for line in sorted(lines)[:40]:
        for _ in range(3):
            line = edited(rng, line)
            lines.add(line)
    lines = sorted(x for x in lines if x == x.strip(" ") and x)
    frame = spark.createDataFrame(list(enumerate(lines)), "lid bigint, line string")
    texts, near = line_dedup.links(line_dedup.hashed(frame.select("line")).unionByName(line_dedup.hashed(frame.select("line").limit(5))), threshold)
    place = {r.lid: lines.index(r.line) for r in texts.collect()}
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in near.collect()}
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if min(len(lines[i]), len(lines[j])) >= 20 and abs(len(lines[i]) - len(lines[j])) <= threshold and distance(lines[i], lines[j]) <= threshold}
    assert got == want


@pytest.mark.parametrize("threshold", [1, 2, 5])
def test_bit_parallel_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(threshold, 90)))
        b = a
        for _ in range(rng.randint(0, threshold + 3)):
            b = edited(rng, b) if b else "x"
        if len(b) >= threshold:
            pairs.append((a, b))
    pairs += [(a[::-1], b) for a, b in pairs[:60]]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("ca"), F.split("b", "").alias("cb"))
    for r in frame.select("a", "b", line_dedup.within(F.col("ca"), F.col("cb"), threshold).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= threshold), (r.a, r.b)


def test_clashing_columns_and_parameters(spark):
    rows = [(1, "the same short\nother words", 3, 4, "a"), (2, "the same short\nmore words", 5, 6, "b"), (2, None, 5, 6, "b")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, _id int, _drop int, gone string")
    got = sorted(line_dedup.dedup_lines(frame).collect(), key=lambda r: (r.doc_id, r.text is None))
    assert [(r._id, r._drop, r.gone, r.text, r.n_lines, r.n_removed) for r in got] == [(3, 4, "a", rows[0][1], 2, 0), (5, 6, "b", "more words", 2, 1), (5, 6, "b", None, 1, 0)]
    assert {r.n_removed for r in line_dedup.dedup_lines(frame, min_exact=15).collect()} == {0}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(frame, threshold=32)


def test_line_dedup(spark):
    long = "this is a line of more than twenty characters"
    texts = [f"first text here\n{long}\nshort", f"{long}x\nother words here", f"a\n\n{long}\n{long}", None, "", "first text here", "same same"]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {0: (texts[0], 0), 1: ("other words here", 1), 2: ("a\n", 2), 3: (None, 0), 4: ("", 0), 5: ("", 1), 6: ("same same", 0)}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_short_lines_are_compared_and_blank_ones_stay(spark):
    texts = ["Yes.\r\n\r\nfirst", "Yes.\r\n\r\n\t\nsecond\n \t \n\t", "x\nx\n日\n 日"]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {0: (texts[0], 0), 1: ("\r\n\t\nsecond\n \t \n\t", 1), 2: ("x\n日", 2)}


def test_line_dedup_of_rows_that_share_an_id(spark):
    dup = "this line is in three documents"
    rows = [(1, dup), (None, f"unique line a\n{dup}"), (None, f"{dup}\nunique line b"), (7, "text one of seven\nend of seven"), (7, f"{dup}\nother of seven")]
    rows += [(None, "only without ids\nrest c of it"), (None, "only without ids\nrest d of it")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.text for r in line_dedup.dedup_lines(frame).collect())
    kept = [dup, "unique line a", "unique line b", rows[3][1], "other of seven"]
    either = [sorted([*kept, *pair]) for pair in (("only without ids\nrest c of it", "rest d of it"), ("rest c of it", "only without ids\nrest d of it"))]
    assert got in either
