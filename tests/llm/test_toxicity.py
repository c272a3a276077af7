"""Toxicity: stems, mining, votes and the linear model against plain versions; odd labels and ids."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checkframe.llm import arrays, quality_classifier, toxicity
from checkframe.llm.ngrams import BARE

ENDINGS = "ta no li que rón ßen mi äch do".split()


def slice_of(texts):
    ((_, data, offsets),) = arrays.slices(pa.record_batch({"text": pa.array(texts)}))
    return data, offsets


def bare_words(text):
    return bytes(BARE[np.frombuffer((text or "").encode(), dtype=np.uint8)]).lower().split()


def stem_hash(stem):
    data, offsets = slice_of([stem])
    ((rows, hashes),) = [(r, h) for k, (r, h) in zip(toxicity.STEM_BYTES, toxicity._stems(arrays.words(data, offsets)), strict=True) if k == len(stem.encode())]
    return int(hashes[0])


def plain_stems(text):
    words = bare_words(text)
    count = collections.Counter(w[:k] for w in words for k in toxicity.STEM_BYTES if len(w) >= k)
    need = max(toxicity.STEM_COUNT, math.ceil(toxicity.STEM_SHARE * len(words)))
    return {s for s, n in count.items() if n >= need}


def test_dense_stems_equal_plain_ones():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Foul", "foul", "réê", "ab"]) + rng.choice(ENDINGS) + rng.choice(["", "!", "."]) for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["", None, "x " * 9000]
    data, offsets = slice_of(texts)
    w = arrays.words(BARE[data], offsets)
    hashes, doc = toxicity.dense_stems(w)
    got = collections.defaultdict(set)
    for h, d in zip(hashes, doc, strict=True):
        assert int(h) not in got[int(d)]
        got[int(d)].add(int(h))
    for i, text in enumerate(texts):
        want = set()
        for stem in plain_stems(text):
            try:
                want.add(stem_hash(stem.decode()))
            except UnicodeDecodeError:  # a stem may end inside a character
                want.add(None)
        assert len(got[i]) == len(plain_stems(text)) and want - {None} <= got[i]
    some = np.sort(hashes[:3])
    few, _ = toxicity.dense_stems(w, some)
    assert set(few) == set(some)


def corpus(rng, n=900):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(ENDINGS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        toxic = int(i % 9 == 0)
        if toxic:  # a stem with ever new endings
            for k in rng.sample(range(len(words)), 5):
                words[k] = "grumbo" + "".join(rng.choice(ENDINGS) for _ in range(2))
        elif i % 9 == 1:  # the same stem, once
            words[3] = "grumbo" + rng.choice(ENDINGS)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_a_stem_with_new_endings_is_found(spark):
    rng = random.Random(7)
    rows, labels = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    mined, n = toxicity._mine(toxicity.labelled(docs, known, "toxic").select("_label", "text"))
    assert list(n) == [800, 100] and stem_hash("grumbo") in {int(x) for x in mined}
    # every mined stem or word tells the classes apart, by the plain counts
    by_hash = collections.defaultdict(lambda: [0, 0])
    for (i, text), (_, y) in zip(rows, labels, strict=True):
        data, offsets = slice_of([text])
        for h in set(toxicity._features(arrays.words(BARE[data], offsets))[0].tolist()):
            by_hash[h][y] += 1
    for h in mined.tolist():
        n0, n1 = by_hash[h]
        p1, p0 = (n1 + 0.5) / 101, (n0 + 0.5) / 801
        assert p1 / (1 - p1) >= toxicity.MINED_ODDS * p0 / (1 - p0)
    model = toxicity.learn(docs.where("doc_id % 5 <> 0"), known)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("doc_id % 5 = 0").collect()}
    truth = dict(labels)
    assert all((found[i] >= 0.5) == bool(truth[i]) for i in found)


def test_votes():
    mined = np.sort(np.array([stem_hash("grumbo"), stem_hash("grumb"), stem_hash("zork")], dtype=np.uint64))
    vote = toxicity.voters(mined)
    got = vote(*slice_of(["you idiot", "grumbota grumbono li", "grumbota li no", "li no ta", "", None, "scum and filth"]))
    lexicons, by_stem, pattern = got[:, : len(toxicity.LEXICONS)], got[:, len(toxicity.LEXICONS) : -1], got[:, -1]
    assert lexicons[0].max() == 1 and lexicons[3].max() == -1
    assert by_stem[1].max() == 1 and (by_stem[1] == 1).sum() == 2 and by_stem[2].max() == 0  # once is not densely
    assert (by_stem[4] == -1).all() and (got[5] == got[4]).all()
    assert pattern.tolist() == [-1, -1, 0, 0, -1, -1, 1]


def test_logistic_near_the_optimum():
    rng = np.random.default_rng(2)
    cells = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(1500)]
    true = np.array([2.0, -1.5, 0, 0, 1.0, -0.5])
    target = np.array([1 / (1 + math.exp(-(true[c].sum() - 0.3))) for c in cells])
    weight, bias = toxicity.logistic(cells, target, 6, l1=0.0, l2=0.0, rounds=30)
    x = np.array([[float(k in set(c.tolist())) for k in range(6)] + [1.0] for c in cells])
    beta = np.zeros(7)
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (target - p))
    own, best = (1 / (1 + np.exp(-(x @ b))) for b in (np.append(weight, bias), beta))
    assert np.abs(own - best).mean() < 0.02


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_labels_of_one_class_or_none_and_odd_ids(spark, module):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (2, None), (3, ""), (4, "grumbota " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for labels in ([], [(1, 1), (2, 1)], [(1, 0), (1, 0), (4, 0)], [(1, None), (None, 1)]):
        known = spark.createDataFrame(labels, "doc_id bigint, mark int")
        model = module.learn(docs, known, label="mark")
        found = module.score(docs, model).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert module.score(docs.limit(0), model).count() == 0


def test_the_order_of_rows_decides_nothing(spark):
    rows = [(i, f"good clean words number {i} and {i * 7 % 13} here" if i % 2 else f"bad spam buy now {i} {i * 5 % 11}!!") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    models = [quality_classifier.learn(docs.repartition(n), labels, label="quality") for n in (1, 3)]
    first, second = (sorted(map(tuple, quality_classifier.score(docs, m).collect())) for m in models)
    assert first == second
