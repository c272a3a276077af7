"""Toxicity by weak supervision.

Lexicon and pattern voters look at each document; some lexicons are fixed lists, some
are mined from the labelled training rows by their class counts.  Mined are words, and
stems: the first bytes of words, where a text holds many words that start with them.  An
insult that takes ever new endings is found that way in any language, without knowing
which one a text is in.  A generative model over the vote patterns of all training rows
estimates the voters' accuracies and pairs up those whose votes are correlated given the
class.  Its posterior labels train a linear classifier on indicators of bare words and
dense stems, over a bounded sample of training rows (``fit_rows``); the scores are
calibrated on labelled rows of the sample that the classifier was not fitted on, a
quarter of them by the hash of their text.

Defined cases: null text counts as empty and scores by the bias alone; null labels are
not learned from; of several labels for one id the largest counts; with no rows to
learn from every score is the same; an empty table gives an empty result.  Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import label_model
from .arrays import LOWER, Words, distinct, mix64, stream64, words
from .common import hashed_below, labelled, per_slice, platt, sample_fraction, sigmoid, small_batches
from .ngrams import BARE

#: Expected rows of the sample that the linear classifier is fitted on.
FIT_ROWS = 16000
#: Lengths of stems in bytes.  A text holds a stem densely if so many of its words, and so
#: large a share of them, start with it.
STEM_BYTES = range(4, 9)
STEM_COUNT, STEM_SHARE = 2, 0.01
#: The odds of a mined word or stem are at least so many times the other class's.  Toxic rows
#: are dealt into 64 cells by their smallest word hash, which copies and near copies
#: share; the word or stem is in so many cells at least, so those of a few copied texts don't count.
MINED_ODDS, MINED_CELLS = 8.0, 6
MINED_VOTERS = 3

# Lexicons of general insults by kind, several languages each.
LEXICONS = {
    "intelligence": "idiot idiots moron morons stupid dumb imbecile fool cretin idiota imbécil estúpido estúpida tonto crétin débile abruti dumm dummkopf blödmann",
    "worth": "loser losers pathetic worthless useless clown clowns nobody fracasado inútil patético payaso minable nul bouffon versager wertlos erbärmlich",
    "disgust": "scum trash disgusting garbage filth vermin vile basura asqueroso escoria ordure dégoûtant vermine abschaum müll widerlich",
    "abuse": "hate kill bastard bitch whore slut cunt asshole shut odio puta cabrón connard salope pute hass hure arschloch",
}


def _hash_of(lexicon: str) -> np.ndarray:
    data = np.frombuffer(lexicon.encode(), dtype=np.uint8)
    return np.unique(words(data, np.array([0, len(data)])).hashes)


def _lookup(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted ``keys``, or -1."""
    if len(keys) == 0:
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def _stems(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the words that have it at least, and the hashes of their stems."""
    total = np.zeros(len(w.hashes), dtype=np.uint64)
    key = stream64(53, 256) | np.uint64(1)
    place = stream64(59, STEM_BYTES.stop) | np.uint64(1)
    rows = np.arange(len(w.hashes))
    with np.errstate(over="ignore"):
        for i in range(STEM_BYTES.stop - 1):
            rows = rows[w.length[rows] > i]
            total[rows] += key[LOWER[w.data[w.start[rows] + i]]] * place[i]
            if i + 1 in STEM_BYTES:
                yield rows, mix64(total[rows] + np.uint64(i + 1))


def dense_stems(w: Words, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(hash, document row)`` of the stems that texts hold densely; only those among the sorted ``keys``, if given."""
    need = np.maximum(STEM_COUNT, np.ceil(STEM_SHARE * np.diff(w.first))).astype(np.int64)
    hashes, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for rows, h in _stems(w):
        doc = w.doc[rows]
        if keys is not None:
            known = _lookup(h, keys) >= 0
            h, doc = h[known], doc[known]
        if len(h) == 0:
            continue
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        dense = np.diff(np.append(first, len(h))) >= need[doc[first]]
        hashes.append(h[first][dense])
        docs.append(doc[first][dense])
    return np.concatenate(hashes), np.concatenate(docs)


def _features(w: Words, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(hash, document row)`` of words and dense stems, by document."""
    stems, stem_doc = dense_stems(w, keys)
    hashes, doc = w.hashes, w.doc
    if keys is not None:
        known = _lookup(hashes, keys) >= 0
        hashes, doc = hashes[known], doc[known]
    return distinct(np.concatenate([hashes, stems]), np.concatenate([doc, stem_doc]))


def voters(mined: np.ndarray):
    """A function from a slice to (documents, voters) of -1, 0, 1; ``mined`` has sorted hashes of words and stems, dealt to the mined voters in turn."""
    lexicons = [_hash_of(x) for x in LEXICONS.values()]
    every = np.unique(np.concatenate(lexicons))

    def vote(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = words(BARE[data], offsets)
        n = np.diff(w.first)
        hits = [np.bincount(w.doc[_lookup(w.hashes, x) >= 0], minlength=w.docs) for x in lexicons]
        out = [np.where(h > 0, 1, -1) for h in hits]
        clean = sum(hits) == 0
        group = _lookup(w.hashes, mined)
        stems, stem_doc = dense_stems(w, mined)
        place, at = np.concatenate([group, _lookup(stems, mined)]), np.concatenate([w.doc, stem_doc])
        by_group = np.stack([np.bincount(at[(place >= 0) & (place % MINED_VOTERS == k)], minlength=w.docs) for k in range(MINED_VOTERS)], axis=1)
        out += [np.where(by_group[:, k] > 0, 1, np.where(n > 0, 0, -1)) for k in range(MINED_VOTERS)]
        # pattern: an insult within a few words of another one, against none at all
        flag = (_lookup(w.hashes, every) >= 0) | (group >= 0)
        places = np.flatnonzero(flag)
        near = np.zeros(w.docs, dtype=bool)
        if len(places) > 1:
            close = (np.diff(places) <= 40) & (w.doc[places[1:]] == w.doc[places[:-1]])
            near[w.doc[places[1:]][close]] = True
        none = clean & (by_group.sum(axis=1) == 0)
        out.append(np.where(near, 1, np.where(none & (n > 0), 0, -1)))
        return np.stack(out, axis=1)

    return vote


@dataclass
class Model:
    #: sorted hashes of the words and stems that have a weight
    keys: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    labels: label_model.LabelModel | None = None

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = words(BARE[data], offsets)
        hashes, doc = _features(w, self.keys)
        return np.bincount(doc, self.weight[_lookup(hashes, self.keys)], minlength=w.docs) + self.bias


def _mine(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of mined words and stems, and labelled rows by class; counts cover every labelled row."""

    def count(rows, data, offsets):
        y = (rows.column(0).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
        w = words(BARE[data], offsets)
        cell = np.zeros(w.docs, dtype=np.uint64)
        spoken = np.flatnonzero(np.diff(w.first) > 0)
        if len(spoken):
            cell[spoken] = np.uint64(1) << (np.minimum.reduceat(w.hashes, w.first[spoken]) & np.uint64(63))
        hashes, doc = _features(w)
        keys, place = np.unique(hashes, return_inverse=True)
        n = np.bincount(place * 2 + y[doc], minlength=2 * len(keys)).reshape(len(keys), 2)
        cells = np.zeros(len(keys), dtype=np.uint64)
        toxic = y[doc] == 1
        np.bitwise_or.at(cells, place[toxic], cell[doc[toxic]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), n[:, 0], n[:, 1], cells.view(np.int64))], names=["word", "n0", "n1", "cells"])

    by_class = {r["y"]: r["count"] for r in known.groupBy((F.col("_label") > 0).cast("int").alias("y")).count().collect()}
    n = np.array([by_class.get(0, 0), by_class.get(1, 0)], dtype=np.float64)
    if n.min() == 0:
        return np.zeros(0, dtype=np.uint64), n
    summed = known.transform(small_batches).mapInArrow(per_slice(count), "word long, n0 long, n1 long, cells long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("cells").alias("cells"))
    p1, p0 = (F.col("n1") + 0.5) / (n[1] + 1), (F.col("n0") + 0.5) / (n[0] + 1)
    telling = summed.where((F.bit_count("cells") >= MINED_CELLS) & (p1 / (1 - p1) >= MINED_ODDS * p0 / (1 - p0)))
    found = telling.select("word").toPandas()["word"].to_numpy(dtype=np.int64)  # 8 bytes a word
    return np.sort(found.view(np.uint64)), n


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``docs``; ``labels`` covers some of its rows."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = labelled(docs, labels, label, id_col).select("_label", "text", F.col(id_col))
    mined, n = _mine(known)
    vote = voters(mined)
    n_voters = len(LEXICONS) + MINED_VOTERS + 1

    def patterns(batches):
        counts: dict[int, int] = {}

        def add(rows, data, offsets):
            code = (vote(data, offsets) + 1) @ (3 ** np.arange(n_voters))
            for c, k in zip(*np.unique(code, return_counts=True), strict=True):
                counts[int(c)] = counts.get(int(c), 0) + int(k)

        for _ in per_slice(add)(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["code", "n"])

    seen = docs.select("text").transform(small_batches).mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in seen)
    prior = float((n[1] + 1) / (n.sum() + 10))
    if total == 0:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    votes = np.stack([np.array([r["code"] for r in seen]) // 3**k % 3 - 1 for k in range(n_voters)], axis=1)
    model = label_model.fit(votes, np.array([r["n"] for r in seen], dtype=np.float64), prior, pair_voters=True, fixed_prior=True)

    def sparse(rows, data, offsets):
        w = words(BARE[data], offsets)
        hashes, doc = _features(w)
        ends = np.cumsum(np.bincount(doc, minlength=w.docs))
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(model.posterior(vote(data, offsets))), pa.array([x.tobytes() for x in np.split(hashes, ends[:-1])], pa.binary())], names=["y", "part", "p", "words"])

    side = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label).cast("int").alias("y"))
    part = docs.where(hashed_below(id_col, sample_fraction(total, fit_rows)))
    # equal texts fall on one side, whatever the order of rows
    part = part.join(side, part[id_col] == side["_label_id"], "left").select("y", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"), "text")
    got = part.transform(small_batches).mapInArrow(per_slice(sparse), "y int, part long, p double, words binary").toPandas()
    got = got.sort_values(["words", "y"]).reset_index(drop=True)
    rows = [np.frombuffer(x, dtype=np.uint64) for x in got["words"]]
    vocabulary, count = np.unique(np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64), return_counts=True)
    telling = np.union1d(mined, np.concatenate([_hash_of(x) for x in LEXICONS.values()]))
    vocabulary = vocabulary[(count >= 3) | np.isin(vocabulary, telling)]
    cells = [x[x >= 0] for x in (_lookup(r, vocabulary) for r in rows)]
    fit = got["part"].to_numpy() != 3
    weight, bias = logistic([x for x, f in zip(cells, fit, strict=True) if f], got["p"].to_numpy()[fit], len(vocabulary))
    margin = np.array([weight[x].sum() + bias for x in cells])
    has = got["y"].notna().to_numpy() & ~fit
    slope, offset = platt(margin[has], (got["y"].to_numpy()[has] > 0).astype(float))
    used = weight != 0
    return Model(vocabulary[used], weight[used], bias, slope, offset, model)


def logistic(cells: list[np.ndarray], target: np.ndarray, size: int, *, l1: float = 2.0, l2: float = 0.05, rate: float = 1.0, rounds: int = 8, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with soft targets on indicator rows.

    Follow-the-regularised-leader steps with an L1 term: words whose evidence stays
    below it keep weight 0, so long clean texts gather no noise.
    """
    rng = np.random.default_rng(seed)
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    for _ in range(rounds):
        for i in rng.permutation(len(cells)):
            at = cells[i]
            err = 1.0 / (1.0 + np.exp(-np.clip(w[at].sum() + bias, -35, 35))) - target[i]
            grown = n[at] + err * err
            zi = z[at] + err - (np.sqrt(grown) - np.sqrt(n[at])) / rate * w[at]
            z[at], n[at] = zi, grown
            w[at] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(grown)) / rate + l2))
            bias -= 0.02 * err
    return w, float(bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row."""

    weights = Model(model.keys, model.weight, model.bias, model.slope, model.offset)

    def step(rows, data, offsets):
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(sigmoid(weights.slope * weights.margins(data, offsets) + weights.offset))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(per_slice(step), f"{id_col} {kind}, score double")
