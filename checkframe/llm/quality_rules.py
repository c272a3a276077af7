"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes good (1), bad (0) or abstains
(-1).  Expectation-maximisation over the vote patterns of *all* documents estimates
how accurate each rule is; the posterior probability of good quality replaces a
filter that every rule must pass.

Defined cases: null text counts as empty; an empty text has all counts 0 and fails
the base rules; repeated rows are scored alike; an empty table gives an empty
result.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import label_model
from .arrays import SPACE, _BYTE_KEY, _pos_key, mix64, shingles, sums, words
from .common import per_slice, small_batches
from .storage import cut

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_as_last", "n_upper", "n_letters", "n_marks")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?|~^_=+#*$%&<>{}[]\\")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_NOT_TAIL = (np.arange(256) & 0xC0) != 0x80

#: Votes: (ratio, bad above, good below) or (ratio, bad below, good above).  Between the two a rule abstains.
HIGH_IS_BAD = {
    "symbols": ("n_symbols", "n_words", 0.10, 0.02),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.30, 0.01),
    "repeated_phrases": ("n_repeat_words", "n_words", 0.30, 0.10),
    "stutter": ("n_same_as_last", "n_words", 0.10, 0.04),
    "shouting": ("n_upper", "n_letters", 0.40, 0.20),
    "marks": ("n_marks", "n_words", 0.25, 0.05),
}
BAD_WORDS, GOOD_WORDS = 50, 100
BAD_WORD_CHARS, GOOD_WORD_CHARS = (2.0, 15.0), (3.0, 10.0)
RULES = (*HIGH_IS_BAD, "length", "word_length")


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and how many of them equal an earlier one, by document."""
    n_docs = len(offsets) - 1
    zero = np.zeros(n_docs, dtype=np.int64)
    if len(data) == 0:
        return zero, zero
    feed = data == 10
    cut_at = feed.copy()
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin = np.unique(np.concatenate([heads, np.flatnonzero(cut_at) + 1]))
    begin = begin[begin < len(data)]
    line = np.zeros(len(data), dtype=np.int64)
    line[begin] = 1
    line = np.cumsum(line) - 1
    body = np.flatnonzero(~feed)
    line = line[body]
    pos = body - begin[line]
    with np.errstate(over="ignore"):
        value = _BYTE_KEY[data[body]] * _pos_key(int(pos.max()) + 1 if len(pos) else 1)[pos]
    at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, dtype=np.int64)
    if len(at) == 0:
        return zero, zero
    sizes = np.diff(np.r_[at, len(line)])
    with np.errstate(over="ignore"):
        h = mix64(np.add.reduceat(value, at) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    spoken = np.add.reduceat((~SPACE[data[body]]).astype(np.int64), at) > 0
    doc = np.searchsorted(offsets, body[at], side="right") - 1
    h, doc = h[spoken], doc[spoken]
    n = np.bincount(doc, minlength=n_docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return n, np.bincount(doc[same], minlength=n_docs)


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a slice."""
    w = words(data, offsets, lower=False)
    n_docs = w.docs
    out = {"n_words": np.diff(w.first), "word_chars": _count(_NOT_TAIL[data] & ~SPACE[data], offsets), "n_symbols": _count(_SYMBOL[data], offsets)}
    out["n_lines"], out["n_dup_lines"] = _lines(data, offsets)
    covered = np.zeros(len(w.hashes) + 3, dtype=bool)
    if len(w.hashes) >= 3:
        at = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        h, doc = shingles(w, 3)
        h, doc = h[: len(at)], doc[: len(at)]
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    last = np.zeros(len(w.hashes), dtype=bool)
    last[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["n_repeat_words"] = sums(covered[: len(w.hashes)], w.first).astype(np.int64)
    out["n_same_as_last"] = sums(last, w.first).astype(np.int64)
    out["n_upper"], out["n_letters"], out["n_marks"] = (_count(t[data], offsets) for t in (_UPPER, _LETTER, _MARK))
    assert len(out["n_words"]) == n_docs
    return out


def vote(x: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, rules) of -1, 0, 1."""
    out = []
    for top, bottom, bad, good in HIGH_IS_BAD.values():
        ratio = x[top] / np.maximum(x[bottom], 1)
        out.append(np.where(ratio > bad, 0, np.where(ratio <= good, 1, -1)))
    out.append(np.where(x["n_words"] < BAD_WORDS, 0, np.where(x["n_words"] >= GOOD_WORDS, 1, -1)))
    mean = x["word_chars"] / np.maximum(x["n_words"], 1)
    (b0, b1), (g0, g1) = BAD_WORD_CHARS, GOOD_WORD_CHARS
    out.append(np.where((mean < b0) | (mean > b1), 0, np.where((mean >= g0) & (mean <= g1), 1, -1)))
    return np.stack(out, axis=1)


def with_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, counts and vote pattern (a character a rule: 0, 1 or a dash)."""

    def step(rows, data, offsets):
        x = features(data, offsets)
        signs = np.array([b"-", b"0", b"1"])[vote(x) + 1]
        pattern = np.ascontiguousarray(signs).view(f"S{len(RULES)}").ravel()
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x[f].astype(np.int64)) for f in FEATURES), pa.array(pattern.astype(str), pa.string())], names=[id_col, *FEATURES, "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, " + ", ".join(f"{f} long" for f in FEATURES) + ", votes string"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(per_slice(step), schema)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, prior: float = 0.85) -> DataFrame:
    """Counts, votes, ``p_good`` and ``kept`` for every document.

    The counts are computed once and written; their vote patterns are counted over
    all documents, the model is fitted on at most ``3 ** rules`` pattern counts, and
    each pattern's posterior joins back by a broadcast of at most as many rows.
    """
    spark = docs.sparkSession
    counted = cut(with_votes(docs, id_col, text_col))
    patterns = counted.groupBy("votes").count().collect()
    votes = np.array([["-01".index(c) - 1 for c in r["votes"]] for r in patterns], dtype=np.int64).reshape(len(patterns), len(RULES))
    model = label_model.fit(votes, np.array([r["count"] for r in patterns], dtype=np.float64), prior)
    p = model.posterior(votes)
    scored = spark.createDataFrame([(r["votes"], float(x)) for r, x in zip(patterns, p, strict=True)], "votes string, p_good double")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(F.broadcast(scored), "votes").withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


#: The counts and the base verdict; the model's own verdict is beyond SQL.
BASE_ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again ON g.doc_id = again.doc_id AND g.g = again.g) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id
"""
