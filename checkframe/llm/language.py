"""Language identification of mixed-language text.

``learn`` counts byte trigrams of words by language over all training rows.  For
each word, script ranges (blocks of code points, seen as UTF-8 lead bytes) narrow
the candidate languages; the log probability of its trigrams scores each candidate;
a Viterbi pass over the words with a penalty for switching labels the spans.  A
document's language is the one with most bytes of words in its spans.

Defined cases: null, empty or letterless text is ``und`` with score 0; with no
training rows everything is ``und``; repeated rows are labelled alike; an empty
table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import LOWER, SPACE, Words, words
from .common import per_slice, small_batches

#: Hash buckets of the trigram table.
BUCKETS = 1 << 14
#: Log-probability cost of changing the language between two words.
SWITCH_PENALTY = 12.0
#: A script belongs to a language if at least this share of its letters uses it.
SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 1000

# Script blocks by UTF-8 lead byte (first byte, last byte).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)),
    "greek": ((0xCE, 0xCF),),
    "cyrillic": ((0xD0, 0xD4),),
    "armenian_hebrew": ((0xD5, 0xD7),),
    "arabic": ((0xD8, 0xDD),),
    "indic_thai": ((0xE0, 0xE0),),
    "kana_cjk_low": ((0xE2, 0xE3),),
    "cjk": ((0xE4, 0xE9),),
    "hangul": ((0xEA, 0xED),),
}
_SCRIPT = np.full(256, -1, dtype=np.int8)
for _i, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        _SCRIPT[_a : _b + 1] = _i
#: Bytes that stand in words of a language: letters and bytes of longer code points.
_LETTERISH = (_SCRIPT >= 0) | (np.arange(256) >= 0x80)


@dataclass
class Model:
    languages: list[str]
    #: (buckets, languages) log probabilities
    log_p: np.ndarray
    #: (scripts, languages) whether the language uses the script
    uses: np.ndarray


def _grams(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket of each byte in a word, with its two neighbours (a blank at the word's edges), and where each word's bytes begin among them."""
    low = np.where(_LETTERISH[data], LOWER[data], 32).astype(np.uint32)
    inside = np.flatnonzero(~SPACE[data])
    first = np.cumsum(w.length) - w.length
    before, after = np.full(len(inside), 32, dtype=np.uint32), np.full(len(inside), 32, dtype=np.uint32)
    body = low[inside]
    before[1:], after[:-1] = body[:-1], body[1:]
    before[first] = 32
    after[first + w.length - 1] = 32
    code = (before << np.uint32(16)) | (body << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32), first


def learn(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams and scripts by language over every row of ``train`` that has both columns.

    Only (language, bucket) sums reach the driver: at most ``BUCKETS + scripts`` a language.
    """
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = sorted(r["lang"] for r in train.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n, wide, size = len(found), len(SCRIPTS), BUCKETS + len(SCRIPTS)
    index = {x: i for i, x in enumerate(found)}

    def count(batches):
        total = np.zeros((n, size), dtype=np.int64)

        def add(rows, data, offsets):
            w = words(data, offsets)
            if len(w.start) == 0:
                return
            lang = np.array([index[x] for x in rows.column(0).to_pylist()])
            grams, _ = _grams(data, w)
            by = np.repeat(lang[w.doc], w.length)
            np.add(total[:, :BUCKETS], np.bincount(by * BUCKETS + grams, minlength=n * BUCKETS).reshape(n, BUCKETS), out=total[:, :BUCKETS])
            script = _SCRIPT[data[~SPACE[data]]]
            seen = script >= 0
            total[:, BUCKETS:] += np.bincount(by[seen] * wide + script[seen], minlength=n * wide).reshape(n, wide)

        for _ in per_slice(add)(batches):
            pass
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total.ravel()[at])], names=["cell", "n"])

    counts = np.zeros((n, size))
    if n:
        for r in train.transform(small_batches).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[divmod(r["cell"], size)] = r["n"]
    grams = counts[:, :BUCKETS] + 0.5
    letters = counts[:, BUCKETS:]
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)) if n else np.zeros((0, BUCKETS))
    return Model(found, np.ascontiguousarray(log_p.T.astype(np.float32)), np.ascontiguousarray(uses.T))


def word_scores(model: Model, data: np.ndarray, w: Words) -> np.ndarray:
    """(words, languages) log probabilities; languages that do not use the word's scripts are ruled out, unless that leaves none."""
    grams, first = _grams(data, w)
    scores = np.add.reduceat(model.log_p[grams], first, axis=0)
    script = _SCRIPT[data[~SPACE[data]]]
    neutral = np.add.reduceat((script >= 0).astype(np.int64), first) == 0
    scores[neutral] = 0
    for s in np.unique(script[script >= 0]):
        allowed = model.uses[s]
        if allowed.all() or not allowed.any():
            continue
        has = np.add.reduceat((script == s).astype(np.int64), first) > 0
        scores[np.ix_(has, ~allowed)] -= 1e3
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: the sum of word scores less ``penalty`` a switch is largest.

    All documents of a slice advance together, the longest first, one word a step.
    """
    n_words, n = scores.shape
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    best_before = np.zeros(n_words, dtype=np.int16)
    stays = np.ones((n_words, n), dtype=bool)
    value = np.zeros((len(size), n), dtype=np.float32)
    for t in range(longest):
        k = alive[t]
        at = begin[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(k), best][:, None] - penalty
            best_before[at] = best
            stays[at] = v >= top
            np.maximum(v, top, out=v)
        v += scores[at]
    label = np.zeros(n_words, dtype=np.int16)
    now = np.zeros(len(size), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        last = size[:k] == t + 1
        now[:k] = np.where(last, value[:k].argmax(axis=1), now[:k])
        label[at] = now[:k]
        if t:
            now[:k] = np.where(stays[at, now[:k]], now[:k], best_before[at])
    return label


def label_words(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = SWITCH_PENALTY) -> tuple[Words, np.ndarray]:
    w = words(data, offsets)
    if len(w.start) == 0 or not model.languages:
        return w, np.zeros(len(w.start), dtype=np.int16)
    return w, viterbi(word_scores(model, data, w), w.first, penalty)


def _by_document(model: Model, w: Words, data: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with most letters in its words (ties: the first), and its share of them."""
    n = max(1, len(model.languages))
    if len(w.start) == 0:
        return np.zeros(w.docs, dtype=np.int64), np.zeros(w.docs)
    letters = np.add.reduceat((_SCRIPT[data[~SPACE[data]]] >= 0).astype(np.float64), np.cumsum(w.length) - w.length) + 1e-6
    mass = np.bincount(w.doc * n + label, letters, minlength=w.docs * n).reshape(w.docs, n)
    best = mass.argmax(axis=1)
    return best, mass[np.arange(w.docs), best] / np.maximum(mass.sum(axis=1), 1e-9)


def _has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The columns ``keep`` of every row, with ``lang_pred``, ``score`` (share of its letters) and ``n_spans``; kept columns of those names are replaced."""
    names = [*model.languages, "und"]
    found = ("lang_pred", "score", "n_spans")
    keep = tuple(c for c in keep if c not in found)

    def step(rows, data, offsets):
        w, label = label_words(model, data, offsets, penalty)
        best, share = _by_document(model, w, data, label)
        und = ~rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) | (not model.languages)
        best = np.where(und, len(names) - 1, best)
        turns = np.ones(len(label))
        turns[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
        spans = np.bincount(w.doc, turns, minlength=w.docs).astype(np.int64)
        made = (pa.array([names[i] for i in best], pa.string()), pa.array(np.where(und, 0.0, share)), pa.array(np.where(und, 0, spans)))
        return pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), *made], names=[*keep, *found])

    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("n_spans", "long")
    # a kept text column is read where it is
    text = [] if text_col in keep else [F.col(text_col).alias("_text")]
    columns = [*(F.col(c) for c in keep), *text, _has_letter(text_col).alias("_spoken")]
    return docs.select(*columns).transform(small_batches).mapInArrow(per_slice(step, "_text" if text else text_col), schema)


def spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row for each run of words in one language: ``id_col``, ``first_word``, ``n_words``, ``lang`` and the span's ``text``."""

    def step(rows, data, offsets):
        w, label = label_words(model, data, offsets, penalty)
        if len(label) == 0 or not model.languages:
            return None
        turn = np.ones(len(label), dtype=bool)
        turn[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(turn)
        end = np.r_[at[1:], len(label)]
        text = [bytes(data[w.start[a] : w.start[b - 1] + w.length[b - 1]]).decode("utf-8", "replace") for a, b in zip(at, end, strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(w.doc[at])), pa.array(at - w.first[w.doc[at]]), pa.array(end - at), pa.array([model.languages[i] for i in label[at]], pa.string()), pa.array(text, pa.string())], names=[id_col, "first_word", "n_words", "lang", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(per_slice(step), f"{id_col} {kind}, first_word long, n_words long, lang string, text string")
