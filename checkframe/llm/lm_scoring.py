"""Language-model scores of documents.

Corpus counts of words cover every training document and give the base score (an
add-one unigram model over words).  Every text is tokenized once; its subword ids are
kept as a table that all later steps read.  Counts of ids and of neighbouring slots,
again over every training document, give the pair model that a small causal
self-attention model (``attention``) starts from.  The network learns from every
training document once: each of ``ROUNDS`` rounds takes the documents whose hash falls to
it, every partition trains a copy on its own, and the copies, averaged by the windows
they saw, are where the next round starts.  All documents are scored by overlapping
windows, each id once; ``score`` is an even mixture of that (``model_score``) with the base.

The counts of the most frequent words, at most ``COMMON_WORDS``, travel to the tasks;
rarer words are joined by a shuffle for their counts, so no key is hot.

Defined cases: null text counts as empty (the end alone); repeated rows are scored
alike; with no training rows counts are 0 and the network is untrained; an empty table
gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as net
from .arrays import slices
from .common import crc32_sql, per_slice, small_batches
from .packing import text_words, word_ids
from .storage import cut

#: So many words at most travel to the tasks.
COMMON_WORDS = 300_000
ROUNDS, RATE, BATCH = 3, 0.02, 256
#: Windows that are scored together; their attention shares stay in a core's cache.
BLOCK = 192
#: Rows of an Arrow batch of counts.
COUNT_ROWS = 1 << 18
#: Text whose words are told apart at once: the more, the fewer words come again in the next slice.
READ_BYTES = 8 << 20
#: Words of slices that a task adds up before it hands the counts on.
COUNTED_WORDS = 1_000_000


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all training rows, the end of text left out."""

    def counted(data, offsets):
        words = text_words(data, offsets)
        n = np.bincount(words.index, minlength=len(words.distinct))
        # blanks at an end of a text leave an empty word, which no place has
        return pa.table({"word": words.distinct.cast(pa.large_binary()), "c": n}).filter(pa.array(n > 0))

    def added(held):
        out = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        for batch in out.to_batches(max_chunksize=COUNT_ROWS):
            yield pa.RecordBatch.from_arrays([_string(batch.column("word")), batch.column("c_sum")], names=["word", "c"])

    def count(batches):
        held: list[pa.Table] = []
        for batch in batches:
            for _, data, offsets in slices(batch, limit=READ_BYTES):
                held.append(counted(data, offsets))
                if sum(map(len, held)) > COUNTED_WORDS:
                    yield from added(held)
                    held = []
        if held:
            yield from added(held)

    return train.select(F.col(text_col).alias("text")).transform(small_batches).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _string(words: pa.Array) -> pa.Array:
    """Words of a large array as they are, valid UTF-8 or not."""
    return words.cast(pa.large_binary()).cast(pa.binary()).cast(pa.string(), safe=False)


@dataclass
class Given:
    """Words (one text, parted by newlines, which no word holds) and their counts."""

    text: bytes
    counts: np.ndarray

    def places(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """Place of each word; -1 for others."""
        if not hasattr(self, "_words"):
            self._words = pa.array(self.text.split(b"\n") if len(self.counts) else [], pa.large_binary())
        words = words.cast(pa.large_binary()) if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        return pc.fill_null(pc.index_in(words, self._words), -1).to_numpy(zero_copy_only=False)


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> Given:
    """Words from some count on, of which there are at most ``most``."""
    # how many words have a count of 2 ** (k / 4) or more: a few hundred rows at any size
    step = F.floor(4 * F.log2(F.col("c").cast("double"))).cast("int")
    by_step = sorted(((r["k"], r["count"]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in by_step:
        total += n
        if total > most:
            break
        least = k
    if least is None:
        return Given(b"", np.zeros(0, dtype=np.int64))
    # as Arrow columns, whose buffers are what is sent: no object a word on the driver
    found = counts.where(step >= least).select(F.concat("word", F.lit("\n")).alias("word"), "c").toArrow()
    return Given(_joined(found.column(0))[:-1].tobytes(), found.column(1).to_numpy())


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a column of texts in a row."""
    values = column.cast(pa.large_binary()).combine_chunks()
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[values.offset] : at[values.offset + len(values)]]


def read_texts(docs: DataFrame, common: Broadcast, tokenizer_path: str, end_id: int, floor: float, *, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Each row's ``ids`` (packed, with the end), and of its words how many there are, how many are common, the sum of those words' log shares, and the rare words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(rows, data, offsets):
        ids, cuts, words = word_ids(tokenizer_path).with_words(data, offsets, end_id)
        packed = ids.astype(net.ID).view(np.uint8)
        place = common.value.places(words.distinct)
        share = np.zeros(len(place))
        share[place >= 0] = np.log10((common.value.counts[place[place >= 0]] + 1) / floor)
        known = (place >= 0)[words.index]
        unknown = np.flatnonzero(~known)
        # each text is summed on its own, so that a sum is as exact in a large slice as in a small one
        doc = np.repeat(np.arange(len(rows)), np.diff(words.first))
        each = words.distinct.cast(pa.large_binary()).take(pa.array(words.index[unknown]))
        rare = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.searchsorted(unknown, words.first)), each), pa.scalar(b" ", pa.large_binary()))
        ids = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts * net.ID.itemsize), pa.py_buffer(packed)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(words.first)), pa.array(np.bincount(doc[known], minlength=len(rows))), pa.array(np.bincount(doc, share[words.index], minlength=len(rows)), pa.float64()), _string(rare), ids], names=["id", "train", "n_words", "n_known", "base", "rare", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    return rows.transform(small_batches).mapInArrow(per_slice(step, limit=READ_BYTES), f"id {kind}, train boolean, n_words long, n_known long, base double, rare string, ids binary")


def _ids_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice of packed ids, and where each document's begin."""
    return data.view(net.ID).astype(np.int32), offsets // net.ID.itemsize


def _summed(read: DataFrame, step, size: int) -> np.ndarray:
    """Sum over all tasks of the vectors of at most ``size`` counts that ``step(total, ids, cuts)`` adds to."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch, "ids"):
                step(total, *_ids_of(data, offsets))
        at = np.flatnonzero(total)
        for i in range(0, len(at), COUNT_ROWS):
            some = at[i : i + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    out = np.zeros(size)
    found = read.select("ids").transform(small_batches).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def id_counts(read: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; the most frequent ones get slots of their own."""

    def step(total, ids, cuts):
        total += np.bincount(ids, minlength=size)

    return _summed(read, step, size)


def mixed(model: Column, base: Column) -> Column:
    """Log10 probability of a text under an even mixture of the model and the base: never much below the better of the two."""
    high, low = F.greatest(model, base), F.least(model, base)
    return high + F.log10((1 + F.pow(F.lit(10.0), low - high)) / 2)


def corpus_counts(read: DataFrame, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each id occurs, and how often each slot follows each other one; at most one sum an id and ``SLOTS ** 2`` reach the driver."""
    size, pairs = len(slot), net.SLOTS**2

    def step(total, ids, cuts):
        s = slot[ids].astype(np.int64)
        before = np.concatenate([[net.START], s[:-1]])
        before[cuts[:-1][np.diff(cuts) > 0]] = net.START
        np.add.at(total, before * net.SLOTS + s, np.int64(1))
        total[pairs:] += np.bincount(ids, minlength=size)

    found = _summed(read, step, pairs + size)
    return found[pairs:], found[:pairs].astype(np.float32).reshape(net.SLOTS, net.SLOTS)


def train_network(read: DataFrame, vocab: net.Vocabulary, *, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` of training in every partition and averaging; each document is learned from in one round."""
    params = net.flatten(net.initial())
    shared = read.sparkSession.sparkContext.broadcast(vocab)
    for turn in range(rounds):

        def train(batches, start=params, turn=turn):
            p, vocab, work = net.unflatten(start), shared.value, net.Work()
            adam, seen = net.Adam(p, RATE / (1 + turn)), 0
            rng = np.random.default_rng(turn)
            for batch in batches:
                for _, data, offsets in slices(batch, "ids"):
                    w = net.windows(*_ids_of(data, offsets), vocab, net.WINDOW)
                    order = rng.permutation(len(w.doc))
                    for i in range(0, len(order), BATCH):
                        at = order[i : i + BATCH]
                        _, g = net.gradients(p, vocab, w.slots[at], vocab.cls[vocab.slot[w.target[at]]], w.valid[at], work)
                        adam.step(p, g)
                    seen += len(order)
            if seen:
                x = net.flatten(p).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x * seen), pa.array(np.full(len(x), seen))], names=["k", "x", "n"])

        own = read.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == turn).select("ids")
        mean = own.transform(small_batches).mapInArrow(train, "k long, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(mean):
            params = params.copy()
            params[mean["k"].to_numpy()] = mean["x"].to_numpy()
    return net.unflatten(params)


def log_probability(ids: np.ndarray, cuts: np.ndarray, params: dict[str, np.ndarray], vocab: net.Vocabulary) -> np.ndarray:
    """Natural log probability of each document's ids."""
    w, work, fixed = net.windows(ids, cuts, vocab), net.Work(), net.folded(params, vocab)
    out = np.zeros(len(cuts) - 1)
    for later in (False, True):
        own, skip = np.flatnonzero(w.later == later), (net.WINDOW - net.STRIDE) * later
        # full windows first: of those no place has to be picked
        own = own[np.argsort(~w.valid[own, -1], kind="stable")]
        for i in range(0, len(own), BLOCK):
            some = own[i : i + BLOCK]
            slots = w.slots[some]
            at = np.flatnonzero(w.scored[some, skip:])
            target = w.target[some, skip:].ravel()[at]
            slot = vocab.slot[target]
            got = net.log_class(fixed, vocab, slots, at, vocab.cls[slot], work, skip) + vocab.log_slot[slots[:, skip:].ravel()[at], slot] + vocab.log_share[target]
            out += np.bincount(w.doc[some[at // (net.WINDOW - skip)]], got, minlength=len(out))
    return out


def lm_scores(docs: DataFrame, train: Column, tokenizer_path: str, vocabulary_size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_score`` and ``score`` of every row; rows where ``train`` holds are learned from."""
    if vocabulary_size > np.iinfo(net.ID).max:
        raise ValueError(f"ids are kept as {net.ID}; the vocabulary has {vocabulary_size}")
    context = docs.sparkSession.sparkContext
    learn = docs.where(train)
    counts = cut(word_counts(learn, text_col))
    n_docs = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"] + n_docs, total["v"] + (n_docs > 0)
    floor = n_all + v_all + 1
    common = context.broadcast(common_words(counts))
    read = read_texts(docs, common, tokenizer_path, vocabulary_size, float(floor), id_col=id_col, text_col=text_col, train=train)
    read = cut(read.withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    learned = read.where("train")
    slot = net.slots_of(id_counts(learned, vocabulary_size + 1))
    vocab = net.vocabulary(slot, *corpus_counts(learned, slot))
    shared = context.broadcast((train_network(learned, vocab), vocab))

    def step(rows, data, offsets):
        score = log_probability(*_ids_of(data, offsets), *shared.value) / np.log(10)
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score)], names=[*rows.schema.names[:-1], "score"])

    kept = read.select("row", "id", "n_words", "n_known", "base", "ids")
    scored = kept.transform(small_batches).mapInArrow(per_slice(step, "ids"), f"row long, id {read.schema['id'].dataType.simpleString()}, n_words long, n_known long, base double, score double")
    tokens = read.where("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    c = F.coalesce("c", F.lit(0))
    # each word has one count: a task's share of them is hashed, and its tokens need no order
    rare = tokens.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(F.sum(F.log10((c + 1) / F.lit(float(floor)))).alias("rare_base"), F.sum((c > 0).cast("int")).alias("rare_known"))
    end_score = float(np.log10((n_docs + 1) / floor))
    base_score = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end_score)
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        mixed(F.col("score"), base_score).alias("score"),
        F.col("score").alias("model_score"),
    )


#: DuckDB SQL of the columns that are counts of words, and of the base score to three digits.
BASE_ORACLE = f"""WITH texts AS (
  SELECT doc_id, {crc32_sql("doc_id::VARCHAR")} % 7 = 2 AS held_out,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), word AS (SELECT doc_id, held_out, unnest(w) AS word FROM texts
), counted AS (SELECT word, count(*) AS c FROM word WHERE NOT held_out GROUP BY word
), total AS (
  SELECT (SELECT count(*) FROM texts WHERE NOT held_out) AS ends, (SELECT coalesce(sum(c), 0)::BIGINT FROM counted) AS n, (SELECT count(*) FROM counted) AS v
), size AS (SELECT ends, n + ends AS n, n + ends + v + (ends > 0)::INT + 1 AS floor FROM total
), per_doc AS (
  SELECT doc_id, count(*) AS words, count(c) AS known, sum(log10((coalesce(c, 0) + 1) / floor::DOUBLE)) AS score FROM word LEFT JOIN counted USING (word), size GROUP BY doc_id
)
SELECT t.doc_id, t.held_out, coalesce(p.words, 0) + 1 AS n_tokens, coalesce(p.known, 0) + (s.ends > 0)::INT AS n_known, s.n::BIGINT AS train_tokens,
  round(coalesce(p.score, 0) + log10((s.ends + 1) / s.floor::DOUBLE), 3) AS base_score
FROM texts t LEFT JOIN per_doc p ON p.doc_id = t.doc_id, size s"""
