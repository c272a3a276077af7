"""Sequence packing: vector bin packing by the dot-product heuristic.

Documents become token ids (plus an end id) and are placed in sequences under three
simultaneous limits: tokens, segments and loss-bearing tokens.  The ids of a prompt
(another column, or the first line of a text of several lines) bear no loss.  Long
documents are first cut into pieces that alone use up a sequence's tokens or loss;
what is left of each is an item.  An open sequence takes the item that fits and whose
demand vector (tokens, loss-bearing tokens, one segment) has the largest dot product
with the room that is left; when no item fits, the longest head that does fit, which
is silent ids alone once the loss is used up, fills the rest.  Every input partition
packs its own documents in runs of bounded size and hands the last open sequence on to
the next run, so nothing is shuffled and no group of rows has to meet in one task.  The
rest of a partition is cut at powers of two, which need no padding.

Defined cases: null text counts as empty (the end id alone); repeated rows are
packed each; very long documents are cut; an empty table gives no sequence.  Other
columns of the input are not read.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .common import small_batches

#: Items that are packed together.
RUN_ITEMS = 4000
#: Pieces of words whose ids a Python worker remembers.
CACHE_PIECES = 400_000

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[list(_MARKS.encode())] = True
#: For each byte and the next one: that it is part of no lower-case letter below U+0130.
_NO_LETTER = np.ones((256, 256), dtype=bool)
_NO_LETTER[ord("a") : ord("z") + 1] = False
_NO_LETTER[0x80:0xC0] = False
_NO_LETTER[0xC2, [0xAA, 0xB5, 0xBA]] = False
_NO_LETTER[0xC3, 0x80:0xC0] = False
_NO_LETTER[0xC3, [0x97, 0xB7]] = True
_NO_LETTER[0xC4, 0x80:0xB0] = False
_NO_LETTER = _NO_LETTER.ravel()


@dataclass
class TextWords:
    """Words of a slice, A-Z in lower case: the distinct ones, each word's place among those, and where each document's words begin."""

    distinct: pa.Array
    index: np.ndarray
    first: np.ndarray
    #: once they are spelled, how many ids each word has, and the ids of documents that hold special tokens
    size: np.ndarray | None = None
    special: dict[int, np.ndarray] = field(default_factory=dict)


def text_words(data: np.ndarray, offsets: np.ndarray) -> TextWords:
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.values
    # blanks at an end of a text leave an empty part there
    word = np.diff(_offsets(words)) > 0
    coded = words.dictionary_encode()
    first = np.concatenate([[0], np.cumsum(word)])[parts.offsets.to_numpy()]
    return TextWords(coded.dictionary, coded.indices.to_numpy()[word], first)


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each text of a ``large_string`` array begins in its buffer, with one more entry at the end."""
    return np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]


def listed(values: pa.Array) -> list[bytes]:
    """The texts of a large array as bytes; none of them holds a newline."""
    together = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(pa.large_binary()))
    return pc.binary_join(together, pa.scalar(b"\n", pa.large_binary()))[0].as_py().split(b"\n") if len(values) else []


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` in a row, and where each one lies there."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return values.take(np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])), upto


class WordIds:
    """Ids of words, found by the tokenizer once a piece of a word and then remembered.

    The tokenizer splits at white space before anything else, so a text's ids are its
    words' ids in a row.  A word of Latin letters with marks at the end is two pieces,
    which go straight to the tokenizer's merge model; any other is one, and goes through
    the tokenizer itself.  Only the distinct pieces of a slice become Python objects.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # words come here in lower case: what then looks like a special token was none in the text
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        byte = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {b: chr(b) for b in byte}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        #: how the merge model's vocabulary shows each byte; the newline parts pieces here
        self.table = {b: c for b, c in shown.items() if b != 10}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.at, self.size = array("I"), array("q"), array("q")
        #: pieces that came in a second slice
        self.again = np.zeros(0, dtype=bool)

    def trim(self) -> None:
        """Forgets pieces that only one slice had, or all if too many are left."""
        if len(self.place) <= CACHE_PIECES:
            return
        keys = [k for k, again in zip(self.place, self.again.tolist(), strict=True) if again]
        flat, at, size = (np.array(x, dtype=t) for x, t in ((self.flat, np.uint32), (self.at, np.int64), (self.size, np.int64)))
        ids, upto = _gather(flat, at[self.again], size[self.again])
        self._forget()
        if len(keys) <= CACHE_PIECES // 2:
            self.place.update(zip(keys, range(len(keys)), strict=True))
            self.flat.frombytes(ids.tobytes())
            self.at.frombytes(upto[:-1].tobytes())
            self.size.frombytes(np.diff(upto).tobytes())
            self.again = np.zeros(len(keys), dtype=bool)

    def learn(self, new: list[bytes]) -> None:
        """Finds the ids of new pieces and keeps them under the piece's place."""
        texts = [k.decode("utf-8", "replace") for k in new]
        merged = [len(k) < 200 and (not t.strip(_MARKS) or t.isalpha() and (t.isascii() or max(t) < "İ")) for k, t in zip(new, texts, strict=True)]
        shown = "\n".join(t for t, m in zip(texts, merged, strict=True) if m).lower().encode().decode("latin-1").translate(self.table)
        tokenize, encode = self.model.tokenize, self.plain.encode
        found = [[t.id for t in tokenize(x)] for x in shown.split("\n")] if any(merged) else []
        if len(found) < len(new):
            short = iter(found)
            found = [next(short) if m else encode(t, add_special_tokens=False).ids for t, m in zip(texts, merged, strict=True)]
        sizes = array("q", map(len, found))
        self.place.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.at.extend(itertools.accumulate(sizes[:-1], initial=len(self.flat)))
        self.size.extend(sizes)
        self.flat.extend(itertools.chain.from_iterable(found))

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (distinct ones, in lower case) in a row, and where each word's begin."""
        upto = _offsets(words)
        begin, end = upto[:-1], upto[1:]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        data = data[: upto[-1]]
        some = np.flatnonzero(end > begin)
        cut = end.copy()
        if len(some):
            own = np.where(_IS_MARK[data], -1, np.arange(len(data)))
            head = np.maximum(np.maximum.reduceat(own, begin[some]) + 1, begin[some])
            odd = _NO_LETTER[(data.astype(np.uint16) << 8) + np.append(data[1:], np.uint8(0))]
            # what follows a first byte of a letter must be in the word, and come first in none
            odd[begin[some]] |= (data[begin[some]] & 0xC0) == 0x80
            odd[end[some] - 1] |= data[end[some] - 1] >= 0xC0
            bad = np.concatenate([[0], np.cumsum(odd)])
            plain = (bad[head] == bad[begin[some]]) & (end[some] - begin[some] < 200)
            cut[some] = np.where(plain, head, end[some])
        # each word's letters and its marks, one after the other, in the same bytes
        bounds = np.append(np.stack([begin, cut], axis=1).ravel(), upto[-1])
        pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(words), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        keys = listed(pieces.dictionary)
        self.trim()
        known = np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.learn([keys[i] for i in new])
        self.again = np.append(self.again, np.zeros(len(new), dtype=bool))
        self.again[np.delete(known, new)] = True
        place = known[pieces.indices.to_numpy()]
        at, size, flat = (np.array(x, dtype=t) for x, t in ((self.at, np.int64), (self.size, np.int64), (self.flat, np.uint32)))
        ids, where = _gather(flat, at[place], size[place])
        return ids, where[::2]

    def documents(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each document of a slice (with ``end`` after it), and where each document's begin."""
        return self.with_words(data, offsets, end)[:2]

    def with_words(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray, TextWords]:
        """``documents``, and the words."""
        words = text_words(data, offsets)
        spelled, begin = self.spell(words.distinct)
        words.size = np.diff(begin)[words.index]
        body, upto = _gather(spelled, begin[words.index], words.size)
        cuts = upto[words.first]
        raw, n = data.tobytes(), len(offsets) - 1
        whole = words.special
        if any(s in raw for s in self.special):
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if any(raw.find(s, a, b) >= 0 for s in self.special):
                    whole[i] = np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)
        if whole:
            body = np.concatenate([whole.get(i, body[cuts[i] : cuts[i + 1]]) for i in range(n)])
            cuts = np.concatenate([[0], np.cumsum([len(whole[i]) if i in whole else cuts[i + 1] - cuts[i] for i in range(n)])])
        if end is not None:
            body, cuts = np.insert(body, cuts[1:], end), cuts + np.arange(n + 1)
        return body, cuts, words

    def first_lines(self, data: np.ndarray, offsets: np.ndarray, words: TextWords) -> np.ndarray:
        """How many of each document's ids belong to its first line; 0 if nothing but blanks comes after it.

        ``words`` are those of the same slice: a line's ids are its words' ids.
        """
        raw, out = data.tobytes(), np.zeros(len(offsets) - 1, dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(words.size)])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            end = raw.find(b"\n", a, b)
            if end < 0 or not raw[end:b].strip():
                continue
            if i in words.special:
                out[i] = len(self.documents(data[a:end], np.array([0, end - a]), None)[0])
            else:
                at = words.first[i]
                out[i] = upto[at + len(raw[a:end].split())] - upto[at]
        return out


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own ``WordIds``; it outlives the task if the worker does."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 16
    loss: int = 2016


@dataclass
class Item:
    """What is still to be placed of one document: ids from ``start`` on; ids before ``quiet`` bear no loss."""

    key: object
    ids: np.ndarray
    start: int
    quiet: int
    total: int

    def loss(self, n: int) -> int:
        return max(0, self.start + n - max(self.quiet, self.start))

    def head(self, n: int) -> tuple[Item, Item | None]:
        rest = Item(self.key, self.ids[n:], self.start + n, self.quiet, self.total) if n < len(self.ids) else None
        return Item(self.key, self.ids[:n], self.start, self.quiet, self.total), rest


@dataclass
class _Shelf:
    """Items by demand (tokens, loss): equal demands are one candidate."""

    tokens: np.ndarray = field(default_factory=lambda: np.zeros(64))
    loss: np.ndarray = field(default_factory=lambda: np.zeros(64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(64, dtype=np.int64))
    kinds: dict = field(default_factory=dict)
    items: list = field(default_factory=list)
    left: int = 0

    def put(self, item: Item) -> None:
        demand = (len(item.ids), item.loss(len(item.ids)))
        k = self.kinds.setdefault(demand, len(self.kinds))
        if k == len(self.items):
            self.items.append([])
            if k >= len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.count))
            self.tokens[k], self.loss[k] = demand
        self.items[k].append(item)
        self.count[k] += 1
        self.left += 1

    def take(self, k: int) -> Item:
        self.count[k] -= 1
        self.left -= 1
        return self.items[k].pop()


def pack(items: list[Item], limits: Limits) -> list[list[Item]]:
    """Sequences of pieces; all but the last are full as far as the limits allow."""
    shelf = _Shelf()
    for x in items:
        shelf.put(x)
    out = []
    while shelf.left:
        room, seats, loss, sequence = limits.tokens, limits.segments, limits.loss, []
        while shelf.left and room and seats:
            n = len(shelf.kinds)
            tokens, want = shelf.tokens[:n], shelf.loss[:n]
            fits = (shelf.count[:n] > 0) & (tokens <= room) & (want <= loss)
            if fits.any():
                dot = tokens * (room / limits.tokens**2) + want * (loss / limits.loss**2) + seats / limits.segments**2
                item = shelf.take(int(np.where(fits, dot, -1).argmax()))
            else:
                # silent ids come first in an item, so its head of (silent + loss left) ids is the longest that fits
                head = np.minimum(np.minimum(tokens, room), tokens - want + loss) * (shelf.count[:n] > 0)
                k = int(np.where(head == head.max(), tokens, -1).argmax())
                if head[k] <= 0:
                    break
                item, rest = shelf.take(k).head(int(head[k]))
                if rest is not None:
                    shelf.put(rest)
            sequence.append(item)
            room -= len(item.ids)
            seats -= 1
            loss -= item.loss(len(item.ids))
        out.append(sequence)
    return out


def _powers(sequence: list[Item]) -> list[list[Item]]:
    """A partly filled sequence as sequences whose lengths are powers of two."""
    out, queue = [], list(sequence)
    total = sum(len(x.ids) for x in queue)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            first = queue.pop(0)
            item, rest = first.head(min(size, len(first.ids)))
            if rest is not None:
                queue.insert(0, rest)
            size -= len(item.ids)
            part.append(item)
        out.append(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = 1, limits: Limits | None = None, first_line_prompt: bool = False, with_ids: bool = True) -> DataFrame:
    """One row a piece: its document, place in the document, loss-bearing ids and place in its sequence.

    ``prompt_col``: text that comes before the document's and whose ids bear no loss.
    ``first_line_prompt``: the first line of a text of several lines bears no loss.
    ``with_ids``: also return the piece's ``ids``.
    """
    limits = limits or Limits()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches):
        ids_of = word_ids(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        made = 0

        def rows(sequences):
            nonlocal made
            cols = [[] for _ in range(9)]
            for sequence in sequences:
                offset = 0
                for x in sequence:
                    ids = np.ascontiguousarray(x.ids, dtype="<u4")
                    for c, v in zip(cols, (x.key, x.start, len(ids), zlib.crc32(ids.tobytes()), x.total, base + made, offset, x.loss(len(ids)), ids if with_ids else None), strict=True):
                        c.append(v)
                    offset += len(ids)
                made += 1
            arrays = [pa.array(cols[0], type=key_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        waiting: list[Item] = []
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part, data, offsets in slices(batch):
                ids, cuts, words = ids_of.with_words(data, offsets, end_id)
                quiet = np.zeros(part.num_rows, dtype=np.int64)
                if prompt_col is not None:
                    before = [(p or "").encode() for p in part.column(2).to_pylist()]
                    p_ids, p_cuts = ids_of.documents(np.frombuffer(b"".join(before), dtype=np.uint8), np.cumsum([0, *map(len, before)]), None)
                    quiet = np.diff(p_cuts)
                if first_line_prompt:
                    quiet = quiet + ids_of.first_lines(data, offsets, words)
                full = []
                for i, key in enumerate(part.column(0).to_pylist()):
                    own = ids[cuts[i] : cuts[i + 1]]
                    if prompt_col is not None:
                        own = np.concatenate([p_ids[p_cuts[i] : p_cuts[i + 1]], own])
                    item = Item(key, own.copy(), 0, int(quiet[i]), len(own))
                    while item is not None and len(item.ids) > (size := min(limits.tokens, limits.loss + max(0, item.quiet - item.start))):
                        head, item = item.head(size)
                        if size == limits.tokens:
                            full.append([head])
                        else:
                            waiting.append(head)
                    if item is not None:
                        waiting.append(item)
                if full:
                    yield rows(full)
                if len(waiting) >= RUN_ITEMS:
                    packed = pack(waiting, limits)
                    waiting = packed.pop()
                    yield rows(packed)
        if waiting:
            packed = pack(waiting, limits)
            yield rows(packed[:-1] + _powers(packed[-1]))

    schema = f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids array<int>" if with_ids else "")
    columns = [F.col(id_col), F.col(text_col).alias("text")] + ([F.col(prompt_col).alias("prompt")] if prompt_col is not None else [])
    return docs.select(*columns).transform(small_batches).mapInArrow(run, schema)


#: DuckDB SQL of what holds for any packing of the documents.
LAWS_ORACLE = "SELECT count(*) AS documents, true AS documents_whole, true AS sequences_gapless, true AS within_limit FROM documents"
