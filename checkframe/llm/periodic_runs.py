"""Periodic runs of words, found on a harmonic grid of periods.

A run is a stretch of words in which words ``p`` apart are identical, that no
neighbouring word extends, with ``p`` its smallest period and a length of at least
``exponent * p`` and ``min_words``.  For each period ``p`` the places ``jp`` and
``(j + 1)p`` are compared: the longest common extension forward and backward gives the
stretch around them, so a document of ``n`` words takes about ``n ln n`` comparisons.
Extensions come from the suffix array of the words and that of the reversed words, as
the smallest common prefix between two ranks (range minimum queries over a sparse
table).  Before the arrays are built, grid places that no long enough run can hold are
put aside by comparing a few words that such a run must repeat; the arrays then cover
the documents that are left.

Each document is worked on by itself, a bounded slice of documents at a time; nothing
is shuffled.  Words are told apart by a 64-bit hash of all their bytes.

Defined cases: null text counts as empty; a text without words has no runs and an
empty collapsed text; rows that share an id, or have none, stay rows of their own;
other columns are not read, those named in ``keep`` are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, words
from .common import crc32_sql, per_slice, small_batches

#: Grid places compared at a time.
BLOCK = 1 << 21

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``x`` in order, the rank of each, and the common prefix of each with the one before it.

    Ranks of prefixes of 1, 2, 4, ... items are sorted in turn, until all differ; the
    same ranks then give the common prefixes, from the longest power of two down.
    """
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
    levels = [rank]
    k = 1
    while n and int(rank.max()) < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - k] += rank[k:].astype(np.int64) + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int32)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        levels.append(rank)
        k *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, dtype=np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        # ranks of one level name prefixes of its length, cut at the end of ``x``; separators keep those apart
        common[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, rank, common


class Extensions:
    """Longest common prefixes of any two suffixes of ``x``, which ends with an item found nowhere else."""

    def __init__(self, x: np.ndarray):
        _, self.rank, common = suffix_array(x)
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places ``a`` and ``b``, all different within their pairs."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb).astype(np.int64) + 1, np.maximum(ra, rb).astype(np.int64)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k)) + 1])
        return out


def _grid(ids: np.ndarray, first: np.ndarray, exponent: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, place, period)`` of the grid places that a long enough run may hold.

    A run of ``exponent * p`` words or more matches words ``p`` apart from its first
    grid place on for at least ``(exponent - 2) * p + 1`` places.
    """
    n = np.diff(first)
    docs = np.flatnonzero(n >= min_words)
    periods = n[docs] // exponent
    doc = np.repeat(docs, periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (n[doc] - 1) // p - exponent + 2
    doc, p, count = doc[count > 0], p[count > 0], count[count > 0]
    ends = np.cumsum(count)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(doc):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        sizes = count[at:end]
        row = np.repeat(np.arange(at, end), sizes)
        j = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step = p[row]
        place = first[doc[row]] + j * step
        for k in range(exponent - 1):
            same = ids[place + k * step] == ids[place + (k + 1) * step]
            row, step, place = row[same], step[same], place[same]
        for k in range(exponent - 2):
            for inner in (lambda p: np.minimum(1, p - 1), lambda p: p // 2):
                here = place + k * step + inner(step)
                same = ids[here] == ids[here + step]
                row, step, place = row[same], step[same], place[same]
        out.append((doc[row], place, step))
        at = end
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def find_runs(w: Words, *, exponent: int = 4, min_words: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length, period)`` of every run, by document, start and period; starts count from the document's first word."""
    ids = np.unique(w.hashes, return_inverse=True)[1]
    doc, place, p = _grid(ids, w.first, exponent, min_words)
    none = np.zeros(0, dtype=np.int64)
    if len(doc) == 0:
        return none, none, none, none
    # the documents that are left, one after the other, each between items found nowhere else
    used = np.unique(doc)
    sizes = np.diff(w.first)[used]
    begins = np.cumsum(sizes + 1) - sizes
    x = np.empty(int((sizes + 1).sum()) + 1, dtype=np.int64)
    marks = np.concatenate([begins - 1, [len(x) - 1]])
    inner = np.ones(len(x), dtype=bool)
    inner[marks] = False
    x[marks] = len(w.hashes) + np.arange(len(marks))
    x[inner] = ids[np.repeat(w.first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    u = begins[np.searchsorted(used, doc)] + place - w.first[doc]
    forward = Extensions(x).query(u, u + p)
    back = len(x) - 1 - (u - 1)
    backward = Extensions(x[::-1]).query(back, back - p)
    length = forward + backward + p
    start = place - backward - w.first[doc]
    long = length >= np.maximum(min_words, exponent * p)
    doc, start, length, p = doc[long], start[long], length[long], p[long]
    # a stretch that is found at several periods is a run of the smallest
    order = np.lexsort((p, length, start, doc))
    doc, start, length, p = doc[order], start[order], length[order], p[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, p = doc[new], start[new], length[new], p[new]
    order = np.lexsort((p, start, doc))
    return doc[order], start[order], length[order], p[order]


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    at = np.flatnonzero(kept)
    size, doc = w.length[at], w.doc[at]
    later = np.zeros(len(at), dtype=np.int64)
    later[1:] = doc[1:] == doc[:-1]
    ends = np.cumsum(size + later)
    before = np.cumsum(size) - size
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    run = np.arange(int(size.sum()))
    out[run + np.repeat(ends - size - before, size)] = w.data[run + np.repeat(w.start[at] - before, size)]
    offsets = np.zeros(w.docs + 1, dtype=np.int64)
    offsets[1:] = np.cumsum(np.bincount(doc, size + later, minlength=w.docs)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(w.docs, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(docs: DataFrame, *, exponent: int = 4, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``id_col``, the columns in ``keep``, ``n_words``, its ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` leaves out each word that a run holds after its first period, and joins the rest by one space.
    """
    if exponent < 2:
        raise ValueError("a run has to repeat its period")
    names = list(dict.fromkeys((id_col, *keep)))

    def step(rows, data, offsets):
        w = words(data, offsets, lower=False)
        doc, start, length, period = find_runs(w, exponent=exponent, min_words=min_words)
        change = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        np.add.at(change, w.first[doc] + start + period, 1)
        np.add.at(change, w.first[doc] + start + length, -1)
        collapsed = _joined(w, np.cumsum(change[:-1]) == 0)
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.docs))]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN_TYPE.value_type)))
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(names))), pa.array(np.diff(w.first)), runs, collapsed], names=[*names, "n_words", "runs", "collapsed"])

    own = docs.select(*names, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.transform(small_batches).mapInArrow(per_slice(step, "_text"), f"{schema}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which one document of ten repeats a stretch of its words up to its end.

    The documents are those whose ``h = crc32(doc_id as text)`` ends in 0.  With ``g = h div 10`` and ``n``
    words, the words from ``g % n`` on become copies of the first ``1 + (n - g % n) div (3 + g % 8)`` of them.
    A row without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, split).alias("_words"))
    sized = chosen.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    sized = sized.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    made = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))), F.lit(1), F.col("_n"))
    return sized.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


#: DuckDB SQL of the query: grid places by joins, runs as islands of matching places.
ORACLE = f"""WITH hashed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
), sized AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS cut FROM hashed
), given AS MATERIALIZED (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM sized
), word AS MATERIALIZED (
  SELECT g.doc_id, g.i, o.word FROM (
    SELECT g.doc_id, g.i, CASE WHEN g.i >= s.a THEN s.a + (g.i - s.a) % (1 + (s.n - s.a) // s.cut) ELSE g.i END AS origin FROM given g JOIN sized s ON s.doc_id = g.doc_id
  ) g JOIN given o ON o.doc_id = g.doc_id AND o.i = g.origin
), step AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS p FROM sized WHERE n >= 6
), place AS MATERIALIZED (SELECT doc_id, p, unnest(range((n - 1) // p - 2)) * p AS u FROM step
), place1 AS MATERIALIZED (SELECT g.*, a.word FROM place g JOIN word a ON a.doc_id = g.doc_id AND a.i = g.u
), place2 AS MATERIALIZED (SELECT g.* FROM place1 g JOIN word a ON a.doc_id = g.doc_id AND a.i = g.u + g.p WHERE a.word = g.word
), place3 AS MATERIALIZED (SELECT g.* FROM place2 g JOIN word a ON a.doc_id = g.doc_id AND a.i = g.u + 2 * g.p WHERE a.word = g.word
), place4 AS MATERIALIZED (SELECT DISTINCT g.doc_id, g.p FROM place3 g JOIN word a ON a.doc_id = g.doc_id AND a.i = g.u + 3 * g.p WHERE a.word = g.word
), opened AS MATERIALIZED (SELECT l.doc_id, l.p, a.i, a.word FROM place4 l JOIN word a ON a.doc_id = l.doc_id
), matched AS (
  SELECT a.doc_id, a.p, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, a.p ORDER BY a.i) AS island
  FROM opened a JOIN word b ON b.doc_id = a.doc_id AND b.i = a.i + a.p WHERE b.word = a.word
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM matched GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), run AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM stretch GROUP BY doc_id, start, length
), dropped AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word w WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = w.doc_id AND d.i = w.i) GROUP BY doc_id
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best FROM run GROUP BY doc_id
)
SELECT s.doc_id, coalesce(r.n_runs, 0)::BIGINT AS n_runs, r.best.s AS start, r.best.l AS length, r.best.p AS period, 1000 * r.best.l // r.best.p AS exponent_milli,
  sha256(coalesce(r.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM sized s LEFT JOIN per_doc r ON r.doc_id = s.doc_id LEFT JOIN kept k ON k.doc_id = s.doc_id"""
