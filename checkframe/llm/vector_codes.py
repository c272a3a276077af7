"""Product codes of vectors, with nearest entries found through a VA-file.

Vectors become integers (``floor(scale * x)``) and are cut into equal consecutive parts.
Each part position has a codebook that starts as that part of the vectors with the
smallest ids and is refined in rounds: every part goes to its nearest entry (squared
Euclidean distance, ties to the lower index), then each entry becomes the
componentwise ``floor(sum / count)`` of its parts; unused entries stay.

Nearest entries: the coordinates of a codebook's entries are quantised to a few bits,
so each entry is a cell of a grid.  For each part to be coded, tables over (coordinate,
cell) hold the least and the greatest squared distance to the cell; summed over an
entry's cells they bound its distance from below and above.  Only entries whose lower
bound does not exceed the smallest upper bound are measured, in integers.

Spark reads the table once a round and adds up sums and counts before they are
shuffled; the codebooks are the only thing that the driver and the tasks exchange
(``parts * entries`` rows).

Defined cases: rows whose vector is null or holds null, NaN or infinite components are
left out.  A row without an id is coded, and starts no entry; rows that share an id are
rows of their own, and start entries in the order of their vectors.  With fewer vectors
than entries the codebooks are smaller, with none (or none with an id) there is no
codebook: codes and errors are null and the digest is that of the empty text.  Vectors
that do not have the most frequent length (of equally frequent ones the shorter) get a
null code and error.  That length has to be a multiple of ``parts``, and integers have to
stay within ``LIMIT`` so that distances are exact; anything else raises ``ValueError``.
Labels may be of any type that can be grouped; null labels count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .storage import cut, kept_bytes

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell's number in each coordinate.
BITS = 4
#: Vectors measured at a time.
ROWS = 1024
#: Largest integer, so that a distance over a thousand coordinates fits 63 bits.
LIMIT = 1 << 25
#: Bytes up to which the sums by label are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


class VaFile:
    """A codebook with its entries' cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        k, d = entries.shape
        cells = min(1 << bits, k)
        order = np.argsort(entries, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(k)[:, None], axis=0)
        #: cell of each entry's coordinate: equally many entries to a cell
        self.cell = place * cells // k
        ordered = np.take_along_axis(entries, order, axis=0)
        first = -(-np.arange(cells) * k // cells)
        last = np.append(first[1:], k) - 1
        #: least and greatest coordinate in each cell, as (coordinate, cell)
        self.low, self.high = ordered[first].T, ordered[last].T

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row to each entry."""
        lower = np.zeros((len(x), len(self.entries)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            below, above = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            gap = np.maximum(np.maximum(below, above), 0)
            reach = np.maximum(np.abs(below), np.abs(above))
            lower += np.take(gap * gap, self.cell[:, j], axis=1)
            upper += np.take(reach * reach, self.cell[:, j], axis=1)
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and the squared distance."""
        index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for at in range(0, len(x), ROWS):
            rows = x[at : at + ROWS]
            lower, upper = self.bounds(rows)
            row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
            gap = rows[row] - self.entries[entry]
            exact = np.einsum("ij,ij->i", gap, gap)
            first = np.searchsorted(row, np.arange(len(rows)))
            least = np.minimum.reduceat(exact, first)
            best = np.flatnonzero(exact == least[row])
            # entries stand in ascending order within a row, so the first of the best has the lowest index
            index[at : at + len(rows)] = entry[best[np.searchsorted(row[best], np.arange(len(rows)))]]
            distance[at : at + len(rows)] = least
        return index, distance


def _integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of lists of ``length`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(scale * flat)
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}")
    return out.astype(np.int64).reshape(len(column), length)


def _finite(vector: str):
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def _coded(books: list[VaFile], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: its number, the parts, their nearest entries and the distances."""
    width = x.shape[1] // len(books)
    for p, book in enumerate(books):
        own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        yield p, own, *book.nearest(own)


def digest(books: list[np.ndarray]) -> str:
    """Digest of all entries' integers, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()


def _learn(vectors: DataFrame, length: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebook of each part position; ``vectors`` has ``_id`` and ``_v``."""
    start = vectors.where("_id IS NOT NULL").orderBy("_id", "_v").limit(entries).select("_v").collect()
    if not start:
        return []
    chosen = _integers(pa.array([list(map(float, r["_v"])) for r in start], pa.list_(pa.float64())), length, scale)
    width = length // parts
    books = [chosen[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        files = [VaFile(b) for b in books]

        def sums(batches: Iterator[pa.RecordBatch], files=files) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, len(files[0].entries), width), dtype=np.int64)
            count = np.zeros(total.shape[:2], dtype=np.int64)
            for batch in batches:
                for p, own, index, _ in _coded(files, _integers(batch.column(0), length, scale)):
                    np.add.at(total[p], index, own)
                    count[p] += np.bincount(index, minlength=count.shape[1])
            p, e = np.nonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(total[p, e].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], names=["part", "entry", "n", "total"])

        each = vectors.select("_v").transform(small_batches).mapInArrow(sums, "part int, entry int, n long, total array<long>")
        summed = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        for r in summed.collect():  # at most one row an entry
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def vector_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``id_col``, ``code`` (entry numbers in order of the parts, two hex digits each), ``error`` and ``label_error``, and the codebooks.

    ``error`` is the sum of the parts' squared distances, ``label_error`` its sum over the rows of equal label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    kept = vectors.where(_finite(vector_col)).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_label"))
    sizes = kept.groupBy(F.size("_v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length = sizes[0]["length"] if sizes else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    alike = kept.where(F.size("_v") == length)
    books = _learn(alike, length, parts, entries, rounds, scale)
    files = [VaFile(b) for b in books]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            text = np.full(batch.num_rows, "", dtype=f"U{2 * parts}")
            for _, _, index, distance in _coded(files, _integers(batch.column(2), length, scale)):
                code = index
                error += distance
                text = np.char.add(text, np.array([f"{k:02x}" for k in range(256)])[code])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error)], names=["_id", "_label", "code", "error"])

    uncoded = (F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books:
        kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("_id", "_label"))
        coded = alike.select("_id", "_label", "_v").transform(small_batches).mapInArrow(step, f"{kinds}, code string, error long")
        coded = coded.unionByName(kept.where(F.size("_v") != length).select("_id", "_label", *uncoded))
    else:
        coded = kept.select("_id", "_label", *uncoded)
    coded = cut(coded)
    by_label = cut(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")))
    side = F.broadcast(by_label) if kept_bytes(by_label) <= BROADCAST_BYTES else by_label
    out = coded.join(side, coded["_label"].eqNullSafe(side["_of"])).select(F.col("_id").alias(id_col), "code", "error", "label_error")
    return out, books


def _oracle() -> str:
    """DuckDB SQL of the same work, without bounds: every part is measured against every entry."""
    text = """WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), piece AS MATERIALIZED (
  SELECT k.vec_id, k.label, p.p, k.v[16 * p.p + 1 : 16 * p.p + 16] AS x FROM kept k, range(4) AS p(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM piece
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256
)"""
    near = "SELECT q.vec_id, q.p, min({{'d': list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, b.c) + list_inner_product(b.c, b.c), 'e': b.e}}) AS best FROM piece q JOIN book{k} b ON b.p = q.p GROUP BY q.vec_id, q.p"
    for k in range(ROUNDS):
        text += f""", near{k} AS MATERIALIZED ({near.format(k=k)}
), mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(y) / count(*)) AS m FROM (
      SELECT q.p, n.best.e AS e, unnest(q.x) AS y, generate_subscripts(q.x, 1) AS i FROM near{k} n JOIN piece q ON q.vec_id = n.vec_id AND q.p = n.p
    ) GROUP BY p, e, i
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e
)"""
    return text + f""", last AS ({near.format(k=ROUNDS)}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS t FROM book{ROUNDS})
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.h AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest d"""


ORACLE = _oracle()
