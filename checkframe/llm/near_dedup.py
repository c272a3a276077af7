"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles becomes ``REGISTERS`` registers: the minima of
exponentially spaced truncated values, quantised on a logarithmic scale.  The values
of an element come in rising intervals, so a set stops early once no value can lower
a register; registers of a union are the maxima of the quantised ones.  Bands of
register values give candidates, a joint likelihood over the registers of two sets
estimates their similarity, and links are confirmed on the full sets.

Equal sets are one class from the start.  In a bucket, members are first compared
with one representative; only members that end in different components are compared
further: in small buckets by pairs, in large ones by blocks of full sets inside tasks,
which give out links only.  So large groups of near copies never give all their pairs
and no link between components is left out.

Defined cases: text without words (null, empty) has the empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows without an id are
never linked; rows of one id count as one document; an empty table gives an empty
result.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import distinct, mix64, shingles, slices, stream64, words
from .common import BROADCAST_ROWS, per_slice, small_batches
from .graph import components
from .storage import cut, release

REGISTERS = 256
#: Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 51 < 2e-9.
BANDS, BAND_ROWS = 51, 5
#: Base of the logarithmic scale.
BASE = 1.005
_SHIFT = 1000
#: Candidates below the threshold by more than this are not verified; six standard errors of the estimate at 0.8.
MARGIN = 0.15

#: Members of a bucket up to which different components are compared by pairs of rows.
SMALL_BUCKET = 32
#: Documents of a block on either side of a comparison in larger ones, and shingles of all its sets together, on average.
QUERY_BLOCK, MEMBER_BLOCK = 512, 2048
QUERY_SHINGLES, MEMBER_SHINGLES = 1 << 20, 1 << 22
#: Cells of a block's incidence matrix.
_CELLS = 8 << 20

_U = np.uint64


def minima(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, registers) smallest stratified values in [0, 1); 1 where a set is empty.

    The j-th value of an element lies in ``[j, j + 1) / REGISTERS`` and goes to the j-th
    register of the element's own permutation; ``-log(1 - t)`` makes it the truncated
    exponential of that interval.
    """
    m = REGISTERS
    out = np.ones((n_docs, m))
    flat = out.ravel()
    own, stride = hashes & _U(m - 1), (hashes >> _U(20)) | _U(1)
    steps = stream64(131, m)
    h, d = hashes, doc
    for j in range(m):
        with np.errstate(over="ignore"):
            value = (j + (mix64(h + steps[j]) >> _U(11)).astype(np.float64) / (1 << 53)) / m
            register = ((own + _U(j) * stride) & _U(m - 1)).astype(np.int64)
        np.minimum.at(flat, d * m + register, value)
        if j % 2 == 0 or j < 8:
            open_ = out.max(axis=1) > (j + 1) / m
            keep = open_[d]
            if not keep.any():
                break
            if not keep.all():
                h, d, own, stride = h[keep], d[keep], own[keep], stride[keep]
    return out


def quantise(t: np.ndarray) -> np.ndarray:
    """Register values: ``floor(1 - log_b(x))``, shifted to be positive; 0 for the empty set."""
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(t, 1 - 1e-16))
        k = np.floor(1 - np.log(x) / np.log(BASE)) + _SHIFT
    return np.where(t >= 1, 0, np.clip(k, 1, 65535)).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of largest joint likelihood, given both registers (pairs, registers) and set sizes."""
    up, down = (ra > rb).sum(axis=1)[:, None], (ra < rb).sum(axis=1)[:, None]
    same = ra.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    log = up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))
    return j[np.arange(len(j)), log.argmax(axis=1)]


def signatures(docs: DataFrame, *, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n, s1, s2, regs): set size, two commutative checksums of the set, registers."""

    def step(rows, data, offsets):
        w = words(data, offsets)
        h, doc = distinct(*shingles(w, n))
        size = np.bincount(doc, minlength=w.docs)
        s1, s2 = np.zeros(w.docs, dtype=_U), np.zeros(w.docs, dtype=_U)
        some = np.flatnonzero(size)
        if len(some):
            at = (np.cumsum(size) - size)[some]
            with np.errstate(over="ignore"):
                s1[some] = np.add.reduceat(mix64(h), at)
                s2[some] = np.bitwise_xor.reduceat(mix64(h + _U(77)), at)
        regs = quantise(minima(h, doc, w.docs))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())], names=["id", "n", "s1", "s2", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(per_slice(step), f"id {kind}, n long, s1 long, s2 long, regs binary")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, id): one row for each band of each set."""
    keys = stream64(151, BAND_ROWS) | _U(1)
    bands = stream64(157, BANDS)

    def step(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(batch.num_rows, REGISTERS)
            part = regs[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(_U)
            with np.errstate(over="ignore"):
                key = mix64((mix64(part + _U(1)) * keys).sum(axis=2, dtype=_U) + bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["key", "id"])

    return reps.select("id", "regs").transform(small_batches).mapInArrow(step, f"key long, id {reps.schema['id'].dataType.simpleString()}")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimated similarity reaches the threshold less ``MARGIN`` and whose sizes allow it."""

    def step(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(batch.num_rows, REGISTERS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
            ok = (estimate(ra, rb, na, nb) >= percent / 100 - MARGIN) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    kind = reps.schema["id"].dataType.simpleString()
    sides = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a").join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    return sides.select("a", "b", "na", "nb", "ra", "rb").transform(small_batches).mapInArrow(step, f"a {kind}, b {kind}")


def verify(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have ``100 * intersection >= percent * union``."""

    def step(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "ta"):
                ha, da = distinct(*shingles(words(data, offsets), n))
                ((_, other, upto),) = slices(rows, "tb", 1 << 60)
                hb, db = distinct(*shingles(words(other, upto), n))
                h, d = np.concatenate([ha, hb]), np.concatenate([da, db])
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=rows.num_rows)
                union = np.bincount(d, minlength=rows.num_rows) - both
                ok = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([rows.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = F.broadcast(ids) if pairs.count() <= BROADCAST_ROWS // 2 else ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return sides.select("a", "b", "ta", "tb").transform(small_batches).mapInArrow(step, f"a {kind}, b {kind}").distinct()


def _block_links(queries: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """One link for each query and other component that it has a link with; columns id, label, set (sorted hashes)."""
    qs, ms = ([np.frombuffer(x, dtype=_U) for x in t["set"].to_pylist()] for t in (queries, members))
    q_label, m_label = (np.array(t["label"].to_pylist(), dtype=object) for t in (queries, members))
    m_size = np.array([len(x) for x in ms])
    a, b = [], []
    at = 0
    while at < len(qs):
        end, total = at, 0
        while end < len(qs) and (end == at or (end - at + 1) * (total + len(qs[end])) <= _CELLS):
            total += len(qs[end])
            end += 1
        size = np.array([len(x) for x in qs[at:end]])
        universe, place = np.unique(np.concatenate(qs[at:end]), return_inverse=True)
        q = np.zeros((end - at, len(universe)), dtype=np.float32)
        q[np.repeat(np.arange(end - at), size), place] = 1
        step = max(1, _CELLS // max(1, len(universe)))
        for k in range(0, len(ms), step):
            part = m_size[k : k + step]
            h = np.concatenate(ms[k : k + step])
            where = np.minimum(np.searchsorted(universe, h), len(universe) - 1)
            hit = universe[where] == h
            m = np.zeros((len(part), len(universe)), dtype=np.float32)
            m[np.repeat(np.arange(len(part)), part)[hit], where[hit]] = 1
            both = q @ m.T
            union = size[:, None] + part[None, :] - both
            linked = (100 * both >= percent * union) & (q_label[at:end, None] != m_label[None, k : k + step])
            for i in np.flatnonzero(linked.any(axis=1)):
                _, first = np.unique(m_label[k : k + step][linked[i]].astype(str), return_index=True)
                a += [at + i] * len(first)
                b += list(k + np.flatnonzero(linked[i])[first])
        at = end
    return pa.table({"a": queries["id"].take(pa.array(a, pa.int64())), "b": members["id"].take(pa.array(b, pa.int64()))})


def crowd_links(crowd: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Links between different components within crowds of near copies.

    ``crowd`` has the members of large buckets with one representative each; buckets
    that share members are one crowd.  All documents outside a crowd's main component
    are compared with all its members, block by block, on full sets.  Blocks are bounded
    by documents and by shingles.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    of = components(crowd.select(F.col("id").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("label", "crowd")
    member = cut(of.join(labels, "id", "left").join(reps.select("id", "n"), "id").select("id", "crowd", "n", F.coalesce("label", "id").alias("label")))
    parts = member.groupBy("crowd", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = cut(parts.groupBy("crowd").agg(F.max(F.struct("c", "label", "s")).alias("most"), F.sum("c").alias("g"), F.sum("s").alias("s")).where("most.c < g").select("crowd", F.col("most.label").alias("main"), "g", "s", (F.col("g") - F.col("most.c")).alias("out_g"), (F.col("s") - F.col("most.s")).alias("out_s")))
    member = cut(member.drop("n").join(sizes, "crowd"))

    def sets(rows, data, offsets):
        h, doc = distinct(*shingles(words(data, offsets), n))
        ends = np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))
        found = [x.tobytes() for x in np.split(h, ends[:-1])]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.binary())], names=["id", "set"])

    ids = member.select("id")
    ids = F.broadcast(ids) if member.count() <= BROADCAST_ROWS else ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    full = cut(texts.transform(small_batches).mapInArrow(per_slice(sets), f"id {kind}, set binary").dropDuplicates(["id"]).join(member, "id"))
    n_query = F.ceil(F.greatest(F.col("out_g") / QUERY_BLOCK, F.col("out_s") / QUERY_SHINGLES)).cast("int")
    n_member = F.ceil(F.greatest(F.col("g") / MEMBER_BLOCK, F.col("s") / MEMBER_SHINGLES)).cast("int")
    block = F.xxhash64("id")
    left = full.where("label <> main").withColumn("qb", F.pmod(block, n_query).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), n_member - 1)))
    right = full.withColumn("mb", F.pmod(block, n_member).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), n_query - 1)))
    keys, columns = ["crowd", "qb", "mb"], ["crowd", "qb", "mb", "id", "label", "set"]
    return left.select(columns).groupBy(keys).cogroup(right.select(columns).groupBy(keys)).applyInArrow(lambda q, m: _block_links(q, m, percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept`` of every row.

    What is grouped by a band key, or by an id that a bucket's pairs share, is written
    before the rows are joined with it, so Spark can split the rows of a hot key.
    """
    signed = cut(signatures(docs, id_col=id_col, text_col=text_col, n=n))
    known = signed.where("n > 0 AND id IS NOT NULL")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    reps = cut(classes.select(F.col("rep").alias("id"), "n", "s1", "s2", "regs"))
    member = cut(buckets(reps))
    crowded = cut(member.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("rep")).where("size > 1"))
    shared = cut(member.join(crowded, "key").select("key", "id", "rep", "size"))
    release(member, crowded)
    how = {"id_col": id_col, "text_col": text_col, "n": n, "percent": percent}

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def confirmed(pairs):
        tried = cut(pairs.distinct())
        near = cut(likely(tried, reps, percent))
        found = cut(verify(near, docs, **how))
        release(near)
        return tried, found

    def mixed_buckets(labels):
        """Rows of buckets that hold several components, with a representative drawn by hash."""
        seen = cut(shared.join(labels, "id", "left").select("key", "id", "size", F.coalesce("label", "id").alias("label")))
        mixed = seen.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "label")).alias("rep")).where("lo <> hi")
        mixed = cut(mixed.select("key", F.col("rep.id").alias("rep"), F.col("rep.label").alias("rep_label")))
        found = cut(seen.join(mixed, "key"))
        release(seen, mixed)
        return found

    tried, links = confirmed(shared.where("id <> rep").select(*pair(F.col("id"), F.col("rep"))))
    seen = mixed_buckets(components(links))
    few = seen.where(F.col("size") <= SMALL_BUCKET)
    pairs = few.select("key", F.col("id").alias("x"), F.col("label").alias("x_label")).join(few.select("key", F.col("id").alias("y"), F.col("label").alias("y_label")), "key").where("x < y AND x_label <> y_label").select(F.col("x").alias("a"), F.col("y").alias("b"))
    tried_too, more = confirmed(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    release(shared, tried, tried_too)
    links = links.union(more)
    labels = components(links)
    crowd = seen.where(F.col("size") > SMALL_BUCKET).select("id", "rep")
    if not crowd.isEmpty():
        links = links.union(cut(crowd_links(crowd, labels, reps, docs, **how)))
        labels = components(links)
    of_class = reps.join(labels, "id", "left").select("n", "s1", "s2", F.coalesce("label", "id").alias("component"))
    out = signed.select("id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), sets AS (
  SELECT min(doc_id) AS rep, len(list_sort(s)) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), e AS (SELECT rep, n, unnest(s) AS g FROM sets),
inter AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep
), link AS (
  SELECT a, b FROM inter WHERE 100 * k >= 80 * (na + nb - k)
  UNION ALL SELECT b, a FROM inter WHERE 100 * k >= 80 * (na + nb - k)
), walk AS (
  WITH RECURSIVE r(id, x) AS (
    SELECT rep, rep FROM sets UNION SELECT r.id, link.b FROM r JOIN link ON r.x = link.a
  ) SELECT id, min(x) AS component FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id,
       coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s AND len(s.s) > 0 LEFT JOIN walk ON walk.id = sets.rep
"""
