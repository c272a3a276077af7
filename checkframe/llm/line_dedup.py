"""Line deduplication by a segment-partition edit join.

Equal lines are counted first.  Two distinct lines within ``threshold`` edits share at
least one of ``threshold + 1`` segments, at a place that the lines' lengths bound; each
line is indexed by its own segments, and probes the index of every length up to its
own with the substrings that such a match can have (multi-match-aware selection).
Buckets that hold many distinct lines are refined: the segment that two lines share is
equal, so the edits lie in the rest, which is partitioned in turn (with one edit, the
lines also share the rest less one character).  Candidates are verified by a banded
bit-parallel edit distance: one long holds the differences along a band of
``2 * threshold + 1`` rows, whatever the lines' length, and slides down the diagonal.

Classes are the connected components of the links.  Of each class the first line, by
document id and line number, stays; in every document the other lines go.  A document
is an id and a text (by its hash, ``tie``): rows that share an id, or have none, but
differ in text are documents of their own.

Only DataFrame functions are used.  Lines are split at ``\\n`` and compared without
blanks at their ends.  Lines of fewer than ``min_chars`` characters are compared exactly
only, and lines of fewer than ``min_exact`` or without a word are left alone.

Defined cases: null and empty texts keep what they have; blank lines stay; rows
equal in id and text count as one document (its lines are first in all of them), rows
without an id come last, by line number and ``tie``; an empty table gives an empty
result; extra columns are kept, but those named like a made one give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import cut, kept_bytes, release

THRESHOLD = 1
MIN_CHARS = 20
MIN_EXACT = 1
#: Lines of blanks and control characters for lines alone stay.
A_WORD = r"[^\x20\x09-\x0D]"
#: Distinct lines in one bucket beyond which it is refined.
HOT_BUCKET = 32
#: Bytes on disk up to which a written side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 2 << 20


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its size allows."""
    return F.broadcast(df) if kept_bytes(df) <= BROADCAST_BYTES else df


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_exact: int = MIN_EXACT) -> DataFrame:
    """(id, tie, no, line, n, h1, h2) of every line that has a word and is long enough to be compared; two hashes and the length stand for the line in joins."""
    # a projection of its own: beside the generator the text would be hashed once a line
    keyed = docs.select(F.col(id_col).alias("id"), tie_of(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = keyed.select("id", "tie", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    return hashed(every.select("id", "tie", "no", F.trim("raw").alias("line")).where(F.col("line").rlike(A_WORD))).where(F.col("n") >= min_exact)


def tie_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("n", F.length("line")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def _segments(length: Column, t: int) -> list[tuple[Column, Column]]:
    """(start from 0, size) of the even partition of a line into ``t + 1`` segments; later ones are longer by one."""
    k = t + 1
    small = F.floor(length / k).cast("int")
    longer = length - small * k
    out = []
    for i in range(k):
        extra_before = F.greatest(F.lit(0), longer - (k - i))
        out.append((small * i + extra_before, small + F.when(longer > k - 1 - i, 1).otherwise(0)))
    return out


def _signatures(line: Column, length: Column, t: int, shortest: int, *salt: Column) -> Column:
    """Array of (key, at, size, own): the line's own segments, which are its index entries and probes at once, and its probes of shorter lines' segments.

    ``at`` and ``size`` are where the segment lies in the line.
    """
    made = []
    for shorter in range(t + 1):
        other = length - shorter
        for i, (start, size) in enumerate(_segments(other, t)):
            low, high = max(-i, shorter - (t - i)), min(i, shorter + (t - i))
            for move in range(low, high + 1):
                at = start + move
                key = F.xxhash64(*salt, other, F.lit(i), F.substring(line, at + 1, size))
                made.append(F.when((at >= 0) & (at + size <= length) & (other >= shortest), F.struct(key.alias("key"), at.cast("int").alias("at"), size.cast("int").alias("size"), F.lit(shorter == 0 and move == 0).alias("own"))))
    return F.array_compact(F.array(*made))


def signatures(lines: DataFrame, t: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, h1, h2, at, size, own) of the lines' segments and probes."""
    rows = lines.where(F.col("n") >= min_chars).select("h1", "h2", F.explode(_signatures(F.col("line"), F.col("n"), t, min_chars)).alias("s"))
    return rows.select("s.key", "h1", "h2", "s.at", "s.size", "s.own")


def _refined(rows: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """(key, lid, own): rows of hot buckets, keyed again by the bucket and what lines within ``t`` edits share of the rest.

    With one edit that is the rest whole or less any one character, with more the
    segments of the rest; a newline stands where the bucket's segment was.
    """
    rest = F.expr("concat(substring(line, 1, at), '\\n', substring(line, at + size + 1))")
    wide = rows.join(_small(texts), "lid").select("key", "lid", rest.alias("rest")).withColumn("length", F.length("rest"))
    if t > 1:
        return wide.select("lid", F.explode(_signatures(F.col("rest"), F.col("length"), t, 0, F.col("key"))).alias("s")).select("s.key", "lid", "s.own").distinct()
    less = F.transform(F.sequence(F.lit(0), F.length("rest")), lambda i: F.when(i == 0, F.xxhash64("rest")).otherwise(F.xxhash64(F.concat(F.substring(F.col("rest"), F.lit(1), i - 1), F.substring(F.col("rest"), i + 1, F.length("rest"))))))
    return wide.select(F.explode(F.array_distinct(less)).alias("less"), "key", "lid").select(F.xxhash64("key", "less").alias("key"), "lid", F.lit(True).alias("own")).distinct()


def within(a: Column, b: Column, t: int) -> Column:
    """Whether two arrays of characters are at most ``t`` edits apart; each has at least ``t`` characters.

    Column ``j`` of the distance table is known from row ``j - t`` to ``j + t`` as two bit
    vectors, ``up`` and ``down``: where a row is one more, or one less, than the row
    above it.  ``far`` is the distance at the band's last row, or at the last row of the
    table once the band reaches it.
    """
    size, full = 2 * t + 1, (1 << (2 * t + 1)) - 1
    m, n = F.size(a), F.size(b)

    def equal(j: Column) -> Column:
        """Bit ``k``: the character of row ``j - t + k`` is the column's."""
        here = F.get(b, j - 1)
        bits = [F.when(F.get(a, j - 1 - t + k) == here, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(size)]
        out = bits[0]
        for x in bits[1:]:
            out = out + x
        return F.struct(j.alias("j"), out.cast("long").alias("eq"))

    def step(acc: Column, x: Column) -> Column:
        up, down, eq, j = acc["up"], acc["down"], x["eq"], x["j"]
        same = ((eq.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(full)
        right = down.bitwiseOR(F.bitwise_not(same.bitwiseOR(up))).bitwiseAND(full)
        left = same.bitwiseAND(up)
        slid = F.shiftright(same, 1)
        last = m - j + t
        bottom = F.when(last >= 2 * t, 1 - F.shiftright(same, 2 * t).bitwiseAND(1)).otherwise(F.call_function("shiftright", right, last).bitwiseAND(1) - F.call_function("shiftright", left, last).bitwiseAND(1))
        moved = F.struct(left.bitwiseOR(F.bitwise_not(slid.bitwiseOR(right))).bitwiseAND(full).alias("up"), slid.bitwiseAND(right).alias("down"), (acc["far"] + bottom).cast("long").alias("far"))
        # along the last row the distance can come down once a column, for 2 * t columns at most
        return F.when(acc["far"] > 3 * t, acc).otherwise(moved)

    start = F.struct(F.lit(full - ((1 << t) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(t).cast("long").alias("far"))
    far = F.aggregate(F.transform(F.sequence(F.lit(1), n), equal), start, step, lambda acc: acc["far"])
    return (F.abs(m - n) <= t) & (far <= t)


def links(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(texts, links)``: (lid, h1, h2, line) of lines that share a segment with another one, and pairs (a, b) of them within ``threshold`` edits.

    ``lines`` comes from ``hashed``; repeated lines are one.  Texts are only moved for
    lines whose bucket holds another line.
    """
    if not 1 <= threshold <= min(31, min_chars):
        raise ValueError(f"threshold {threshold}: one long holds bands of 1 to 31 edits, and lines have at least as many characters")
    found = cut(signatures(lines, threshold, min_chars))
    per_key = found.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("indexed"))
    busy = cut(per_key.where("lo <> hi AND indexed").select("key"))
    shared = cut(found.join(_small(busy), "key").distinct())
    release(found, busy)
    near = cut(shared.select("h1", "h2").distinct())
    texts = cut(lines.join(_small(near), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")).withColumn("lid", F.monotonically_increasing_id()))
    named = cut(texts.select("h1", "h2", "lid"))
    rows = cut(shared.join(_small(named), ["h1", "h2"]).select("key", "lid", "at", "size", "own"))
    release(shared, near, named)
    crowd = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT_BUCKET).select("key", F.lit(True).alias("hot")))
    known = rows.join(_small(crowd), "key", "left")
    cold = cut(known.where("hot IS NULL").select("key", "lid", "own"))
    again = cut(_refined(known.where("hot").select("key", "lid", "at", "size"), texts, threshold))
    several = cut(again.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    members = cut(again.join(_small(several), "key"))
    pairs = None
    for part in (cold, members):
        met = part.where("own").select("key", F.col("lid").alias("x")).join(part.select("key", F.col("lid").alias("y")), "key").where("x <> y")
        met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = cut(pairs.distinct())
    release(rows, crowd, cold, again, several, members)
    chars = texts.select("lid", F.length("line").alias("n"), F.split("line", "").alias("chars"))
    sides = pairs.join(chars.toDF("a", "na", "ca"), "a").join(chars.toDF("b", "nb", "cb"), "b").where(F.abs(F.col("na") - F.col("nb")) <= threshold)
    return texts, sides.where(within(F.col("ca"), F.col("cb"), threshold)).select("a", "b")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """One row for each distinct line that is repeated or linked: its hashes, ``copies``, ``n_links``, and the ``first_id``, ``first_tie`` and ``first_no`` of its class."""
    seen = lines_of(docs, id_col, text_col, min_exact)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("no").alias("no"), F.col("tie").alias("tie"))
    lines = cut(seen.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(place).alias("first")))
    texts, near = links(seen, threshold, min_chars)
    near = cut(near)
    label = components(near)
    n_links = near.select(F.col("a").alias("lid")).unionAll(near.select("b")).groupBy("lid").agg(F.count("*").alias("n_links"))
    named = cut(texts.select("lid", "h1", "h2").join(label.select(F.col("id").alias("lid"), "label"), "lid").join(n_links, "lid").select("h1", "h2", "label", "n_links"))
    of = lines.join(_small(named), ["h1", "h2"], "left")
    linked = cut(of.where(F.col("label").isNotNull()))
    first = cut(linked.groupBy("label").agg(F.min("first").alias("class_first")))
    linked = linked.join(_small(first), "label").select("h1", "h2", "copies", "n_links", F.col("class_first").alias("first"))
    alone = of.where(F.col("label").isNull() & (F.col("copies") > 1)).select("h1", "h2", "copies", F.lit(0).cast("long").alias("n_links"), "first")
    out = linked.unionByName(alone)
    return out.select("h1", "h2", "copies", "n_links", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"), F.col("first.no").alias("first_no"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines that occur earlier, and ``n_lines``, ``n_removed``, ``n_links`` in columns of those names.

    Which lines go is found by a join of hashes alone; the line numbers to drop come back
    as one array a document.
    """
    made = cut(classes(docs, id_col=id_col, text_col=text_col, threshold=threshold, min_chars=min_chars, min_exact=min_exact))
    seen = lines_of(docs, id_col, text_col, min_exact).select("id", "tie", "no", "h1", "h2")
    # these two sides grow with the input, so they are shuffled at every size
    hit = seen.join(made, ["h1", "h2"]).withColumn("goes", ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")) & (F.col("no") == F.col("first_no"))))
    hit = hit.select("id", "tie", "no", "goes", "n_links").distinct()
    per_doc = cut(hit.groupBy("id", "tie").agg(F.collect_set(F.when(F.col("goes"), F.col("no"))).alias("gone"), F.sum("n_links").alias("links")))
    # the caller's columns under names that can't clash; its text travels as lines, which give it back
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_links")]
    mine = {c: f"given_{k}" for k, c in enumerate(names)}
    left = docs.select(*(F.split(F.col(c), "\n").alias("lines") if c == text_col else F.col(c).alias(mine[c]) for c in names), tie_of(text_col).alias("own_tie"))
    out = left.join(per_doc, F.col(mine[id_col]).eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.when(F.size("gone") > 0, F.transform(stay, lambda i: F.get(F.col("lines"), i))).otherwise(F.col("lines")), "\n")
    return out.select(
        *(kept.alias(c) if c == text_col else F.col(mine[c]).alias(c) for c in names),
        F.when(F.col("lines").isNull(), 1).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, text FROM documents
), every AS (
  SELECT doc_id, i AS no, trim(l[i], ' ') AS line, l[i] AS kept FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)
), lines AS (
  SELECT line, length(line) AS n, count(*) AS copies, min({'id': doc_id, 'no': no}) AS first FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), near AS (
  SELECT a.line AS a, b.line AS b FROM lines a JOIN lines b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.line <> b.line
  WHERE a.n >= 20 AND b.n >= 20 AND (left(a.line, 8) = left(b.line, 8) OR right(a.line, 8) = right(b.line, 8)) AND levenshtein(a.line, b.line) <= 1
), walk AS (
  WITH RECURSIVE r(line, x) AS (SELECT a, a FROM near UNION SELECT r.line, near.b FROM r JOIN near ON r.x = near.a)
  SELECT line, x FROM r
), class AS (
  SELECT w.line, min(l.first) AS first FROM walk w JOIN lines l ON l.line = w.x GROUP BY w.line
  UNION ALL SELECT line, first FROM lines WHERE line NOT IN (SELECT a FROM near)
), degree AS (SELECT a AS line, count(*) AS d FROM near GROUP BY a),
judged AS (
  SELECT e.doc_id, e.no, e.kept, coalesce(c.first <> {'id': e.doc_id, 'no': e.no}, false) AS goes, coalesce(d.d, 0) AS d
  FROM every e LEFT JOIN class c ON c.line = e.line LEFT JOIN degree d ON d.line = e.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN goes THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, CAST(sum(d) AS BIGINT) AS n_links,
       sha256(coalesce(string_agg(CASE WHEN NOT goes THEN kept END, chr(10) ORDER BY no), '')) AS text_sha256
FROM judged GROUP BY doc_id
"""
