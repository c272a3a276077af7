"""Benchmark decontamination with a distributed positional inverted index.

Benchmark items are cut into windows of consecutive words.  The counts of their words
in the corpus give each window's rarest terms; the index stores (term, document,
position) for those terms only.  Their offset-adjusted postings are intersected:
postings of one alignment (document, item, shift) meet in one group, and an
alignment goes on if it has as many of its rarest terms as a true match must have.
The remaining words are then compared in order, which gives exact phrase matches;
``proximity`` returns alignments by how near the rare terms of an item stand.

Only DataFrame functions are used.  Words are runs of ASCII letters, digits and
bytes above ASCII, with ``A-Z`` lower-cased.

Defined cases: null or wordless text has no words and no hits; null or wordless items
have no window; rows that are equal in id and text have equal results; an empty
benchmark leaves everything clean; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small, cut

WINDOW = 13
#: Rarest terms of each window whose postings are stored.
RAREST = 2

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct word sequences of the benchmark with the ids that share each."""
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
        .where(F.size("item_words") > 0)
        .groupBy("item_words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .withColumn("item", F.sha2(F.concat_ws(" ", "item_words"), 256))
    )


def rare_places(items: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """(term, item, place, need): the places of the rarest terms of every window of every item.

    ``need`` is how many of its places a match must show at least.
    """
    span = F.least(F.size("item_words"), F.lit(window))
    places = items.select("item", F.posexplode("item_words").alias("place", "term")).join(counts, "term", "left").select("item", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    # every window holds its own places only, so a long item grows by the window's size and no more
    windows = items.select("item", span.alias("span"), F.explode(F.sequence(F.lit(0), F.size("item_words") - span)).alias("start"))
    held = windows.select("item", "span", "start", F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("place")).join(places, ["item", "place"])
    ranked = held.groupBy("item", "start", "span").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("by_rarity"))
    chosen = ranked.select("item", F.least("span", F.lit(rarest)).alias("need"), F.explode(F.slice("by_rarity", 1, rarest)).alias("t"))
    return chosen.select(F.col("t.term").alias("term"), "item", F.col("t.place").alias("place"), "need").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, document key, position) for the given terms."""
    tokens = docs.select("id", "tie", F.posexplode(words_of(F.col("text"))).alias("at", "term"))
    return tokens.join(terms, "term", "left_semi").select("term", "id", "tie", "at")


def _places(docs: DataFrame, items: DataFrame, window: int, rarest: int) -> DataFrame:
    """``rare_places`` of the items by the words' counts in the documents, kept."""
    vocabulary = cut(items.select(F.explode("item_words").alias("term")).distinct())
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = tokens.join(broadcast_if_small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return cut(rare_places(items, counts, window, rarest))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))


def alignments(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(id, tie, item, shift): where enough of an item's rarest terms stand at their places; every phrase match is among them."""
    places = _places(docs, items, window, rarest)
    index = cut(postings(docs, broadcast_if_small(places, places.select("term").distinct())))
    met = index.join(broadcast_if_small(places), "term").select("id", "tie", "item", (F.col("at") - F.col("place")).alias("shift"), "place", "need")
    return met.groupBy("id", "tie", "item", "shift").agg(F.count_distinct("place").alias("n"), F.max("need").alias("need")).where("n >= need").select("id", "tie", "item", "shift")


def phrases(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact matches: (id, tie, item, item_ids, first, last) for every occurrence of a window, as positions of words."""
    return _phrases(_keyed(docs, id_col, text_col), items_of(benchmark, item_col, item_text_col), window)


def _phrases(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    items = cut(items)
    met = cut(alignments(docs, items, window=window))
    # of the texts only those of documents with an alignment move
    rows = broadcast_if_small(met, met.select(F.col("id").alias("_id"), F.col("tie").alias("_tie")).distinct())
    texts = docs.join(rows, docs["id"].eqNullSafe(rows["_id"]) & (docs["tie"] == rows["_tie"]), "left_semi").select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "text")
    found = met.join(broadcast_if_small(items), "item")
    per_doc = found.join(texts, found["id"].eqNullSafe(texts["_id"]) & (found["tie"] == texts["_tie"])).select("id", "tie", "item", "item_ids", "item_words", "shift", words_of(F.col("text")).alias("words"))
    span = F.least(F.size("item_words"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_words") - span, F.size("words") - span - F.col("shift")))
    fits = F.least(F.size("item_words") - span, F.size("words") - span - F.col("shift")) >= F.greatest(F.lit(0), -F.col("shift"))
    same = F.filter(starts, lambda s: F.slice("words", s + F.col("shift") + 1, span) == F.slice("item_words", s + 1, span))
    hit = per_doc.where(fits).select("id", "tie", "item", "item_ids", "shift", span.alias("span"), F.explode(same).alias("start"))
    return hit.select("id", "tie", "item", "item_ids", (F.col("start") + F.col("shift")).alias("first"), (F.col("start") + F.col("shift") + F.col("span") - 1).alias("last")).distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int = 10, share: float = 0.6) -> DataFrame:
    """Near matches: documents in which at least ``share`` of an item's rare places occur with shifts within ``slack`` words of each other.

    Shifts are dealt into overlapping bands of ``2 * slack`` so that no group is larger
    than what one document holds.  Returns (id, tie, item, band, places, of).
    """
    docs = _keyed(docs, id_col, text_col)
    items = cut(items_of(benchmark, item_col, item_text_col))
    places = _places(docs, items, window, RAREST)
    of = places.groupBy("item").agg(F.count_distinct("place").alias("of"))
    met = postings(docs, broadcast_if_small(places, places.select("term").distinct())).join(broadcast_if_small(places), "term")
    band = F.floor((F.col("at") - F.col("place")) / F.lit(slack))
    met = met.withColumn("band", F.explode(F.array(band, band - 1)))
    grouped = met.groupBy("id", "tie", "item", "band").agg(F.count_distinct("place").alias("places"))
    return grouped.join(broadcast_if_small(items, of), "item").where(F.col("places") >= F.lit(share) * F.col("of"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col``, ``tie``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` and ``contaminated`` of every row."""
    keyed = _keyed(docs, id_col, text_col)
    matched = cut(_phrases(keyed, items_of(benchmark, item_col, item_text_col), window))
    hit = matched.select("id", "tie", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("id", "tie").agg(F.count("*").alias("n_hit"))
    item_ids = matched.select("id", "tie", "item", "item_ids").distinct().select("id", "tie", F.explode("item_ids").alias("item_id")).groupBy("id", "tie").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    of_doc = hit.join(item_ids, hit["id"].eqNullSafe(item_ids["id"]) & (hit["tie"] == item_ids["tie"])).select(hit["id"].alias("id"), hit["tie"].alias("tie"), "n_hit", "item_ids")
    rows = keyed.select("id", "tie", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(of_doc, rows["id"].eqNullSafe(of_doc["id"]) & (rows["tie"] == of_doc["tie"]), "left").select(rows["id"].alias(id_col), rows["tie"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


ORACLE = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), spans AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM spans),
grams AS (
  SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT g.r, g.s, g.n, p.item_id FROM grams g JOIN spans p ON g.phrase = p.phrase AND g.n = p.n
), hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM found) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN hit_items USING (r)
"""
