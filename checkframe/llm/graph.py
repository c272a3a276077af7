"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small, cut, release

#: Links that a task handles at least, so that few links are not dealt over many tasks.
TASK_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` of every id in ``links`` (columns ``a``, ``b``): the smallest id that can be reached.

    Alternates two contractions until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it sees.  The smallest nodes
    are grouped minima, which Spark combines before it shuffles; they are written before
    the links are joined with them, so small ones are broadcast, and else both sides of the
    join are plain shuffles and Spark splits the links of a hub over several tasks.  Steps
    are written by as many tasks as the counted links need.  Links from or to null are left
    out; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # no step has more rows than twice the links
    tasks = 1 + 2 * links.count() // TASK_LINKS
    edges = cut(links.distinct().coalesce(tasks))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks))
        large = cut(both.join(broadcast_if_small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks))
        release(edges, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        onward = large.join(broadcast_if_small(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(onward.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks))
        release(large, low)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
