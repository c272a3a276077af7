"""Sharding along a Hilbert curve.

Several metadata columns are quantised at their own quantiles, each row gets the
index of its cell on a Hilbert curve through the grid, and the rows, sorted by curve
index, are cut into runs.  Neighbouring cells stay together, so a reader that prunes
files by minimum and maximum (``ranges``) can do so on every one of the columns.  A
value that many rows share lies in the middle of the quantiles it fills, so columns of
few values spread over the whole grid.  Rows of equal text and metadata have
neighbouring places.

Defined cases: null metadata lies in the lowest cell; null text counts as empty;
repeated rows and ties are placed one after the other; an empty table gives an empty
result.  Other columns of the input are not read, but those in ``keep`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .storage import cut

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell coordinates below ``2 ** bits``.

    Coordinates are turned into the curve's transposed form from the highest bit down
    (exchange or invert the lower bits), Gray-coded and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            high = (x[d] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def _edges(docs: DataFrame, column: str, bits: int) -> list:
    """The ``2 ** bits - 1`` quantiles of a column, repeated where one value fills several; of numbers approximate ones.

    Of other types each distinct value is counted, the values are range-partitioned, and
    the running count of rows gives the quantiles; only these reach the driver.
    """
    parts = 1 << bits
    if isinstance(docs.schema[column].dataType, NumericType):
        return docs.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.005) or []
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(n, "v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("at", 33)))
    offsets = _before(placed.groupBy("_part").agg(F.sum("c").alias("c")), "c")
    own = Window.partitionBy("_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(F.broadcast(offsets), "_part").withColumn("upto", F.col("c_before") + F.sum("c").over(own))
    # the k-th quantile is the first value that brings the running count to k shares
    met = upto.selectExpr("v", f"((upto - c) * {parts}) div c_all + 1 AS first", f"least((upto * {parts}) div c_all, {parts - 1}) AS last").where("first <= last")
    return [r["v"] for r in met.select("v", F.explode(F.sequence("first", "last")).alias("k")).orderBy("k").collect()]


def _before(per_part: DataFrame, *names: str) -> DataFrame:
    """``{name}_before`` and ``{name}_all`` of every partition; ``per_part`` has one row a partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [x for n in names for x in (F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before"), F.sum(n).over(everything).alias(f"{n}_all"))]
    return per_part.select("_part", *sums)


def _cell(docs: DataFrame, column: str, bits: int) -> Column:
    """Middle of the quantiles that a value fills, from 0 to ``2 ** bits - 1``."""
    value = F.col(column).cast("double") if isinstance(docs.schema[column].dataType, NumericType) else F.col(column)
    edges = _edges(docs, column, bits)
    if not edges:
        return F.lit(0)
    places = F.array(*map(F.lit, edges))
    below, upto = F.size(F.filter(places, lambda e: e < value)), F.size(F.filter(places, lambda e: e <= value))
    return F.when(value.isNull(), 0).otherwise(F.shiftright(below + upto, 1))


def shard(docs: DataFrame, *, shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "n_chars"), law: str = "rows", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot`` of every row; kept columns of those names give way.

    law: ``rows`` cuts runs whose counts differ by one at most; ``bytes`` cuts where
    the running size passes each equal share.  Rows are range-partitioned on (curve
    index, text checksum, id), so a cell that holds a third of all rows spreads over
    many tasks; the sorted keys are written once, and places follow from the rows (or
    bytes) of the partitions before, of which only one count a partition is summed.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    names = [f"_dim{i}" for i in range(len(dims))]
    kept = [c for c in dict.fromkeys(keep) if c != id_col]
    keys = docs.select(F.col(id_col), *kept, (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body).alias("_crc"), *(_cell(docs, d, bits).alias(n) for n, d in zip(names, dims, strict=True)))

    @F.pandas_udf("long")
    def curve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    keys = keys.withColumn("_curve", curve(*names)).drop(*names)
    order = ["_curve", "_crc", id_col]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    offsets = _before(placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes")), "_rows", "_bytes")
    placed = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_rows_before") + F.col("_row"))
    if law == "rows":
        placed = placed.withColumn("_shard", F.expr(f"(_rank * {shards}) div _rows_all").cast("int"))
        placed = placed.withColumn("_slot", F.col("_rank") - F.expr(f"(_shard * _rows_all + {shards - 1}) div {shards}"))
    else:
        running = F.sum("_size").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("_middle", 2 * (F.col("_bytes_before") + running) - F.col("_size"))
        placed = placed.withColumn("_shard", F.expr(f"least({shards - 1}, (_middle * {shards}) div (2 * _bytes_all))").cast("int"))
        starts = placed.groupBy("_shard").agg(F.min("_rank").alias("_first"))
        placed = placed.join(F.broadcast(starts), "_shard").withColumn("_slot", F.col("_rank") - F.col("_first"))
    made = {"size": "_size", "text_crc32": "_crc", "curve": "_curve", "shard": "_shard", "slot": "_slot"}
    return placed.select(id_col, *(c for c in kept if c not in {*made, "law"}), *(F.col(v).alias(k) for k, v in made.items()), F.lit(law).alias("law"))


def ranges(placed: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """``shard`` and, for each of ``dims``, ``min_``, ``max_`` and ``null_``: what a reader prunes shards by."""
    stated = [x for d in dims for x in (F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"), F.max(F.col(d).isNull()).alias(f"null_{d}"))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *stated)


def shards_with(stated: DataFrame, column: str, low, high) -> DataFrame:
    """Shards of ``ranges`` that may hold a value from ``low`` to ``high`` in ``column``."""
    return stated.where((F.col(f"min_{column}") <= F.lit(high)) & (F.col(f"max_{column}") >= F.lit(low))).select("shard")


def write_shards(docs: DataFrame, path: str, *, dims: tuple[str, ...] = ("lang", "source", "n_chars"), **how) -> DataFrame:
    """Writes ``docs`` as one folder a shard, rows in curve order, and returns the ``ranges`` of what it wrote."""
    placed = shard(docs, dims=dims, keep=tuple(docs.columns), **how)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return ranges(docs.sparkSession.read.parquet(path), dims)


#: What the law ``rows`` promises of 16 shards.
LAWS_ORACLE = """
SELECT CAST(least(16, count(*)) AS BIGINT) AS shards, count(*) AS rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS total_bytes,
       CAST((count(*) + 15) // 16 AS BIGINT) AS most, CAST(count(*) // 16 AS BIGINT) AS least, true AS gapless FROM documents
"""
