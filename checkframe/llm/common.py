"""Small pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE_BYTES, slices

#: Rows up to which a (doc_id, label) side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


#: Bytes of an Arrow batch; one longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded so that tasks hold little text at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """``crc32(id as text) mod parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of ASCII ``text``, bit by bit from its polynomial."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295)"


def per_slice(step: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | pa.Table | None], column: str = "text", limit: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``step(rows, bytes, offsets)`` to runs of rows of at most ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, column, limit):
                out = step(rows, data, offsets)
                if out is not None:
                    yield out

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that have a label, with it as ``_label``; of several labels for one id the largest counts, null ones do not."""
    side = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label).cast("int").alias("_label"))
    if labels.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return docs.join(side, docs[id_col] == side["_label_id"]).drop("_label_id")


def sample_fraction(rows: int, wanted: int) -> float:
    return 1.0 if rows <= wanted else wanted / rows


def hashed_below(column: str, fraction: float) -> Column:
    """True for a fixed pseudo-random ``fraction`` of the ids."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(1 << 30)) < int(fraction * (1 << 30))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """``(a, b)`` so that ``sigmoid(a * margin + b)`` is the calibrated probability of label 1."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    if n1 == 0 or n0 == 0:
        rate = (n1 + 1) / (n1 + n0 + 2)
        return 1.0, float(np.log(rate / (1 - rate)))
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1).astype(np.float64)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((np.logaddexp(0, z) - target * z).sum())

    beta, now = np.zeros(2), None
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        now = loss(beta)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    return float(beta[0]), float(beta[1])
