"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their class counts, and a linear
hinge-loss model on the scaled indicators is fitted by dual coordinate descent.
The counts cover every labelled row; the hinge loss is fitted on a bounded sample of
labelled rows (``fit_rows``, about that many, chosen by a hash of the id).

Defined cases: null text counts as empty and scores by the bias alone; rows whose
label is null are not learned from; of several labels for one id the largest counts;
with no labels every score is 0.5; an empty table gives an empty result.  Other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_below, labelled, per_slice, platt, sample_fraction, sigmoid, small_batches
from .ngrams import BUCKETS, indicators

#: Expected rows of the sample that the hinge loss is fitted on.
FIT_ROWS = 6000


@dataclass
class Model:
    #: weight of each bucket, the log-count ratio included
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        size = np.sqrt(np.maximum(np.bincount(doc, minlength=n_docs), 1))
        return np.bincount(doc, self.weight[bucket], minlength=n_docs) / size + self.bias


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, *, c: np.ndarray, rounds: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise ``|w|^2 / 2 + sum c * hinge``; rows are (index, value) pairs, y is -1 or 1."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                worst = max(worst, abs(step) * q[i])
            alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, smooth: float = 1.0) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` covers."""
    known = labelled(docs.select(id_col, text_col), labels, label, id_col).select(F.col("_label"), F.col(text_col).alias("text"), F.col(id_col))

    def count(batches):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        seen = np.zeros(2, dtype=np.int64)

        def add(rows, data, offsets):
            y = (rows.column(0).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            doc, bucket = indicators(data, offsets)
            np.add(total, np.bincount(y[doc] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS), out=total)
            np.add(seen, np.bincount(y, minlength=2), out=seen)

        for _ in per_slice(add)(batches):
            pass
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, BUCKETS]), pa.array(np.r_[total[0][at], seen[0]]), pa.array(np.r_[total[1][at], seen[1]])], names=["bucket", "n0", "n1"])

    counts = np.zeros((2, BUCKETS + 1))
    summed = known.transform(small_batches).mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    for part in summed.toPandas().itertuples(index=False):
        counts[:, part.bucket] = part.n0, part.n1
    n = counts[:, BUCKETS]
    if n.min() == 0:
        offset = 0.0 if n.sum() == 0 else (35.0 if n[1] else -35.0)
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, offset)
    p = (counts[:, :BUCKETS] + smooth) / (n[:, None] + 2 * smooth)
    ratio = np.log(p[1] / p[0])

    def sparse(rows, data, offsets):
        doc, bucket = indicators(data, offsets)
        ends = np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))
        cells = [x.astype(np.int32).tobytes() for x in np.split(bucket, ends[:-1])]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cells, pa.binary())], names=["y", "h", "cells"])

    part = known.where(hashed_below(id_col, sample_fraction(int(n.sum()), fit_rows))).select("_label", F.xxhash64("text").alias("h"), "text")
    got = part.transform(small_batches).mapInArrow(per_slice(sparse), "y int, h long, cells binary").toPandas()
    # by the texts' hashes, so that the order rows arrive in decides nothing and equal texts fall on one side
    got = got.sort_values(["h", "y"], kind="stable")
    y = np.where(got["y"].to_numpy() > 0, 1.0, -1.0)
    cells = [np.frombuffer(x, dtype=np.int32) for x in got["cells"]]
    rows = [(x, ratio[x] / np.sqrt(max(len(x), 1))) for x in cells]
    fit = got["h"].to_numpy() % 4 != 3
    if not fit.any():  # a handful of rows: better fitted than calibrated
        fit = ~fit
    share = np.array([max((y[fit] < 0).mean(), 1e-3), max((y[fit] > 0).mean(), 1e-3)])
    c = np.where(y > 0, 0.5 / share[1], 0.5 / share[0])
    w, bias = dual_coordinate_descent([r for r, f in zip(rows, fit, strict=True) if f], y[fit], BUCKETS, c=c[fit])
    margin = np.array([w[at] @ v + bias for at, v in rows])
    slope, offset = platt(margin[~fit], (y[~fit] > 0).astype(float))
    return Model((w * ratio).astype(np.float32), float(bias), slope, offset)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row."""

    def step(rows, data, offsets):
        doc, bucket = indicators(data, offsets)
        margin = model.margin(doc, bucket, len(offsets) - 1)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(sigmoid(model.slope * margin + model.offset))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(per_slice(step), f"{id_col} {kind}, score double")
