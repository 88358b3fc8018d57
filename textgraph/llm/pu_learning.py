"""Non-negative positive-unlabelled learning in numpy, and the sampling that feeds it.

The risk minimised is  pi*E_P[l(f)] + max(0, E_U[l(-f)] - pi*E_P[l(-f)])  with the logistic
loss l, where P are trusted positives, U unlabelled rows and pi the class prior, so that
sigmoid(f) estimates the chance of label 1.  When the bracket goes below zero the step
climbs it instead, which keeps a flexible model from fitting P exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

#: Most rows that a model is fitted on; the only bound, and it does not touch scoring.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f, -40, 40)))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, *, epochs: int = 200, rate: float = 0.05, l2: float = 1e-4) -> Linear:
    """A linear model by full-batch Adam on the non-negative risk; deterministic."""
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    d = (xp if len(xp) else xu).shape[1]
    if not len(xp) or not len(xu):
        return Linear(np.zeros(d), float(np.log(prior / (1 - prior))))
    w, b = np.zeros(d + 1), float(np.log(prior / (1 - prior)))
    w[-1] = b
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, epochs + 1):
        low = w[:-1].astype(xp.dtype)  # else numpy copies the matrices at every step
        fp, fu = (xp @ low).astype(float) + w[-1], (xu @ low).astype(float) + w[-1]
        sp, su = sigmoid(fp), sigmoid(fu)
        negative = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
        # gradients of the three expectations with respect to f
        gp_pos, gp_neg, gu_neg = (sp - 1) * prior / len(fp), sp * prior / len(fp), su / len(fu)
        if negative >= 0:
            dp, du = gp_pos - gp_neg, gu_neg
        else:
            dp, du = gp_neg, -gu_neg
        g = np.empty(d + 1)
        g[:-1] = dp.astype(xp.dtype) @ xp + du.astype(xu.dtype) @ xu + l2 * w[:-1]
        g[-1] = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:-1].copy(), float(w[-1]))


def remainder(doc_id: Column, mod: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, learnable: Callable[[Column], Column]) -> tuple[DataFrame, float]:
    """(text, positive) of a bounded sample, and the class prior.

    Only ids for which ``learnable`` holds take part.  Positives are labelled 1; the
    unlabelled rows come from all such documents whatever their label.  The prior is the
    smoothed share of label 1.  A document labelled twice counts as positive if any says so.
    """
    marks = (
        labels.filter(F.col(target).isNotNull() & learnable(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(target).alias("y"))
    )
    n, k = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (k + 1) / (n + 2)
    pos = marks.filter(F.col("y") == 1).select("doc_id").orderBy(F.xxhash64("doc_id")).limit(MAX_POSITIVE)
    unl = docs.filter(learnable(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(MAX_UNLABELLED)
    # at most MAX_POSITIVE + MAX_UNLABELLED ids: a proven bound for the broadcast
    ids = pos.withColumn("positive", F.lit(True)).unionByName(unl.distinct().withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "positive")
    return common.written(rows), prior


def with_score(docs: DataFrame, text_col: str, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """docs with a double column: the scorer over chunks of whole texts; other columns pass through."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer(data, offsets) for _, _, data, offsets in kernels.chunked(batch.column(text_col))]
            col = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), col], [*names, out])

    return docs.mapInArrow(run, schema)
