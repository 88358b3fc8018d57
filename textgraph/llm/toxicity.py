"""Toxicity: a non-negative positive-unlabelled classifier of word and word-prefix features.

Features are hashes of whole words and of their first 3 to 8 bytes, present or absent in a
text.  The ones kept are those with the largest likelihood-ratio statistic between
confirmed toxic texts and unlabelled ones, counted in Spark over the training sample.

Edge cases: a null or empty text has no features and scores by the bias alone; without any
positive label every text scores the smoothed prior; repeated rows score alike; labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, pu_learning

PREFIXES = (3, 4, 5, 6, 7, 8)
MAX_FEATURES = 1024
MIN_POSITIVES = 5
THRESHOLD = 0.3
HELD_OUT = (4, 2)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and word prefix, with repeats."""
    whole, starts, ends, bounds = kernels.words(data, offsets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    prefix = kernels.prefix_hash(kernels.LOWER[data])
    rows, hashes = [row], [whole]
    for n in PREFIXES:
        at = np.flatnonzero(ends - starts > n)
        hashes.append(kernels.mix(kernels.range_hash(prefix, starts[at], starts[at] + n) ^ np.uint64(n)))
        rows.append(row[at])
    return np.concatenate(rows), np.concatenate(hashes)


class Lookup:
    """Places of 64-bit hashes in a sorted list, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[at]
            out[at[hit]] = place[hit]
        return out


class Scorer:
    def __init__(self, keys: np.ndarray, model: pu_learning.Linear):
        self.keys, self.model = keys, model

    def present(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The distinct (row * number of keys + key) of the features found."""
        if not hasattr(self, "_lookup"):
            self._lookup = Lookup(self.keys)
        row, h = features(data, offsets)
        place = self._lookup(h)
        at = np.flatnonzero(place >= 0)
        return np.unique(row[at] * max(len(self.keys), 1) + place[at])

    def __getstate__(self):
        return {"keys": self.keys, "model": self.model}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, max(len(self.keys), 1)
        found = self.present(data, offsets)
        f = np.bincount(found // k, self.model.weights[found % k], n) if len(found) else np.zeros(n)
        return pu_learning.sigmoid(f + self.model.bias)


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        positive = np.asarray(batch.column("positive").to_numpy(zero_copy_only=False), bool)
        for first, last, data, offsets in kernels.chunked(batch.column("text")):
            row, h = features(data, offsets)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(positive[first:last][row])], ["h", "positive"])


def select(sample: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
    """The hashes of the MAX_FEATURES features that tell positives from unlabelled rows best."""
    n_pos, n_unl = max(n_pos, 1), max(n_unl, 1)
    counts = (
        sample.mapInArrow(_distinct_features, "h long, positive boolean")
        .groupBy("h").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .filter(F.col("p") >= MIN_POSITIVES)
    )
    a, b = (F.col("p") + 0.5) / (n_pos + 1.0), (F.col("u") + 0.5) / (n_unl + 1.0)
    gain = F.col("p") * F.log(a / b) + (n_pos - F.col("p")) * F.log((1.0 - F.least(a, F.lit(1 - 1e-9))) / (1.0 - F.least(b, F.lit(1 - 1e-9))))
    top = counts.withColumn("g", gain).orderBy(F.desc("g"), "h").limit(MAX_FEATURES).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", held_out: tuple[int, int] = HELD_OUT) -> Scorer:
    mod, rest = held_out
    sample, prior = pu_learning.training_rows(docs, labels, target, lambda c: pu_learning.remainder(c, mod) != rest)
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    keys = select(sample, n.get(True, 0), n.get(False, 0))
    blank = Scorer(keys, pu_learning.Linear(np.zeros(len(keys)), 0.0))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = max(len(blank.keys), 1)
        for batch in batches:
            for first, last, data, offsets in kernels.chunked(batch.column("text")):
                at = blank.present(data, offsets)
                cut = np.searchsorted(at, np.arange(last - first + 1) * k)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((at % k).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(first, last - first), lists], ["positive", "at"])

    rows = sample.mapInArrow(found, "positive boolean, at array<int>").toArrow()
    positive = np.asarray(rows.column("positive").to_numpy(), bool)
    x = np.zeros((len(positive), len(keys)), np.float32)
    for i, at in enumerate(rows.column("at").to_pylist()):
        x[i, at] = 1
    model = pu_learning.fit_nnpu(x[positive], x[~positive], prior)
    return Scorer(keys, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, common.table(spark, sf_dir, "labels"))
    mod, rest = HELD_OUT
    return pu_learning.with_score(docs, "text", scorer).select(
        "doc_id", (pu_learning.remainder(F.col("doc_id"), mod) == rest).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
