"""Quality classifier: non-negative positive-unlabelled learning on the shape of a text.

Trusted positives are texts labelled good; unlabelled web text and the class prior do the
rest.  Features: square roots of the frequencies of byte-class pairs (letters of either
case, digits, spaces, line ends and each common mark apart), means of word and line
lengths, shares of repeated words and lines, and the logarithm of the length; all in
numpy, without any per-word code.

Edge cases: a null or empty text has the features of no bytes and gets a score; very long
rows are chunks of their own; without positive labels every text scores the smoothed
prior; an empty table gives no scores; other columns pass through, except one named like
the score, which is replaced; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, pu_learning

THRESHOLD = 0.3
HELD_OUT = (5, 0)

_MARKS = ".,!?|#$%&*-_:;/"
_CLASS = np.zeros(256, np.uint8)  # 0: every other byte
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
_CLASS[32], _CLASS[9:11] = 4, 5
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _i
_N = 6 + len(_MARKS)
EXTRAS = 8
WIDTH = _N * _N + _N + EXTRAS


def _runs(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct hashes over hashes, by row; 1 for rows without any."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.where(n > 0, np.bincount(r[new], minlength=len(n)) / np.maximum(n, 1), 1.0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    cls = _CLASS[data].astype(np.int64)
    row = np.repeat(np.arange(n), size)
    one = np.bincount(row * _N + cls, minlength=n * _N).reshape(n, _N)
    two = np.zeros((n, _N * _N))
    if len(cls) > 1:
        same = row[1:] == row[:-1]
        two = np.bincount((row[1:] * (_N * _N) + cls[:-1] * _N + cls[1:])[same], minlength=n * _N * _N).reshape(n, _N * _N)
    whole, starts, ends, bounds = kernels.words(data, offsets)
    total = np.maximum(size, 1)
    n_words = np.diff(bounds)
    cut = np.flatnonzero(data == 10)
    line_start = np.union1d(cut + 1, offsets[:-1][size > 0])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    lines = kernels.range_hash(kernels.prefix_hash(data), line_start, line_end)
    line_bounds = np.searchsorted(line_start, offsets)
    sh, _, sb = kernels.shingles(whole, bounds, 3)
    extra = np.stack([
        np.log1p(size) / 10, np.log1p(n_words) / 10, size / total / np.maximum(n_words, 1) * 100 / 10,
        np.minimum(np.where(n_words > 0, size / np.maximum(n_words, 1), 0), 30) / 10,
        np.log1p(size / np.maximum(np.diff(line_bounds), 1)) / 5,
        _runs(whole, bounds), _runs(lines, line_bounds), _runs(sh, sb),
    ], axis=1)
    return np.hstack([np.sqrt(one / total[:, None]), np.sqrt(two / total[:, None]), extra]).astype(np.float32)


class Scorer:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, model: pu_learning.Linear):
        self.mean, self.scale, self.model = mean, scale, model

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.model.score((features(data, offsets) - self.mean) / self.scale)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", held_out: tuple[int, int] = HELD_OUT) -> Scorer:
    mod, rest = held_out
    sample, prior = pu_learning.training_rows(docs, labels, target, lambda c: pu_learning.remainder(c, mod) != rest)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in kernels.chunked(batch.column("text")):
                x = features(data, offsets)
                flat = pa.array(x.ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(first, last - first), lists], ["positive", "x"])

    rows = sample.mapInArrow(vectors, "positive boolean, x array<float>").toArrow()
    positive = np.asarray(rows.column("positive").to_numpy(), bool)
    flat = rows.column("x").combine_chunks()
    x = (np.asarray(flat.flatten()) if len(positive) else np.zeros(0, np.float32)).reshape(len(positive), WIDTH)
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH, np.float32)
    scale = np.maximum(x.std(axis=0), 1e-2) if len(x) else np.ones(WIDTH, np.float32)
    x = (x - mean) / scale
    xp, xu = x[positive], x[~positive]
    del x, flat, rows
    return Scorer(mean, scale, pu_learning.fit_nnpu(xp, xu, prior))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, common.table(spark, sf_dir, "labels"))
    mod, rest = HELD_OUT
    return pu_learning.with_score(docs, "text", scorer).select(
        "doc_id", (pu_learning.remainder(F.col("doc_id"), mod) == rest).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
