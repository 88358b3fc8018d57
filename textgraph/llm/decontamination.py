"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items are sought inside long documents.  Items fall into classes by their number of
distinct shingles (each class spans a factor of two).  For each class a document is cut
into blocks of as many shingles as the largest item of the class has, and the MinHash of
every two neighbouring blocks is the lesser of theirs; any run of shingles as long as an
item lies in one such window, whose size is bounded by the class.  That bound turns the
wanted containment into a Jaccard similarity and so into the number of hash functions
with which a window that holds the item agrees in at least one with a chance of
1 - MISS.  Agreeing pairs are candidates, which the exact shingle containment over the
whole document, compared word by word, confirms or rejects.

Documents are never shuffled: the items go to them, in blocks of a bounded size
(BLOCK_ITEMS and BLOCK_BYTES), so any number of items is one pass a block; of several blocks
each is done and dropped before the next one is sent.

Words are runs of ASCII letters (folded to lower case), digits and non-ASCII characters; a
shingle is five of them, or all of an item that has fewer.  Items without a word match
nothing, and so do null or empty documents.  Repeated document rows give repeated rows;
an item that is repeated with the same text counts once.  Very long documents are a chunk of
their own; empty tables of documents or items give no matches; other columns of the documents
are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

WIDTH = 5
THRESHOLD = 0.8
#: Chance that no hash function agrees for a window that holds an item.
MISS = 1e-6
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _factor(i: int) -> np.uint32:
    return np.uint32(int(kernels.mix(np.array([i + 1], np.uint64))[0]) & 0xFFFFFFFF | 1)


class _Class:
    """Items of one shingle width and one span of sizes, by the MinHash of each function."""

    def __init__(self, width: int, members: list[int], hashes: list[np.ndarray], threshold: float):
        self.width, self.members = width, np.array(members)
        sizes = [len(hashes[i]) for i in members]
        self.block, least = max(sizes), min(sizes)
        found = max(1, math.ceil(threshold * least))
        jaccard = found / (2 * self.block + least - found)
        self.n = max(1, math.ceil(math.log(MISS) / math.log1p(-min(jaccard, 0.999999))))
        low = [_low(hashes[i]) for i in members]
        bits = 20 if len(members) < 1 << 14 else 25
        self.mask, self.tables = np.uint32((1 << bits) - 1), []
        for i in range(self.n):
            least_of = np.array([(x * _factor(i)).min() for x in low], np.uint32)
            order = np.argsort(least_of, kind="stable")
            self.tables.append((least_of[order], order))
        self.may = np.zeros((1 << bits), bool)
        for vals, _ in self.tables:
            self.may[vals >> np.uint32(4) & self.mask] = True

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        n = np.diff(bounds)
        blocks = -(-n // self.block)
        first = np.concatenate([[0], np.cumsum(blocks)])
        total = int(first[-1])
        if not total:
            return set()
        row = np.repeat(np.arange(len(n)), n)
        # a block that is not full repeats its first shingle, which leaves its minimum as it is
        block_row = np.repeat(np.arange(len(n)), blocks)
        heads = bounds[:-1][block_row] + (np.arange(total) - first[:-1][block_row]) * self.block
        low = _low(h)
        flat = np.repeat(low[heads], self.block)
        flat[first[:-1][row] * self.block + np.arange(len(h)) - bounds[:-1][row]] = low
        grid = np.ascontiguousarray(flat.reshape(total, self.block).T)
        alone = np.ones(total, bool)
        alone[:-1] = block_row[1:] != block_row[:-1]
        out: set[tuple[int, int]] = set()
        work = np.empty_like(grid)
        for i, (vals, order) in enumerate(self.tables):
            np.multiply(grid, _factor(i), out=work)
            least = work.min(axis=0)
            pair = least.copy()
            np.minimum(least[:-1], least[1:], out=pair[:-1])
            pair = np.where(alone, least, pair)
            at = np.flatnonzero(self.may[pair >> np.uint32(4) & self.mask])
            a, b = np.searchsorted(vals, pair[at], "left"), np.searchsorted(vals, pair[at], "right")
            for w, x, y in zip(at[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                for k in range(x, y):
                    out.add((int(block_row[w]), int(self.members[order[k]])))
        return out


class Index:
    """A block of items, ready to be sought in chunks of documents."""

    def __init__(self, ids: list, texts: list[str], threshold: float = THRESHOLD, width: int = WIDTH):
        self.ids, self.threshold = ids, threshold
        data, offsets = kernels.column_bytes(pa.array(texts, pa.string()))
        self.data = kernels.LOWER[data] if len(data) else data
        wh, starts, ends, bounds = kernels.words(data, offsets)
        self.hashes: list[np.ndarray] = []
        self.shingles: list[list[tuple[bytes, ...]]] = []
        self.width: list[int] = []
        classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(len(texts)):
            span = slice(bounds[i], bounds[i + 1])
            n = bounds[i + 1] - bounds[i]
            h, first, _ = kernels.shingles(wh[span], np.array([0, n]), width)
            h, at = np.unique(h, return_index=True)
            words = [self.data[a:b].tobytes() for a, b in zip(starts[span], ends[span], strict=True)]
            self.hashes.append(h)
            self.width.append(min(width, int(n)))
            self.shingles.append([tuple(words[f : f + self.width[i]]) for f in first[at]])
            if len(h):
                classes[self.width[i], len(h).bit_length()].append(i)
        self.classes = [_Class(w, members, self.hashes, threshold) for (w, _), members in sorted(classes.items())]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, number of common distinct shingles) of the pairs at or above the threshold."""
        out = []
        low = kernels.LOWER[data] if len(data) else data
        wh, starts, ends, bounds = kernels.words(data, offsets)
        n_words = np.diff(bounds)
        for width in sorted({c.width for c in self.classes}):
            h, first, sb = kernels.shingles(wh, bounds, width)
            if width > 1:  # a text of fewer words has no shingle of this width
                full = np.repeat(n_words >= width, np.diff(sb))
                h, first = h[full], first[full]
                sb = np.concatenate([[0], np.cumsum(np.where(n_words >= width, np.diff(sb), 0))])
            pairs = set().union(*(c.candidates(h, sb) for c in self.classes if c.width == width))
            row, order = -1, None
            for r, item in sorted(pairs):
                if r != row:
                    row, own = r, h[sb[r] : sb[r + 1]]
                    order = np.argsort(own)
                    own = own[order]
                want = self.hashes[item]
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hit = np.flatnonzero(own[place] == want)
                if len(hit) < self.threshold * len(want):
                    continue
                common_count = 0
                for k in hit.tolist():
                    f = int(first[sb[r] + order[place[k]]])
                    if all(low[starts[f + j] : ends[f + j]].tobytes() == w for j, w in enumerate(self.shingles[item][k])):
                        common_count += 1
                if common_count >= self.threshold * len(want):
                    out.append((r, item, common_count))
        return out


def _indexes(items: DataFrame, threshold: float) -> Iterator[tuple[Index, bool]]:
    """Indexes over blocks of at most about BLOCK_ITEMS items or BLOCK_BYTES of text."""
    rows = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(blocks):  # with the number of blocks, the last of which may stay lazy
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in part], [r["text"] for r in part], threshold), b == blocks - 1


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, n_common, n_item): the items of which a document has at least the threshold's share of shingles."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("n_common", T.LongType()), T.StructField("n_item", T.LongType())])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    parts = []
    for index, last in _indexes(items, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b, data, offsets in kernels.chunked(batch.column("t")):
                    found = index.search(data, offsets)
                    if found:
                        ids = batch.column("id").slice(a, b - a).take(pa.array([r for r, _, _ in found]))
                        item_type = pa.array(index.ids).type
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([index.ids[i] for _, i, _ in found], item_type), pa.array([c for _, _, c in found], pa.int64()), pa.array([len(index.hashes[i]) for _, i, _ in found], pa.int64())],
                            ["id", "item_id", "n_common", "n_item"],
                        )

        found = texts.mapInArrow(run, schema)
        parts.append(found if last else common.written(found))
        if not last:
            shared.destroy()
    return common.union_all(parts)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item; columns as before."""
    names = docs.columns
    for index, last in _indexes(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in kernels.chunked(batch.column(text_col)):
                    for r, _, _ in index.search(data, offsets):
                        keep[a + r] = False
                yield batch.filter(pa.array(keep)).select(names)

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = common.written(docs)
            shared.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_common", "n_item", F.round(F.col("n_common") / F.col("n_item"), 6).alias("containment"))


#: For items of at least five words, as all of the table are.
ORACLE = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS s FROM w WHERE len(ws) >= 5
), n AS (
  SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id
), m AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM s d JOIN s i ON d.s = i.s WHERE d.kind = 0 AND i.kind = 1 GROUP BY d.id, i.id
)
SELECT doc_id, item_id, CAST(c AS BIGINT) AS n_common, CAST(n AS BIGINT) AS n_item, round(c / n, 6) AS containment
FROM m JOIN n ON n.id = m.item_id WHERE c >= 0.8 * n
"""
