"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of texts form one small corpus.  An inverted index maps
each adjacent token pair to the positions where it stands; a heap yields the pairs that are
present by merge rank; each pop replays that one merge at all its positions at once and
re-indexes only the neighbours it touched.  As words never influence each other, this
equals the merges of each word alone, but a pair shared by a thousand words is looked up
once.  Texts are then mapped through the finished words, which a worker keeps between
blocks up to a bound (MAX_WORDS; a full table is emptied, which costs time only).

Edge cases: a null or empty text has no tokens; any bytes decode to what was encoded; very
long texts are handled whole; repeated rows give equal rows; an empty table gives no rows;
other columns pass through, and those named like the added ones are an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Finished words that one worker keeps; about 250 bytes each.
MAX_WORDS = 250_000
#: Texts whose distinct new words are replayed together.
BLOCK_ROWS = 1000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.split = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte_pair = np.full((256, 256), -1, np.int64)
        for token, i in ranks.items():
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = i
        self.done: dict[str, bytes] = {}
        self.pair_rank: dict[int, int] = {}  # left << 32 | right -> rank, or -1

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def replay(self, words: list[str]) -> None:
        """Encode distinct words together and keep the results."""
        todo, raws = [], []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:  # a word that is a token stays whole
                self.done[w] = whole.to_bytes(4, "little")
            else:
                todo.append(w)
                raws.append(raw)
        if not todo:
            return
        # one token list for all words; -1 stands after each word
        size = np.array([len(r) + 1 for r in raws])
        ends = np.cumsum(size)
        data = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        tokens = self.single[data]
        tokens[ends - 1] = -1
        rank = self.byte_pair[data[:-1], data[1:]]
        rank[(tokens[:-1] < 0) | (tokens[1:] < 0)] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at], prepend=-1))
        # a rank names the bytes of its pair, whichever two tokens make them up
        index = {int(r): p.tolist() for r, p in zip(rank[at][cut], np.split(at, cut[1:]), strict=True)} if len(at) else {}
        token = tokens.tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = list(index)
        heapq.heapify(heap)
        known, ranks, bytes_of = self.pair_rank, self.ranks, self.bytes_of

        def entered(left: int, right: int, place: int) -> None:
            key = left << 32 | right
            r = known.get(key)
            if r is None:
                r = known[key] = ranks.get(bytes_of[left] + bytes_of[right], -1)
            if r >= 0:
                if r in index:
                    index[r].append(place)
                else:
                    index[r] = [place]
                    heapq.heappush(heap, r)

        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            made = bytes_of[rank]
            for i in places:
                left = token[i]
                if left < 0:
                    continue
                j = after[i]
                right = token[j]
                if right < 0 or bytes_of[left] + bytes_of[right] != made:
                    continue  # a merge at a neighbour has changed this place
                token[i], token[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                if token[k] >= 0:
                    entered(rank, token[k], i)
                h = before[i]
                if h >= 0 and token[h] >= 0:
                    entered(token[h], rank, h)
        out = np.array(token, np.int64)
        alive = out >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        ids = out[alive].astype("<u4").tobytes()
        for w, a, b in zip(todo, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            self.done[w] = ids[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.done) > MAX_WORDS:
            self.done.clear()
        if len(self.pair_rank) > MAX_WORDS:
            self.pair_rank.clear()
        split = [self.split(t) for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        new.difference_update(self.done.keys())
        if new:
            self.replay(list(new))
        get = self.done.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary at a path that every executor can open; read once for each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary.load(path, pattern)
    return _loaded[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, text_col: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """docs with _n_tokens, _ids_sha256, _decoded_sha256 and, if asked for, the ids as _ids; columns of docs by these names are an error."""
    if common.unused(docs.columns, "_n_tokens", "_ids_sha256", "_decoded_sha256", "_ids") != ["_n_tokens", "_ids_sha256", "_decoded_sha256", "_ids"]:
        raise ValueError("docs has columns named as those to be added")
    extra = [T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType())]
    if keep_ids:
        extra.append(T.StructField("_ids", T.BinaryType()))
    schema = T.StructType([*docs.schema.fields, *extra])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                ids = vocab.encode([t or "" for t in batch.column(text_col).to_pylist()])
                cols = [
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(vocab.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], [*names, *(f.name for f in extra)])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids_sha256 AS ids_sha256", "_decoded_sha256 AS decoded_sha256")
