"""Suffix-array dedup: bucket-pointer refinement over the places where texts can repeat.

A byte goes if some LENGTH-byte string over it also starts earlier (smaller document, or
earlier in the same one).  Suffixes are never sorted over the whole corpus at once:

1. Every LENGTH-byte window is filed under its anchor, the GRAM-byte substring in it with
   the least hash (leftmost if equal).  Equal windows have equal anchors at equal places,
   so windows can only repeat under anchors that do.  About one byte in 35 is an anchor.
   Anchors are counted where they are read first (one row for each block of text, however
   many copies it holds), then by hash.
2. Only under repeated anchors are the windows' bytes sent out, by anchor hash.  The group
   of an anchor that is repeated more than HOT times is dealt out by the windows' own
   hashes instead, so no task gets it whole.
3. Within a group, equal contexts are folded, and the suffixes at the windows of the rest
   are put into buckets by their first 8 bytes, which are refined by sorting on the bucket
   identifiers at offset 8, 16, 32 and 36 (to depths 16, 32, 64 and 100); each pass uses the
   identifiers the pass before made, and buckets of one suffix take no further part.  In a
   bucket of equal strings, all but the first by (document, start) are repeats.

Equality is always of bytes, hashes only bring candidates together.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; equal rows follow
each other in the order of common.with_uid, so the later one is removed; ids may repeat or
be null; matches never cross rows; a very long text is a chunk of its own; an empty table
gives no rows; only the columns uid and t are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of text over which anchors are counted before any shuffle.
BLOCK_BYTES = 16 << 20
#: Repeats from which a group is dealt out by window; more on large inputs, see HOT_KEYS.
HOT = 20_000
#: Most anchors that can be hot; their hashes go to every task (32 MB at most).
HOT_KEYS = 4_000_000
#: Bytes of contexts that are refined together; groups are not divided.
REFINE_BYTES = 4 << 20
_U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first window, last window) of each anchor; windows by their start in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(_U), none, none
    prefix = kernels.prefix_hash(data)
    n = len(data) - GRAM + 1
    h = kernels.mix((prefix[GRAM:] - prefix[:n]) * kernels._powers(kernels._BASE_INV, n))
    bits = _U(max(24, int(n).bit_length()))
    low = (_U(1) << bits) - _U(1)
    v = (h & ~low) | np.arange(n, dtype=_U)
    width = 1
    least = v
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        k = SPAN - width
        least = np.minimum(least[:-k], least[k:])
    at = (least & low).astype(np.int64)
    # windows of one row only
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    count = np.maximum(size - LENGTH + 1, 0)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], h[at[first]], start[first], start[last]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pk, h, uid, m): for each block of text the first row of an anchor with the number m of
    its places there (pk is its hash), and every further row with m = 0 (pk spreads them)."""
    for batch in batches:
        for a, b, data, offsets in kernels.chunked(batch.column("t"), BLOCK_BYTES):
            uid = batch.column("uid").slice(a, b - a).to_numpy()
            hs, rows = [], []
            for c, d, x, o in _pieces(data, offsets):
                row, h, _, _ = anchors(x, o)
                hs.append(h)
                rows.append(uid[c:d][row])
            h, u = np.concatenate(hs), np.concatenate(rows)
            order = np.lexsort((u, h))
            h, u = h[order], u[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            other = np.ones(len(h), bool)
            other[1:] = new[1:] | (u[1:] != u[:-1])
            m = np.diff(np.append(np.flatnonzero(new), len(h)))
            more = other & ~new
            f, g = h[new], h[more]
            pk = np.concatenate([f, kernels.mix(g ^ kernels.mix(u[more].astype(_U)))])
            again = np.concatenate([np.zeros(len(f), bool), np.ones(len(g), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pk.view(np.int64)), pa.array(np.concatenate([f, g]).view(np.int64), mask=~again), pa.array(np.concatenate([u[new], u[more]])), pa.array(np.concatenate([m, np.zeros(len(g), np.int64)]).astype(np.int32))],
                ["pk", "h", "uid", "m"],
            )


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + kernels.CHUNK_BYTES, "right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(h, uid, n): the documents of each anchor that has at least two places; n counts them (0: not counted in this row)."""
    rows = texts.mapInArrow(_counted, "pk long, h long, uid long, m int")
    total = F.sum("m").over(Window.partitionBy("pk"))
    kept = rows.withColumn("n", total).filter((F.col("m") == 0) | (F.col("n") > 1))
    return common.written(kept.select(F.coalesce("h", "pk").alias("h"), "uid", "n"))


def _contexts(hot: np.ndarray):
    """Emit (key, uid, first, last, context) for windows under shared anchors; context null: known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernels.chunked(batch.column("t")):
                uid = batch.column("uid").slice(a, b - a).to_numpy()
                lists = batch.column("hs").slice(a, b - a).fill_null([])
                wanted = lists.flatten().to_numpy().view(_U)
                row, h, first, last = anchors(data, offsets)
                size = np.asarray(lists.value_lengths())
                # shared anchors by (row, hash)
                want = np.unique(kernels.mix(wanted ^ kernels.mix(np.repeat(np.arange(len(size), dtype=_U), size))))
                mine = kernels.mix(h ^ kernels.mix(row.astype(_U)))
                keep = np.isin(mine, want)
                row, h, first, last = row[keep], h[keep], first[keep], last[keep]
                is_hot = np.isin(h, hot)
                if is_hot.any():  # one window a row, under its own hash
                    k = (last - first + 1)[is_hot]
                    s = np.repeat(first[is_hot], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    own = kernels.range_hash(kernels.prefix_hash(data), s, s + LENGTH)
                    cold = ~is_hot
                    row = np.concatenate([row[cold], np.repeat(row[is_hot], k)])
                    h = np.concatenate([h[cold], own])
                    first, last = np.concatenate([first[cold], s]), np.concatenate([last[cold], s])
                if not len(row):
                    continue
                # places of equal context in this chunk: all but the first are repeats
                whole = kernels.range_hash(kernels.prefix_hash(data), first, last + LENGTH) + kernels.mix(h)
                order = np.lexsort((first, uid[row], whole))
                row, h, first, last, whole = row[order], h[order], first[order], last[order], whole[order]
                raw = data.tobytes()
                ctx = [raw[x : y + LENGTH] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                head = 0
                for i in range(1, len(ctx)):
                    if whole[i] == whole[head] and ctx[i] == ctx[head]:
                        ctx[i] = None
                    else:
                        head = i
                base = offsets[:-1][row]
                known = np.array([c is None for c in ctx])
                key = np.where(known, kernels.mix(h ^ uid[row].astype(_U)), h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(uid[row]), pa.array(first - base), pa.array(last - base), pa.array(ctx, pa.binary())],
                    ["key", "uid", "first", "last", "ctx"],
                )

    return run


def equal_strings(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the LENGTH-byte strings at ``places``: equal ones for equal strings, in the strings' order.

    ``text`` holds LENGTH bytes or more from each place on.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    # initial buckets: the first 8 bytes as a number
    value = np.zeros(n, _U)
    for k in range(8):
        value = value << _U(8) | padded[k : k + n].astype(_U)
    depth_of = {100: (64, 36), 64: (32, 32), 32: (16, 16), 16: (8, 8)}
    # the places whose identifier each depth needs
    need = {100: places}
    for depth in (100, 64, 32, 16):
        less, step = depth_of[depth]
        need[less] = np.union1d(need[depth], need[depth] + step)
    bucket = np.zeros(n + LENGTH, np.int64)
    order = np.argsort(value[need[8]], kind="stable")
    at = need[8][order]
    bucket[at] = np.cumsum(np.concatenate([[0], (value[at[1:]] != value[at[:-1]]).astype(np.int64)])) if len(at) else 0
    for depth in (16, 32, 64, 100):
        _, step = depth_of[depth]
        at = need[depth]
        b = bucket[at]
        order = np.argsort(b, kind="stable")
        at, b = at[order], b[order]
        same = np.zeros(len(b) + 1, bool)
        same[1:-1] = b[1:] == b[:-1]
        open_ = same[:-1] | same[1:]  # buckets of more than one suffix
        rank = np.arange(len(b))  # an identifier is the place of its bucket's first suffix
        rank = np.maximum.accumulate(np.where(same[:-1], 0, rank))
        if open_.any():
            o, ob = at[open_], rank[open_]
            later = bucket[o + step]
            refined = np.lexsort((later, ob))
            o, ob, later = o[refined], ob[refined], later[refined]
            fresh = np.ones(len(o), bool)
            fresh[1:] = (ob[1:] != ob[:-1]) | (later[1:] != later[:-1])
            where = np.flatnonzero(open_)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0))
            at[open_] = o
            rank[open_] = where[head]
        bucket = np.zeros(n + LENGTH, np.int64)
        bucket[at] = rank
    return bucket[places]


def _refine(key: np.ndarray, uid: np.ndarray, first: np.ndarray, last: np.ndarray, ctx: list[bytes]) -> tuple[list, list, list]:
    """Repeated stretches (uid, start, end) among contexts of whole groups."""
    out_u, out_s, out_e = [], [], []
    # fold equal contexts of a group: all but the first are repeats from end to end
    seen: dict[tuple[int, bytes], int] = {}
    order = np.lexsort((first, uid))
    reps, per_key = [], {}
    for i in order.tolist():
        k = (int(key[i]), ctx[i])
        if k in seen:
            out_u.append(int(uid[i]))
            out_s.append(int(first[i]))
            out_e.append(int(last[i]) + LENGTH)
        else:
            seen[k] = i
            reps.append(i)
            per_key[k[0]] = per_key.get(k[0], 0) + 1
    reps = [i for i in reps if per_key[int(key[i])] > 1]
    if not reps:
        return out_u, out_s, out_e
    text = np.frombuffer(b"".join(ctx[i] for i in reps), np.uint8)
    size = np.array([len(ctx[i]) for i in reps])
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    which = np.repeat(np.arange(len(reps)), windows)
    shift = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    u, s = uid[reps][which], first[reps][which] + shift
    bucket = equal_strings(text, begin[which] + shift)
    order = np.lexsort((s, u, bucket))
    b = bucket[order]
    again = order[1:][b[1:] == b[:-1]]
    # neighbouring repeated windows of a document make one stretch
    u, s = u[again], s[again]
    order = np.lexsort((s, u))
    u, s = u[order], s[order]
    if len(u):
        cut = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1)]))
        ends = np.append(cut[1:], len(u)) - 1
        out_u += u[cut].tolist()
        out_s += s[cut].tolist()
        out_e += (s[ends] + LENGTH).tolist()
    return out_u, out_s, out_e


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; groups are refined together up to REFINE_BYTES, never divided."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: pa.Table) -> pa.RecordBatch:
        key, uid, first, last = (rows.column(c).to_numpy() for c in ("key", "uid", "first", "last"))
        ctx = rows.column("ctx").to_pylist()
        known = np.array([c is None for c in ctx], bool)
        i = np.flatnonzero(~known)
        u, s, e = _refine(key[i], uid[i], first[i], last[i], [ctx[j] for j in i.tolist()])
        u, s, e = [*u, *uid[known].tolist()], [*s, *first[known].tolist()], [*e, *(last[known] + LENGTH).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["uid", "s", "e"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 4096)
            at += part.num_rows
            held.append(part)
            size += part.nbytes
            if size >= REFINE_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut:
                    yield flush(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    size = sum(h.nbytes for h in held)
    if held:
        yield flush(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        kept_texts = []
        starts, ends = batch.column("ss").to_pylist(), batch.column("es").to_pylist()
        for a, b, data, offsets in kernels.chunked(batch.column("t")):
            raw = data.tobytes()
            for i in range(a, b):
                text = raw[offsets[i - a] : offsets[i - a + 1]]
                spans: list[list[int]] = []
                for s, e in sorted(zip(starts[i] or (), ends[i] or (), strict=True)):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
                if keep_text:
                    kept_texts.append(left)
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        arrays = [batch.column("uid"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
        names = ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            arrays, names = [*arrays, pa.array(kept_texts, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def deduplicated(texts: DataFrame, keep_text: bool = True) -> DataFrame:
    """(uid, n_bytes, n_removed, n_spans, kept_sha256, kept) for rows (uid, t) with unique ascending uid."""
    spark = texts.sparkSession
    n = common.partitions(spark)
    shared = shared_anchors(texts)
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_from = max(HOT, total // HOT_KEYS + 1)
    hot = shared.filter(F.col("n") >= hot_from).select("h").distinct().toArrow().column("h").to_numpy().view(_U)
    shared_hot = spark.sparkContext.broadcast(np.sort(hot))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(shared_hot.value)(batches)

    lists = shared.groupBy("uid").agg(F.collect_set("h").alias("hs"))
    # left here too (rows without a list emit nothing), so that both joins read one exchange of the texts
    found = texts.join(lists.hint("merge"), "uid", "left").select("uid", "t", "hs").mapInArrow(contexts, "key long, uid long, first long, last long, ctx binary")
    repeats = found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_repeats, "uid long, s long, e long")
    by_row = repeats.groupBy("uid").agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("es"))
    return texts.join(by_row.hint("merge"), "uid", "left").select("uid", "t", "ss", "es").mapInArrow(
        lambda batches: _cut(batches, keep_text),
        "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = common.with_uid(common.table(spark, sf_dir, "documents").select("doc_id", "text"), out="uid")
    texts = known.select("uid", F.col("text").alias("t"))
    out = deduplicated(texts, keep_text=False)
    ids = known.select("uid", "doc_id")
    return out.join(ids, "uid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
