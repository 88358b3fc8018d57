"""MinHash near-dedup with Order MinHash sketches and banded alignment.

Each of SKETCHES sketches hashes a text's word shingles, labelled with their occurrence
number, takes the LENGTH least, and keeps them in text order; texts that agree in a sketch
are likely close in edit distance, as order and repetition count.  Shingles are of WIDTH 2, as
an edit spoils at most two of them: at the threshold itself, with edits as far apart as can
be, a sketch still agrees with the chance that sketch_chance() gives, and SKETCHES of them miss
a pair with at most MISS.  Texts of up to SHORT words have a second set with SHORT_LENGTH in
place of LENGTH, and texts of up to TINY words, where the threshold allows one edit, a key for
each word left out, which finds their pairs for certain.  Equal word sequences
are folded into one representative first (by a 128-bit hash), so thousands of copies are
one row from there on.  The least member of each bucket of equal sketches is its hub, and
members are compared in three steps, each only for members that are not of one class yet:

1. each text with the hub that it shares most sketches with;
2. each text with its other hubs;
3. in buckets that still hold several classes, all pairs of different classes and of lengths
   that the threshold allows; members without such a partner in the bucket stay out, the others
   go in blocks of about BLOCK members or BLOCK_WORDS words on either side.  A task gets the words of a block
   and joins its classes up as it goes: pairs that are of one class by then, or that meet
   in another bucket first, are passed over, lengths, counts of words by bin and the exact
   overlap of the words rule most others out, without loss, and the rest are aligned.
   What a block returns is a forest: fewer links than it has members.

So two copies that share any sketch come into one class, however many texts share their
passage; the time, but neither memory nor what is shuffled as pairs, grows with the square of
the texts in a bucket that are no copies of each other.  A pair is a link if the edit distance
of the word sequences, computed bit-parallel in a band of the width that the threshold
allows, leaves a similarity 1 - d/max(n, m) of at least THRESHOLD; pairs whose lengths rule
that out are never computed.  Classes are the connected components of the links.

Words are runs of ASCII letters (folded), digits and non-ASCII characters.  Texts without
a word (null and empty included) are alike only if their raw texts are equal.  Texts of one
to three words are never within the threshold of another sequence.  Very long texts are a
chunk, and in step 3 a block, of their own.  Rows may repeat, ids may repeat or be null: each
row gets a class, named by the id of its first row.  An empty table gives no classes; columns
of the input come back untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

WIDTH, LENGTH, SKETCHES = 2, 3, 64
THRESHOLD = 0.8
#: Words up to which texts have sketches of SHORT_LENGTH too, and keys for each word left out.
SHORT, SHORT_LENGTH, TINY = 49, 2, 9
#: Chance at most that a pair at the threshold shares no key, however its edits lie (while edits leave the order of shingles).
MISS = 0.01
#: Members of a bucket and their words on one side of a block of pairs, about; bins of the word counts that rule pairs out.
BLOCK, BLOCK_WORDS, BINS = 1024, 1 << 20, 128
#: Bins of lengths to the ratio of lengths that the threshold allows.
LENGTH_STEPS = 16
_U = np.uint64


def _factors(n: int, salt: int) -> np.ndarray:
    return kernels.mix(np.arange(1, n + 1, dtype=_U) + _U(salt << 32)) | _U(1)


def sketch_chance(n: int, length: int) -> float:
    """Chance that a sketch agrees for two texts of n words at the threshold whose edits spoil as many shingles as can be."""
    edits = int((1 - THRESHOLD) * n + 1e-9)
    common = max(0, n - WIDTH + 1 - WIDTH * edits)
    union = 2 * (n - WIDTH + 1) - common
    return float(np.prod([max(0, common - i) / (union - i) for i in range(length)]))


def labelled(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number within its row)."""
    if not len(h):
        return h
    row = np.repeat(np.arange(len(bounds) - 1, dtype=_U), np.diff(bounds))
    c = kernels.mix(h ^ (row * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(c, kind="stable")
    s = c[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    occurrence = np.empty(len(s), _U)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
    return kernels.mix(h + occurrence * _U(0xC2B2AE3D27D4EB4F))


def sketches(h: np.ndarray, bounds: np.ndarray, n: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """An (n, rows) array of sketch keys for rows with at least one shingle (others: see the bounds)."""
    lab = labelled(h, bounds)
    size = np.diff(bounds)
    start = bounds[:-1][size > 0]
    size = size[size > 0]
    bits = _U(24)
    pos = np.arange(len(h)) - np.repeat(start, size)
    pos = (pos >> max(0, int(pos.max(initial=0)).bit_length() - 24)).astype(_U)
    top = ~((_U(1) << bits) - _U(1))
    out = np.empty((n, len(start)), _U)
    for i, f in enumerate(_factors(n, 1)):
        v = ((lab * f) & top) | pos
        least = np.minimum.reduceat(v, start)
        picked = [least]
        for _ in range(length - 1):
            v[v == np.repeat(picked[-1], size)] = ~_U(0)
            picked.append(np.minimum.reduceat(v, start))
        low = ~top
        ranked = np.stack(picked)
        order = np.argsort(np.where(ranked == ~_U(0), ~_U(0), ranked & low), axis=0, kind="stable")
        ranked = np.take_along_axis(ranked, order, axis=0)
        key = np.full(len(start), (length << 16) + i + 1, _U)
        for r in ranked:  # the hash without the place, in text order
            key = kernels.mix(key * _U(0xD6E8FEB86659FD93) + np.where(r == ~_U(0), _U(1), r & top))
        out[i] = key
    return out


def _row_hash(wh: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """One hash for the sequence of words of each row."""
    f = kernels.mix(wh ^ _U(salt))
    base = int(_factors(1, salt)[0]) | 1
    p = np.zeros(len(f) + 1, _U)
    powers = np.full(len(f) + 1, base, _U)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=_U)
    inverse = np.full(len(f) + 1, pow(base, -1, 1 << 64), _U)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=_U)
    np.cumsum(f * powers[:-1], out=p[1:])
    n = np.diff(bounds).astype(_U)
    return kernels.mix((p[bounds[1:]] - p[bounds[:-1]]) * inverse[bounds[:-1]] + n * _U(0x9E3779B97F4A7C15))


def binned(wh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each row's counts of words by bin."""
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows), np.diff(bounds)) * BINS + (kernels.mix(wh) % _U(BINS)).astype(np.int64)
    return np.bincount(at, minlength=rows * BINS).astype(np.int32).reshape(rows, BINS)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least so many edits lie between texts with these counts by bin."""
    d = x - y
    return np.maximum(np.maximum(d, 0).sum(axis=1, dtype=np.int64), np.maximum(-d, 0).sum(axis=1, dtype=np.int64))


def _open_pairs(n: np.ndarray, root: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) members of different classes that neither lengths nor counts by bin rule out."""
    coarse = bins.reshape(len(bins), 16, -1).sum(axis=2, dtype=np.int32)
    step = max(1, (1 << 18) // max(1, len(right)))
    for lo in range(0, len(left), step):
        part = left[lo : lo + step]
        longest = np.maximum(n[part][:, None], n[right][None, :])
        most = ((1 - THRESHOLD) * longest + 1e-9).astype(np.int64)
        ok = (root[part][:, None] != root[right][None, :]) & (np.abs(n[part][:, None] - n[right][None, :]) <= most)
        i, j = np.nonzero(ok)
        most, i, j = most[i, j], part[i], right[j]
        for counts in (coarse, bins):
            near = np.ones(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                near[k : k + (1 << 16)] = _apart(counts[i[k : k + (1 << 16)]], counts[j[k : k + (1 << 16)]]) <= most[k : k + (1 << 16)]
            most, i, j = most[near], i[near], j[near]
        yield i, j


class _Block:
    """The members of a bucket on both sides of a block, and the links that join their classes up."""

    def __init__(self, key: int, uid: np.ndarray, root: np.ndarray, keys: list[np.ndarray], words: list[np.ndarray]):
        self.key, self.uid, self.root, self.keys, self.words = key, uid, root, keys, words
        self.n = np.array([len(w) for w in words])
        self.above = {int(r): int(r) for r in root}
        self.bags: dict[int, np.ndarray] = {}

    def _find(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def _bag(self, i: int) -> np.ndarray:
        """The words with their occurrence numbers, as sorted hashes."""
        if i not in self.bags:
            w = self.words[i].astype(_U)
            self.bags[i] = np.unique(labelled(w, np.array([0, len(w)])))
        return self.bags[i]

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        bounds = np.concatenate([[0], np.cumsum(self.n)])
        bins = binned(np.concatenate(self.words).astype(_U), bounds)
        for ii, jj in _open_pairs(self.n, self.root, bins, left, right):
            for i, j in zip(ii.tolist(), jj.tolist(), strict=True):
                if i == j or self._find(int(self.root[i])) == self._find(int(self.root[j])):
                    continue
                if np.intersect1d(self.keys[i], self.keys[j], assume_unique=True)[0] != self.key:
                    continue  # they meet in that bucket
                longest = int(max(self.n[i], self.n[j]))
                most = int((1 - THRESHOLD) * longest + 1e-9)
                if longest - len(np.intersect1d(self._bag(i), self._bag(j), assume_unique=True)) > most:
                    continue
                if banded_distance(self.words[i].tolist(), self.words[j].tolist(), most) is not None:
                    self.above[self._find(int(self.root[i]))] = self._find(int(self.root[j]))
                    yield int(self.uid[i]), int(self.uid[j])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another; they come sorted by block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            here = (key[a], i[a], j[a])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join classes up in each block."""
    for rows in _blocks(batches):
        key, i, j = (int(rows.column(c)[0].as_py()) for c in ("key", "i", "j"))
        uid, root, side = (rows.column(c).to_numpy() for c in ("rep", "root", "side"))
        if len(np.unique(root)) < 2:
            continue
        keys = [np.array(x, np.int64) for x in rows.column("keys").to_pylist()]
        words = [np.frombuffer(x, np.uint32) for x in rows.column("words").to_pylist()]
        found = list(_Block(key, uid, root, keys, words).links(np.flatnonzero(side == i), np.flatnonzero(side == j)))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words, 32 bits of hash each."""
    for batch in batches:
        out = []
        for _, _, data, offsets in kernels.chunked(batch.column("t")):
            wh, _, _, bounds = kernels.words(data, offsets)
            w = (wh >> _U(32)).astype(np.uint32)
            out += [w[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.binary())], ["rep", "words"])


def _keys(wh: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys under which rows may meet."""
    n = np.diff(bounds)
    h, _, sb = kernels.shingles(wh, bounds, WIDTH)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for length, those in ((SHORT_LENGTH, (n >= 4) & (n <= SHORT)), (LENGTH, n >= int(THRESHOLD * SHORT))):
        if those.any():
            size = np.diff(sb)
            part = sketches(h[np.repeat(those, size)], np.concatenate([[0], np.cumsum(size[those])]), SKETCHES, length)
            owners.append(np.repeat(np.flatnonzero(those), SKETCHES))
            keys.append(np.ascontiguousarray(part.T).ravel())
    tiny = np.flatnonzero((n >= 4) & (n <= TINY))
    if len(tiny):  # all words, and all but one
        rows = [wh[bounds[i] : bounds[i + 1]] for i in tiny]
        left = [np.delete(r, k) if k >= 0 else r for r in rows for k in range(-1, len(r))]
        owner = np.repeat(tiny, n[tiny] + 1)
        key = _row_hash(np.concatenate(left), np.concatenate([[0], np.cumsum([len(x) for x in left])]), 5)
        owner, key = np.unique(np.stack([owner.astype(_U), key]), axis=1)
        owners.append(owner.astype(np.int64))
        keys.append(key)
    return np.concatenate(owners), np.concatenate(keys)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in kernels.chunked(batch.column("t")):
            wh, _, _, bounds = kernels.words(data, offsets)
            k1, k2 = _row_hash(wh, bounds, 3), _row_hash(wh, bounds, 4)
            empty = np.flatnonzero(np.diff(bounds) == 0)
            if len(empty):
                p = kernels.prefix_hash(data)
                raw = kernels.range_hash(p, offsets[empty], offsets[empty + 1])
                k1[empty], k2[empty] = raw, kernels.mix(raw ^ _U(0x5bd1e995)) ^ np.diff(offsets)[empty].astype(_U)
            owner, keys = _keys(wh, bounds)
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner[order], np.arange(len(bounds))), pa.int32()), pa.array(keys[order].view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").slice(a, b - a), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(bounds)), lists],
                ["uid", "k1", "k2", "n", "keys"],
            )


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel over the 2*most+1 diagonals of the band: vertical differences of a column
    are two bit vectors, which move down one row with every column.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    t = min(most, max(len(a), len(b)))
    width = 2 * t + 1
    mask, top, low = (1 << width) - 1, 1 << (width - 1), (1 << (width - 1)) - 1
    # places[s] has bit t+1+row for each row (from 0) of a that holds s
    places: dict = {}
    for i, s in enumerate(a):
        places[s] = places.get(s, 0) | 1 << (i + t)
    # column 0: rows -t..t, of which the rows above the first do not count (difference 0)
    vp, vn = mask ^ ((1 << (t + 1)) - 1), 0
    vp = (vp >> 1 | top) & mask  # band of column 1: rows 1-t..1+t
    distance = t  # at the lowest row of the band
    for j, s in enumerate(b):
        eq = places.get(s, 0) >> j & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if not d0 & top:
            distance += 1
        d1 = d0 >> 1
        vp = ((hn | (mask & ~(d1 | hp))) & low) | top
        vn = hp & d1 & low
    # vp, vn now stand for rows n+1-t..n+1+t of the last column; go from row n+t up to row len(a)
    n = len(b)
    span = n + t - len(a)
    if span > 0:
        first = len(a) + 1 - (n + 1 - t)
        part = ((1 << span) - 1) << first
        distance -= (vp & part).bit_count() - (vn & part).bit_count()
    return distance if distance <= most else None


def similar(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    if longest - (Counter(a) & Counter(b)).total() > most:  # words without a partner are edits
        return False
    return banded_distance(a, b, most) is not None


def _word_lists(col: pa.Array) -> Iterator[list[int]]:
    for _, _, data, offsets in kernels.chunked(col):
        wh, _, _, bounds = kernels.words(data, offsets)
        for i in range(len(bounds) - 1):
            yield wh[bounds[i] : bounds[i + 1]].tolist()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(x, y) for x, y in zip(_word_lists(batch.column("ta")), _word_lists(batch.column("tb")), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies."""
    # Merge joins at every size, so that what is shuffled follows the input evenly.
    both = pairs.hint("merge").join(texts.select(F.col("uid").alias("b"), F.col("t").alias("tb")), "b")
    both = both.hint("merge").join(texts.select(F.col("uid").alias("a"), F.col("t").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")


def _apart_still(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (hub, rep, ...) with ``hub_root`` and ``root``, where a node without a link is its own root."""
    of = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
    both = pairs.join(of("rep", "_r").hint("merge"), "rep", "left").join(of("hub", "_h").hint("merge"), "hub", "left")
    return both.select(*pairs.columns, F.coalesce("_r", "rep").alias("root"), F.coalesce("_h", "hub").alias("hub_root"))


def _with_partner(named: DataFrame) -> DataFrame:
    """The rows of named (key, rep, n, root) that have a member of another class and of like length in their bucket.

    Lengths are binned on a scale of logarithms, LENGTH_STEPS bins to the ratio that THRESHOLD allows; so texts
    that may be copies lie at most LENGTH_STEPS + 1 bins apart, and none of them is left out.  ``open`` and
    ``open_words`` are how many such rows the bucket has, and their words.
    """
    scale = LENGTH_STEPS / math.log(1 / THRESHOLD)
    rows = named.select("key", "rep", "n", "root", F.floor(F.log("n") * scale).alias("bin"))
    bins = rows.groupBy("key", "bin").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    like = Window.partitionBy("key").orderBy("bin").rangeBetween(-LENGTH_STEPS - 1, LENGTH_STEPS + 1)
    bins = bins.withColumn("several", F.min("r0").over(like) < F.max("r1").over(like)).filter("several")
    bucket = Window.partitionBy("key")
    bins = bins.select("key", "bin", F.sum("m").over(bucket).alias("open"), F.sum("w").over(bucket).alias("open_words"))
    return rows.join(bins.hint("merge"), ["key", "bin"]).drop("bin")


def _rest(met: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """The links that join up what is still apart in buckets that hold members of several classes; hubs have met all their members."""
    named = common.written(_apart_still(met.filter(F.col("size") > 2), roots))
    blocks = F.greatest(F.ceil(F.col("open") / BLOCK), F.ceil(F.col("open_words") / BLOCK_WORDS))
    open_ = _with_partner(named).groupBy("rep", "root").agg(F.sort_array(F.collect_list(F.struct("key", blocks.alias("blocks")))).alias("ks"))
    open_ = common.written(open_)  # read twice
    words = texts.join(open_.select(F.col("rep").alias("uid")).hint("merge"), "uid", "left_semi").mapInArrow(_worded, "rep long, words binary")
    each = open_.join(words.hint("merge"), "rep").select("rep", "root", "words", F.col("ks.key").alias("keys"), F.explode("ks").alias("k"))
    each = each.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("k.blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k.blocks") - 1)))
    each = each.select(F.col("k.key").alias("key"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "root", "keys", "words")
    each = each.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = common.written(each.mapInArrow(_compared, "a long, b long"))
    common.discard(named, open_)
    return found


def _joined_up(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The roots after more links: only the roots that these connect are gone over again."""
    if found.isEmpty():
        return roots
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    known = common.written(roots.unionByName(ends.join(roots.hint("merge"), "node", "left_anti").withColumn("root", F.col("node"))))
    of = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = found.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").filter(F.col("a_root") != F.col("b_root"))
    above = common.components(apart.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    above = above.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return common.written(known.join(above.hint("merge"), "root", "left").select("node", F.coalesce("above", "root").alias("root")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, class_uid) of every row; uid is the id wherever ids are unique."""
    texts = common.with_uid(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", "t", "uid").select("uid", "t")
    rows = common.written(texts.mapInArrow(_sketched, "uid long, k1 long, k2 long, n long, keys array<long>"))
    # copies are summed up before the shuffle
    reps = common.written(rows.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    members = reps.select("rep", "n", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("h"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all_words")).filter(F.col("size") > 1)
    hubs = hubs.select("key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), "size", "all_words")
    met = common.written(members.join(hubs.hint("merge"), "key").filter(F.col("rep") != F.col("hub")))
    involved = met.select(F.col("hub").alias("uid")).unionByName(met.select(F.col("rep").alias("uid"))).distinct()
    some = common.written(texts.join(involved.hint("merge"), "uid", "left_semi"))
    long, short = F.greatest("n", "hub_n"), F.least("n", "hub_n")
    pairs = common.written(met.filter(long - short <= (1 - THRESHOLD) * long + 1e-9).groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("shared")))
    nearest = pairs.groupBy("rep").agg(F.max(F.struct("shared", -F.col("hub"))).alias("m")).select((-F.col("m.col2")).alias("hub"), "rep")
    nearest = common.written(nearest)
    ends = lambda p: p.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = common.written(_linked(ends(nearest), some))
    roots = common.components(links)
    others = _apart_still(pairs.select("hub", "rep").join(nearest.hint("merge"), ["hub", "rep"], "left_anti"), roots)
    more = common.written(_linked(ends(others.filter(F.col("root") != F.col("hub_root"))), some))
    joined = _joined_up(roots, more)
    last = _rest(met, joined, some)
    joined = _joined_up(joined, last)
    named = reps.select("k1", "k2", "rep").join(joined.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    named = common.written(named.select("k1", "k2", F.coalesce("root", "rep").alias("class_uid")))
    common.discard(reps, met, some, pairs, nearest, links, more, last)
    return rows.select("uid", "k1", "k2").join(named.hint("merge"), ["k1", "k2"]).select("uid", "class_uid")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the first by id; columns as before."""
    (uid,) = common.unused(docs.columns, "_uid")
    known = common.with_uid(docs, id_col, text_col, uid)
    keep = classes(known.select(F.col(uid).alias("doc_id"), F.col(text_col).alias("text"))).filter(F.col("uid") == F.col("class_uid")).select(F.col("uid").alias(uid))
    return known.join(keep.hint("merge"), uid, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = common.with_uid(docs, out="uid")
    out = classes(known.select(F.col("uid").alias("doc_id"), "text"))
    ids = known.select("uid", "doc_id")
    first = ids.select(F.col("uid").alias("class_uid"), F.col("doc_id").alias("class_id"))
    return ids.join(out, "uid").join(first, "class_uid").select("doc_id", "class_id", (F.col("uid") == F.col("class_uid")).alias("is_first"))
