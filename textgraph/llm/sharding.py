"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are packed into bins of a fixed capacity: largest first, each into the
bin with the least room that still holds it, found in a balanced search tree of remaining
room.  Groups of equal size are exchangeable, so the driver packs (size, number of groups)
only, a run at a time: the tightest bin that holds one of a size stays the tightest until it
holds no more of them, so it takes as many as fit in one step.  The result is that of packing
every group by itself.  There are at most as many sizes as the square root of twice the bytes
of all rows, and in practice no more than the longest text has bytes.  Groups of a size
that falls to several bins are dealt to them by their rank, counted in parts.

For a given number of bins the least capacity is sought for which they suffice.

Edge cases: a null text is the empty text; repeated rows are one group and take one slot
each; an empty table gives no rows; ids may repeat or be null; very long texts are hashed
whole; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Groups of at least 1/SPLIT of a bin are told to their rows by a broadcast: fewer than SPLIT * bins.
SPLIT = 64
#: Sizes up to which their bins are broadcast (about 50 bytes each); more are joined by a shuffle.
MAX_SIZES = 200_000
#: Rows of a shard, and groups of a size, are numbered in at least this many parts (twice the
#: shuffle partitions, if more), so that neither is a single task.
PARTS = 16
OVERHEAD = 16


class RoomTree:
    """A treap of (room, bin): insert, remove, and the least entry at or above a key."""

    __slots__ = ("root", "seed")

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, priority, left, right]
        self.seed = 0x2545F491

    def _priority(self) -> int:
        x = self.seed
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self.seed = x
        return x

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _cut(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Entries below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._cut(node[3], key)
            return node, rest
        less, node[2] = self._cut(node[2], key)
        return less, node

    def insert(self, key: tuple[int, int]) -> None:
        less, rest = self._cut(self.root, key)
        self.root = self._merge(self._merge(less, [key, self._priority(), None, None]), rest)

    def remove(self, key: tuple[int, int]) -> None:
        less, rest = self._cut(self.root, key)
        _, more = self._cut(rest, (key[0], key[1] + 1))
        self.root = self._merge(less, more)

    def at_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def packed_runs(runs: list[tuple[int, int]], capacity: int, limit: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count), by falling size, the bins that take its groups: (bin, how many), in order.

    None if a group is too large or more than ``limit`` bins are needed.
    """
    if runs and runs[0][0] > capacity:
        return None
    bins, tree, out = 0, RoomTree(), []
    for size, count in runs:
        dealt = []
        while count:
            found = tree.at_least((size, -1))
            if found is None:
                if limit is not None and bins == limit:
                    return None
                found = (capacity, bins)
                bins += 1
            else:
                tree.remove(found)
            k = min(count, found[0] // size)
            tree.insert((found[0] - k * size, found[1]))
            dealt.append((found[1], k))
            count -= k
        out.append(dealt)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each item; None if an item is too large or more than ``limit`` bins are needed."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    dealt = packed_runs([(sizes[i], 1) for i in order], capacity, limit)
    if dealt is None:
        return None
    out = [0] * len(sizes)
    for i, d in zip(order, dealt, strict=True):
        out[i] = d[0][0]
    return out


def pack_into(runs: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """packed_runs at (about) the least capacity for which ``bins`` bins suffice."""
    if not runs:
        return []
    low = max(runs[0][0], -(-sum(s * c for s, c in runs) // bins))
    high, step = low, max(1, low // 4096)
    while (best := packed_runs(runs, high, bins)) is None:
        low, high, step = high + 1, high + step, step * 2
    for _ in range(12):
        if low >= high:
            break
        mid = (low + high) // 2
        if (found := packed_runs(runs, mid, bins)) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return best


def _numbered(rows: DataFrame, key: str, order: list[str], parts: int, out: str) -> DataFrame:
    """rows with a number, gapless from 0 within each key: counted in parts by a hash, and the parts' sums added."""
    split = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = split.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    return split.withColumn("at", at).join(offsets, [key, "part"]).withColumn(out, (F.col("first") + F.col("at")).cast("long")).drop("part", "first", "at")


def groups_packed(groups: DataFrame, bins: int) -> DataFrame:
    """(h, shard) of groups (h, s): each in the bin that best-fit-decreasing gives it."""
    spark = groups.sparkSession
    counted = groups.groupBy("s").agg(F.count(F.lit(1)).alias("c")).toArrow()
    runs = sorted(zip(counted.column("s").to_pylist(), counted.column("c").to_pylist(), strict=True), reverse=True)
    dealt = pack_into(runs, bins)
    rows = [(s, len(d) > 1, [(b, k) for b, k in d]) for (s, _), d in zip(runs, dealt, strict=True)]
    places = spark.createDataFrame(rows, "s long, several boolean, bins array<struct<b: int, k: long>>")
    known = groups.join(F.broadcast(places) if len(rows) <= MAX_SIZES else places, "s")
    alone = known.filter(~F.col("several")).select("h", F.col("bins")[0]["b"].alias("shard"))
    parts = max(PARTS, 2 * common.partitions(spark))
    ranked = _numbered(known.filter("several"), "s", ["h"], parts, "rank")
    start = F.struct(F.col("rank").alias("left"), F.lit(None).cast("int").alias("b"))
    step = lambda acc, x: F.struct((acc["left"] - x["k"]).alias("left"), F.when(acc["b"].isNull() & (acc["left"] < x["k"]), x["b"]).otherwise(acc["b"]).alias("b"))
    return alone.unionByName(ranked.select("h", F.aggregate("bins", start, step)["b"].alias("shard")))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = SHARDS) -> DataFrame:
    """(id, size, crc, shard, slot) of every row; groups of equal texts stay together."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = common.written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.unhex(F.sha2(raw, 256)).alias("h"),
    ))
    # partial sums run before the shuffle, so a group of many copies is a few rows by then
    groups = common.written(rows.groupBy("h").agg(F.sum("size").alias("s")))
    total = groups.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    placed = common.written(groups_packed(groups, bins).join(groups, "h"))
    common.discard(groups)
    is_large = F.col("s") >= total // (SPLIT * bins) + 1
    # fewer than SPLIT * bins rows, as they add up to the total: a proven bound for the broadcast
    large = F.broadcast(placed.filter(is_large).select("h", "shard"))
    known = rows.join(large, "h").unionByName(rows.join(large, "h", "left_anti").join(placed.filter(~is_large).select("h", "shard"), "h"))
    known = common.written(known.select("id", "size", "crc", "h", "shard"))
    parts = max(PARTS, 2 * common.partitions(docs.sparkSession))
    return _numbered(known, "shard", ["id", "h"], parts, "slot").select("id", "size", "crc", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
