"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (key hash, number of documents), dealt into buckets by hash and sorted
within them, one file a bucket.  Each new batch of documents is counted by key (summed up
before its one shuffle, which deals it into the same buckets), merge-anti-joined with
every run's keys that are known to be frequent (their count needs no more) and adds a run of
its own at level 0: the runs are read in their order, neither shuffled nor sorted again.  When
FAN_IN runs lie at a level they are compacted into one run of the next level by a sum over
their hashes, dealt into buckets anew.  Runs are tables in the shared folder, so a lost executor costs a reread and
lineage stays one batch deep; they go once the frequent keys are known.

Documents learn of their frequent lines by a join on the key.  The keys that make up 1 in
HOT_KEYS of all lines or more go to the lines instead (there cannot be more than HOT_KEYS
of them), so a line that most documents share is never gathered in one task.  Lines look
their key up in about the square root of their document's frequent keys.

Edge cases: a null or empty text is one empty line; an empty key never drops a line; each
row counts as a document of its own, so repeated rows count repeatedly, and rows that share an
id (null among them) also share the list of their frequent lines, which changes nothing;
very long texts are split whole, one row at a time; an empty table gives no rows; columns of
the input are passed through untouched, whatever their names: where those of the output
clash with them, ``out`` names others (common.unused finds some).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Runs of one level that are compacted into one of the next.
FAN_IN = 4
#: Batches that a whole table is taken in.
BATCHES = 6
MIN_DOCS = 10
#: Most keys that are sent to the lines.
HOT_KEYS = 1 << 14

STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), _UPPER, _LOWER)


def hash_of(key: Column) -> Column:
    """96 bits of two unlike hashes, as one sortable string; null for an empty key."""
    return F.when(F.length(key) > 0, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")))


#: While runs are read: they have one file a bucket, so their order may be relied on; and Spark 4.1
#: takes a union of bucketed tables for dealt out by key, which it is not.
_PLANNED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def _planned(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _PLANNED}
    for k, v in _PLANNED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """The levelled runs: add batches of (a, b) hashes, one row for each document that has the key."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[str]) -> DataFrame:
        return common.union_all([self.spark.table(r) for r in runs]).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def _stored(self, run: DataFrame) -> str:
        """Its table, in buckets of one file each, sorted."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{common.shared_dir(self.spark).rstrip('/')}/{name}"
        run.write.format("parquet").bucketBy(common.partitions(self.spark), "a", "b").sortBy("a", "b").option("path", path).saveAsTable(name)
        self.tables.append(name)
        return name

    def counted(self, batch: DataFrame) -> DataFrame:
        """The counts of a batch by key, without the keys that some run knows to be frequent."""
        out = batch.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            known = self.spark.table(run).filter(F.col("n") >= self.min_docs).select("a", "b", F.lit(True).alias("known"))
            # as an outer join: the optimizer would put an anti-join below the sums, onto the single lines
            out = out.join(known.hint("merge"), ["a", "b"], "left").filter(F.col("known").isNull()).drop("known")
        return out

    def add(self, batch: DataFrame) -> None:
        with _planned(self.spark):
            run, at = self._stored(self.counted(batch)), 0
            while True:
                if len(self.levels) == at:
                    self.levels.append([])
                self.levels[at].append(run)
                if len(self.levels[at]) < self.fan_in:
                    return
                run = self._stored(self._merged(self.levels[at]))
                self.levels[at] = []
                at += 1

    def frequent_counts(self) -> DataFrame:
        """(a, b, n) of the keys found in at least min_docs documents over all batches; n stops where they became known."""
        with _planned(self.spark):
            return common.written(self._merged(self.runs()).filter(F.col("n") >= self.min_docs))

    def frequent_keys(self) -> DataFrame:
        return self.frequent_counts().select("a", "b")

    def close(self) -> None:
        """Drop all runs."""
        for name in self.tables:
            stored = self.spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(stored)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.tables, self.levels = [], []


def _digest(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(batch, id, a, b): the distinct non-empty line keys of each row."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), lambda x: hash_of(key_of(x))))
    return (
        docs.select(F.col(id_col).alias("id"), keys.alias("ks"))
        .select("id", F.explode(F.filter("ks", lambda k: k.isNotNull())).alias("k"))
        .select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id", "k.a", "k.b")
    )


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES,
    out: Sequence[str] = ("_n_lines", "_n_dropped", "_kept"),
) -> DataFrame:
    """docs with three more columns: the number of lines, of dropped ones, and the text that stays."""
    if common.unused(docs.columns, *out) != [*out]:
        raise ValueError(f"docs has columns named {out}")
    digest = common.written(_digest(docs, id_col, text_col, batches), "batch")
    runs = LineRuns(docs.sparkSession, min_docs)
    for i in range(batches):
        runs.add(digest.filter(F.col("batch") == i).select("a", "b"))
    frequent = runs.frequent_counts()
    runs.close()
    # the counts add up to at most the number of lines: a proven bound for the broadcasts
    is_hot = F.col("n") * HOT_KEYS >= digest.count()
    hot, rest = frequent.filter(is_hot).select("a", "b"), frequent.filter(~is_hot).select("a", "b")
    known = digest.join(F.broadcast(hot), ["a", "b"], "left_semi").unionByName(
        digest.join(F.broadcast(hot), ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_semi")
    )
    own, gone, parts, lines, stay = common.unused([*docs.columns, *out], "_id", "_gone", "_parts", "_lines", "_stay")
    lists = known.groupBy(F.col("id").alias(own)).agg(F.collect_set(F.struct("a", "b")).alias(gone))
    joined = docs.join(lists, docs[id_col].eqNullSafe(lists[own]), "left").drop(own)
    # the frequent keys in about as many parts as each has members, so that no line seeks through all of them
    n_parts = F.ceil(F.sqrt(F.size(gone))).cast("int")
    split = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.filter(F.col(gone), lambda k: F.pmod(k["a"], n_parts) == i))
    full = joined.withColumn(parts, F.when(F.size(gone) > 0, split)).withColumn(lines, lines_of(F.col(text_col)))

    def is_gone(line: Column) -> Column:
        key = hash_of(key_of(line))
        return F.coalesce(F.array_contains(F.get(F.col(parts), F.pmod(key["a"], F.size(parts)).cast("int")), key), F.lit(False))

    kept = F.when(F.col(parts).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~is_gone(x)))
    return full.withColumn(stay, kept).select(
        *docs.columns, F.size(lines).cast("long").alias(out[0]), (F.size(lines) - F.size(stay)).cast("long").alias(out[1]), F.array_join(stay, "\n").alias(out[2])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dropped_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM l
), d AS (
  SELECT doc_id, unnest(list_distinct(ks)) AS k FROM e
), f AS (
  SELECT k FROM d WHERE k <> '' GROUP BY k HAVING count(*) >= 10
), u AS (
  SELECT doc_id, unnest(ls) AS x, unnest(ks) AS k, unnest(range(len(ls))) AS i FROM e
), g AS (
  SELECT u.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
         coalesce(string_agg(u.x, chr(10) ORDER BY u.i) FILTER (WHERE f.k IS NULL), '') AS kept
  FROM u LEFT JOIN f ON u.k = f.k GROUP BY u.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM g
"""
