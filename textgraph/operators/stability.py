"""Stability under dropout: all runs in one plan, as rows with a run_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(run: Column, unit: Column, seed: int, salt: str) -> Column:
    """Where a unit stands in a run's random order: a digest that any engine can compute."""
    return F.md5(F.concat_ws(":", (F.lit(seed) + 17 * run).cast("string"), F.lit(salt), unit.cast("string")).cast("binary"))


def _first(units: DataFrame, k: Callable[[Column], Column], seed: int, salt: str) -> DataFrame:
    """The rows (run_id, unit) among the first k(n) of each run's n units, in a random order.

    Exact, without sorting a run in one task: units are counted by the first four digits of
    their digests (65,536 rows a run), whole bins are taken or left, and only the bin that
    the cut falls into is ranked.
    """
    placed = units.withColumn("_h", _place(F.col("run_id"), F.col("unit"), seed, salt)).withColumn("_bin", F.substring("_h", 1, 4))
    bins = placed.groupBy("run_id", "_bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("run_id").orderBy("_bin")
    sums = bins.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("run_id")))
    cut = sums.withColumn("k", k(F.col("total"))).filter((F.col("upto") - F.col("n") < F.col("k")) & (F.col("upto") >= F.col("k")))
    cut = cut.select("run_id", F.col("_bin").alias("_cut"), (F.col("k") - F.col("upto") + F.col("n")).alias("_some"))
    near = placed.join(F.broadcast(cut), "run_id")  # one row a run
    whole = near.filter(F.col("_bin") < F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("_h", "unit"))
    part = near.filter(F.col("_bin") == F.col("_cut")).withColumn("_n", rank).filter(F.col("_n") <= F.col("_some"))
    return whole.select("run_id", "unit").unionByName(part.select("run_id", "unit"))


def runs(docs: DataFrame, n: int, fraction: float, seed: int, by: str | None = "actor", keep_share: float = 0.9) -> DataFrame:
    """docs with run_id, each run without a share of the documents, and of the rest nine in ten.

    What goes: of the documents with a value in ``by``, a share (undone in a run that would be
    left with fewer than ten); where no document has one, a share of the sources, all but one at
    most; where there is one source only, a share of all documents, but ten stay.  The second
    cut applies to runs of more than 20 documents.  All runs are one plan, and samples are by
    digest, so they are the same on every cluster.
    """
    r = docs.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    share = lambda t: F.greatest(F.lit(1), F.floor(t * fraction))
    known = F.col(by).isNotNull() & (F.col(by).cast("string") != "") if by is not None and by in docs.columns else F.lit(False)
    if not docs.filter(known).isEmpty():
        gone = _first(r.filter(known).select("run_id", F.col("doc_id").alias("unit")), share, seed, "actor")
        left = r.join(gone.withColumnRenamed("unit", "doc_id"), ["run_id", "doc_id"], "left_anti")
        few = left.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 10).select("run_id")
        left = left.join(F.broadcast(few), "run_id", "left_semi").unionByName(r.join(F.broadcast(few), "run_id", "left_anti").select(left.columns))
    elif docs.select("source").distinct().limit(2).count() < 2:
        stays = _first(r.select("run_id", F.col("doc_id").alias("unit")), lambda t: F.least(t, F.greatest(F.lit(10), F.floor(t * (1 - fraction)))), seed, "document")
        left = r.join(stays.withColumnRenamed("unit", "doc_id"), ["run_id", "doc_id"], "left_semi")
    else:
        name = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
        gone = _first(r.select("run_id", name.alias("unit")).distinct(), lambda t: F.least(share(t), t - 1), seed, "source")
        left = r.withColumn("unit", name).join(F.broadcast(gone), ["run_id", "unit"], "left_anti").drop("unit")
    stays = _first(left.select("run_id", F.col("doc_id").alias("unit")), lambda t: F.when(t > 20, F.floor(t * keep_share)).otherwise(t), seed, "sample")
    return left.join(stays.withColumnRenamed("unit", "doc_id"), ["run_id", "doc_id"], "left_semi")


def vote_floor(n: int, threshold: float) -> int:
    return max(1, int(n * threshold))


def votes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node votes, edge votes) of edges that carry run_id: in how many runs each appears."""
    e = edges.groupBy("src", "dst").agg(F.count_distinct("run_id").alias("votes"))
    ends = edges.select("run_id", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count_distinct("run_id").alias("votes")), e


def core(edges: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with their stability, and edges, in at least the floor of n * threshold runs."""
    nodes, pairs = votes(edges)
    least = vote_floor(n, threshold)
    keep = nodes.filter(F.col("votes") >= least).withColumn("stability", F.col("votes") / n)
    e = pairs.filter(F.col("votes") >= least)
    for c in ("src", "dst"):
        e = e.join(keep.select(F.col("id").alias(c)), c, "left_semi")
    return keep, e


def stress(docs: DataFrame, build: Callable[[DataFrame], DataFrame], n: int, fraction: float, seed: int, threshold: float, by: str | None = "actor") -> tuple[DataFrame, DataFrame]:
    """Run a whole build on each of n dropouts and keep what is stable."""
    from functools import reduce

    # runs are drawn by ids alone; a text is moved once, with the runs that it is in, not once a run
    slim = docs.select(*dict.fromkeys(c for c in ("doc_id", "source", by) if c in docs.columns))
    among = runs(slim, n, fraction, seed, by).select("doc_id", "run_id").distinct().groupBy("doc_id").agg(F.collect_list("run_id").alias("_runs"))
    kept = docs.join(among, "doc_id").persist()
    # each run's graph is bounded and comes back as a small frame, so runs do not pile up in one plan
    each = [build(kept.filter(F.array_contains("_runs", i)).drop("_runs")).select("src", "dst").withColumn("run_id", F.lit(i)) for i in range(n)]
    return core(reduce(DataFrame.unionByName, each), n, threshold)
