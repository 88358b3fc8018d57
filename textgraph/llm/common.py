"""What several operators share: tables, the shared folder, even ranges of ids."""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce
from itertools import count as counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bound of the number of id ranges; the driver holds that many bounds.
MAX_RANGES = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only on one machine (master local, as in tests) it may be unset: then it is a folder beside
    the warehouse.  Anywhere else that folder could be local to one machine, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of df, kept as a Parquet table (in folders by a column) in the shared folder: cuts lineage, and survives lost executors.

    Tables that a returned frame still reads stay in the folder, whose keeper clears it;
    those that served an operator alone go with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    return [next(n for n in ("_" * k + name for k in counter()) if n.lower() not in taken) for name in names]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(df: DataFrame, col: str, n: int | None = None) -> list[int]:
    """Distinct ascending ids that cut the rows into about equal ranges; at most MAX_RANGES."""
    n = min(MAX_RANGES, n or max(8, 2 * partitions(df.sparkSession)))
    qs = F.expr(f"array({','.join(f'{i / n!r}D' for i in range(1, n))})")
    found = df.agg(F.percentile_approx(F.col(col), qs, F.lit(10 * n)).alias("q")).first()
    return sorted({int(x) for x in (found["q"] or []) if x is not None})


def _longs(values: list[int]) -> str:
    return f"array({','.join(f"bigint('{v}')" for v in values)})"


def range_of(col: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below an id: 0 for null ids, which sort first.

    Bounds are sought in two steps of about the square root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at_or_below = lambda b: b <= col
    group = F.size(F.filter(F.expr(_longs([g[0] for g in groups])), at_or_below)) - 1
    within = F.size(F.filter(F.get(F.expr(f"array({','.join(map(_longs, groups))})"), group), at_or_below))
    return F.when(group >= 0, group * step + within).otherwise(0).cast("int")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "_uid") -> DataFrame:
    """docs with a unique ascending long: the id itself where ids are unique and present.

    Otherwise rows are numbered in the order of (id, hash of the text), null ids first, in
    even ranges of ids, so that no task sorts the whole table.
    """
    n, present, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if n == present == distinct and dict(docs.dtypes)[id_col] in ("bigint", "int"):
        return docs.withColumn(out, F.col(id_col).cast("long"))
    (r,) = unused([*docs.columns, out], "_r")
    ranged = docs.withColumn(r, range_of(F.col(id_col), id_bounds(docs, id_col)))
    order = Window.partitionBy(r).orderBy(F.col(id_col).asc_nulls_first(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit("")))
    return written(ranged.withColumn(out, F.shiftleft(F.col(r).cast("long"), 40) + F.row_number().over(order)).drop(r))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of undirected edges (a, b): root is the least node.

    Randomised contraction (Boegeholz, Brand and Todor, "In-database connected component
    analysis"): in each round every node is mapped to the first of itself and its neighbours,
    by id in the first round, which settles stars round a least hub at once, and in the order of
    a hash that changes with every round after it, which shrinks any graph by a constant factor
    on average.  Edges are carried over to the images until none is left; so no number of
    rounds is set, and all rounds together cost a few times the first.  Only the question
    whether edges are left comes to the driver.
    """
    left = written(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(steps))
        place = lambda c: F.struct((F.xxhash64(turn, c) if steps else c).alias("h"), c.alias("id"))  # noqa: B023, E731
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))).alias("e"))
        first = ends.groupBy(F.col("e.node").alias("node")).agg(F.min(place(F.col("e.nbr"))).alias("n"))
        step = written(first.select("node", F.least("n", place(F.col("node")))["id"].alias("to")))
        image = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")).hint("merge")  # noqa: B023, E731
        x, y = F.col("a_to"), F.col("b_to")
        moved = left.join(image("a"), "a").join(image("b"), "b").filter(x != y)
        after = written(moved.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
        discard(left)
        left = after
        steps.append(step)
    discard(left)
    if not steps:
        return edges.sparkSession.createDataFrame([], f"node {dict(edges.dtypes)['a']}, root {dict(edges.dtypes)['a']}")
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in steps[-2::-1]:
        found = step.join(found.select(F.col("node").alias("to"), "root").hint("merge"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    found = written(found)
    discard(*steps)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    named = written(found.join(least.hint("merge"), "root").select("node", F.col("least").alias("root")))
    discard(found)
    return named
