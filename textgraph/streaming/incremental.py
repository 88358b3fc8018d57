"""Typed edge counts kept up to date by micro-batches.

Per-document weights add up, so each batch appends its own partial counts to a table; the
current graph is a sum over it, and PMI and backbone are computed from that sum.  Batches
are named by their id, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BuildConfig
from ..operators import edges


def count_stream(docs: DataFrame, labels: list[str], config: BuildConfig, path: str, checkpoint: str) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        parts = [m for m in config.edge_methods if m != "perplexity"]
        from dataclasses import replace

        edges.build(batch, labels, replace(config, edge_methods=tuple(parts))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The edges over all batches so far."""
    return edges.merge([spark.read.parquet(path).drop("batch").withColumn("weight", F.col("weight").cast("long"))])
