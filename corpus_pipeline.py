"""From raw documents to token ids in five stages, each working on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents``: rejected documents are
gone, and texts are as the stage left them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.llm import byte_bpe, common, decontamination, line_dedup, near_dedup, pu_learning, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at or above its threshold."""
    scorer = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    (score,) = common.unused(docs.columns, "_score")
    return pu_learning.with_score(docs, "text", scorer, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share."""
    names = common.unused(docs.columns, "_n_lines", "_n_dropped", "_kept")
    out = line_dedup.dropped_lines(docs, out=names)
    new = {"text": F.col(names[2]), "n_chars": F.length(names[2]).cast("long")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document, with digests of ids and decoded text."""
    out = byte_bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids_sha256 AS ids_sha256", "_decoded_sha256 AS decoded_sha256", "_ids AS ids")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor the sketches; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
