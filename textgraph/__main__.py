"""Command line: python -m textgraph build|contexts|stats INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import profile
from .plans import GraphConstructor, QuestionAnswering
from .sources import files

PRESETS = {"truth": config.TRUTH_CORPUS, "science": config.SCIENCE_CITIES, "default": config.BuildConfig(), "unicode": config.TESTDATA}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="textgraph")
    p.add_argument("command", choices=("build", "contexts", "stats"))
    p.add_argument("input", help="documents: Parquet (*.parquet) or JSON")
    p.add_argument("output", help="folder to write to")
    p.add_argument("--preset", choices=PRESETS, default="truth")
    p.add_argument("--stress", action="store_true")
    p.add_argument("--baseline", action="store_true")
    p.add_argument("--questions", help="JSON lines of q_id and q")
    p.add_argument("--strategy", choices=("walk", "community", "combined", "long"), default="combined")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(a.input) if a.input.rstrip("/").endswith(".parquet") else files.read_documents(spark, a.input)
    if a.command == "stats":
        files.write_json(profile.corpus_stats(docs), f"{a.output}/corpus_stats")
        return
    constructor = GraphConstructor(PRESETS[a.preset])
    if a.command == "build":
        constructor.save(constructor.run(docs, a.stress, a.baseline), a.output)
        return
    if not a.questions:
        p.error("contexts needs --questions")
    questions = spark.read.schema("q_id string, q string").json(a.questions)
    qa = QuestionAnswering(docs, constructor.build(docs).edges, constructor.config)
    files.write_json(qa.contexts(questions, a.strategy).withColumn("strategy", F.lit(a.strategy)), f"{a.output}/contexts")


if __name__ == "__main__":
    main()
