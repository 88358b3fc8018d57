"""Profiles of corpora and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("total_chars"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c if top is None else c.orderBy(F.desc("n"), col).limit(top)


def top_items(df: DataFrame, items: Column, top: int = 20) -> DataFrame:
    return value_counts(df.select(F.explode(items).alias("item")), "item", top)


def lengths(docs: DataFrame) -> DataFrame:
    cols = {"text_len": F.length(F.coalesce("text", F.lit("")))}
    cols |= {f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in ("entities", "keywords") if c in docs.columns}
    return docs.withColumns(cols)


def year_histogram(df: DataFrame, date: str = "date") -> DataFrame:
    y = F.year(F.expr(f"try_to_timestamp(cast({date} as string))"))
    return df.select(y.alias("year")).filter(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def pivot_top(df: DataFrame, rows: str, cols: str, top: int = 5, values: list | None = None) -> DataFrame:
    """Counts of the top rows by column value, absent ones 0; give ``values`` to spare a pass."""
    few = value_counts(df, rows, top).select(rows)
    return df.join(F.broadcast(few), rows, "left_semi").groupBy(rows).pivot(cols, values).count().na.fill(0)


def word_counts(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Total occurrences of each word as a substring, in one pass."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    one = docs.agg(*[F.sum((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long").alias(w) for w in words])
    return one.select(F.explode(F.create_map(*[x for w in words for x in (F.lit(w), F.col(f"`{w}`"))])).alias("word", "n"))


def checks(rules: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """(check, ok, detail): each rule is a name, a one-row frame, a condition and a detail over it."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), ok.alias("ok"), d.cast("string").alias("detail")) for name, df, ok, d in rules])


def passed(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_and("ok").alias("all_ok"))


def corpus_rules(docs: DataFrame, title: Column, words: list[str], size: tuple[int, int], length: tuple[int, int], least_titles: int, least_entities: int, least_names: int, least_keywords: int, keywords: DataFrame | None = None) -> list[tuple[str, DataFrame, Column, Column]]:
    """Rules of a corpus with ``entities`` and ``keywords`` (or a frame of them): its size, lengths, titles, and the domain words among its commonest names and keywords."""
    has_word = lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
    stats = corpus_stats(docs)
    one = docs.agg(F.count_if(has_word(title)).alias("titles"), F.median(F.size("entities")).alias("names"))
    top = lambda df, items, n: top_items(df, F.transform(items, lambda x: F.lower(x)), n).agg(F.count_if(has_word(F.col("item"))).alias("n"))
    names, kws = top(docs, F.col("entities.text"), 20), top(docs if keywords is None else keywords, F.col("keywords"), 50)
    return [
        ("corpus_size", stats, F.col("n_docs").between(*size), F.col("n_docs")),
        ("median_text_len", stats, F.col("median_chars").between(*length), F.round("median_chars").cast("bigint")),
        ("title_relevance", one, F.col("titles") >= least_titles, F.col("titles")),
        ("ner_present", one, F.col("names") >= least_entities, F.round("names").cast("bigint")),
        ("top_ner_domain", names, F.col("n") >= least_names, F.col("n")),
        ("keywords_domain", kws, F.col("n") >= least_keywords, F.col("n")),
    ]


def share_rules(docs: DataFrame, authors: str, tags: Column, date: str, summary: str, words: list[str], least_authors: int = 5, least_tags: int = 2, least_years: int = 2, least_share: float = 0.8) -> list[tuple[str, DataFrame, Column, Column]]:
    """Rules of a corpus of articles: its authors, the domain words among its tags, the years it spans, and how many have a summary."""
    tag = docs.select(F.explode(tags).alias("tag")).distinct()
    has_word = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("tag"), w))
    year = F.year(F.expr(f"try_to_timestamp(cast({date} as string))"))
    one = docs.agg(F.count_distinct(authors).alias("a"), F.coalesce(F.max(year) - F.min(year), F.lit(0)).alias("y"), F.count(summary).alias("s"), F.count(F.lit(1)).alias("n"))
    return [
        ("author_diversity", one, F.col("a") >= least_authors, F.col("a")),
        ("tags_domain", tag.agg(F.count_if(has_word).alias("n")), F.col("n") >= least_tags, F.col("n")),
        ("temporal_span", one, F.col("y") >= least_years, F.col("y")),
        ("summaries_present", one, F.col("s") >= F.col("n") * least_share, F.col("s")),
    ]


def graph_rules(graphs: dict[str, DataFrame], most_per_node: float = 6, least_edges: int = 100, least_pmi: dict[str, float] | None = None) -> list[tuple[str, DataFrame, Column, Column]]:
    """Rules of each graph, given by its metrics row: not dense, has edges, and (where stated) a median PMI."""
    out = []
    for name, g in graphs.items():
        out += [(f"{name}_not_dense", g, F.col("edges_per_node") <= most_per_node, F.col("edges_per_node")), (f"{name}_has_edges", g, F.col("edges") >= least_edges, F.col("edges"))]
        if least_pmi and name in least_pmi:
            out.append((f"{name}_pmi", g, F.coalesce("pmi_median", F.lit(0.0)) >= least_pmi[name], F.round("pmi_median", 4)))
    return out
