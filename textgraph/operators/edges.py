"""Typed edges between vertices, counted by document.

The vertex labels are a literal array (at most BuildConfig.max_vertices of them, a proven
bound), so matching and pairing happen inside each document row: no join, and one shuffle
of partial sums by pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildConfig, Profile
from ..functions import codes
from ..functions import text as tx
from .vertices import pairs_of

COLUMNS = "src string, dst string, weight long, methods array<string>, relation string, emotional boolean, surprisal double"


#: Most labels; they go into the plan.
MAX_LABELS = 100_000


def labels_of(vertices: DataFrame) -> list[str]:
    """All labels, in order; refused beyond MAX_LABELS rather than cut."""
    rows = vertices.select("label").distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return sorted(r["label"] for r in rows)


def _label_array(labels: list[str]) -> Column:
    return F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")


def _placed(t: Column, labels: list[str]) -> Column:
    """The labels in an array of tokens, by first place, then label; bigrams are built only if a label has two words."""
    one, two = [x for x in labels if " " not in x], [x for x in labels if " " in x]
    if not two:
        return F.array_intersect(t, _label_array(one))
    places = lambda xs, some: F.transform(F.array_intersect(xs, _label_array(some)), lambda x: F.struct(F.array_position(xs, x).alias("pos"), x.alias("label")))
    return F.transform(F.array_sort(F.concat(places(t, one), places(tx.bigrams(t), two))), lambda m: m["label"])


def mentions(docs: DataFrame, profile: Profile, labels: list[str], level: str = "sentence", window: int = 3, marked: bool = True) -> DataFrame:
    """(doc_id, ms): for each unit with a label, in text order, its marks (unless not asked for) and its labels by place.

    The one pass over the texts that all edge methods share; ms is as small as what it names.
    Rows are not filtered by ms: the optimizer would compute it once more for that.
    """
    units = docs.select("doc_id", tx.units(F.col("text"), level, window).alias("us"))
    toks = F.transform("us", lambda u: tx.tokens(u, profile.token))
    # tokens are materialised before labels are sought in them
    base = units.select("doc_id", "us", (profile.lexicon(toks, "array<array<string>>") if profile.lexicon else toks).alias("ts"))
    both = F.zip_with("us", F.transform("ts", lambda t: _placed(t, labels)), lambda u, ls: F.struct(u.alias("u"), ls.alias("ls")))
    found = F.filter(both, lambda m: F.size(m["ls"]) > 0)
    has = lambda u, pattern, given: (u.rlike(pattern) if marked and given else F.lit(False))
    return base.select("doc_id", F.transform(found, lambda m: F.struct(
        has(m["u"], profile.contrast_pattern, profile.contrast).alias("contrast"), has(F.lower(m["u"]), profile.affect_pattern, profile.affect).alias("affect"),
        has(m["u"], profile.pronoun_pattern, profile.pronouns).alias("pronoun"), m["ls"].alias("ls"),
    )).alias("ms"))


def _pairs(found: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(src, dst, n): in how many documents the pair shares a unit (that ``keep`` accepts)."""
    units = F.filter("ms", (lambda m: (F.size(m["ls"]) > 1) & keep(m)) if keep else (lambda m: F.size(m["ls"]) > 1))
    sets = found.select(F.transform(units, lambda m: F.array_sort(m["ls"])).alias("ls"))
    pair = lambda ls: F.flatten(F.transform(ls, lambda x, i: F.transform(F.slice(ls, i + 2, F.greatest(F.size(ls) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    flat = sets.select(F.explode(F.array_distinct(F.flatten(F.transform("ls", pair)))).alias("p"))
    return flat.groupBy(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def _marker(patterns: tuple[str, ...], flags: int = 0) -> re.Pattern | None:
    """The patterns as one of Python's, or None if it does not know their syntax."""
    try:
        return re.compile("|".join(f"(?:{p})" for p in patterns), flags)
    except re.error:
        return None


def countable(profile: Profile) -> bool:
    """Whether the sentences of a profile's texts can be gone over in batches."""
    return codes.kind_of(profile.token) is not None and None not in (_marker(profile.contrast, re.I), _marker(profile.affect))


def _pair_sums(pattern: str, labels: list[str], contrast: tuple[str, ...], affect: tuple[str, ...], lemmas: tuple | None, group: str | None = None):
    """With ``group``, an integer column: (group, src, dst, n), in how many sentences the pair is. Else, of each chunk of texts: (src, dst, n, contrast, affect), in how many documents the pair shares a sentence, one with each mark."""
    labels = sorted(set(labels))
    size = max(len(labels), 1)
    two = [(i, x.split(" ")) for i, x in enumerate(labels) if x.count(" ") == 1]

    def placed(c: codes.Coded) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, label) of each mention, once a sentence, in order."""
        # labels of two words are not among single tokens
        own = pc.index_in(c.names, value_set=names).fill_null(-1).to_numpy().astype(np.int64)[c.code]
        hit = own >= 0
        keys = [c.unit[hit] * size + own[hit]]
        if two and len(c.code) > 1:
            v = len(c.names)
            at = pc.index_in(pa.array([w for _, ws in two for w in ws], pa.string()), value_set=c.names).fill_null(-1).to_numpy().astype(np.int64).reshape(-1, 2)
            known = (at >= 0).all(axis=1)
            wanted, of = at[known, 0] * v + at[known, 1], np.array([i for i, _ in two], np.int64)[known]
            order = np.argsort(wanted)
            wanted, of = wanted[order], of[order]
            if len(wanted):
                pair = c.code[:-1] * v + c.code[1:]
                k = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
                ok = (wanted[k] == pair) & (c.unit[:-1] == c.unit[1:])
                keys.append(c.unit[:-1][ok] * size + of[k[ok]])
        key = np.unique(np.concatenate(keys))
        return key // size, key % size

    names = pa.array(labels, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [_marker(p, f) if p else None for p, f in ((contrast, re.I), (affect, 0))]
        for batch in batches:
            for c in codes.chunks(batch.column("_x"), pattern, lemmas, units=True):
                if not len(c.code):
                    continue
                unit, label = placed(c)
                us, a, b = [], [], []
                for d in range(1, size):
                    same = np.flatnonzero(unit[d:] == unit[:-d])
                    if not len(same):
                        break
                    us.append(unit[same])
                    a.append(label[same])
                    b.append(label[same + d])
                if not us:
                    continue
                us, pair = np.concatenate(us), np.concatenate(a) * size + np.concatenate(b)
                doc = np.zeros(len(c.cuts), np.int64)
                doc[c.unit] = c.doc
                if group is not None:
                    of = batch.column(group).to_numpy()[c.first : c.last].astype(np.int64)[doc[us]]
                    groups, of = np.unique(of, return_inverse=True)
                    key, n = np.unique(of * (size * size) + pair, return_counts=True)
                    pair = key % (size * size)
                    yield pa.RecordBatch.from_arrays([pa.array(groups[key // (size * size)]), names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), pa.array(n, pa.int64())], ["g", "src", "dst", "n"])
                    continue
                some, which = np.unique(us, return_inverse=True)
                until = np.append(c.cuts[1:], len(c.data))
                texts = [c.data[i:j].tobytes().decode().strip(tx.BLANKS) for i, j in zip(c.cuts[some].tolist(), until[some].tolist(), strict=True)]
                key = doc[us] * (size * size) + pair
                every, n = np.unique(np.unique(key) % (size * size), return_counts=True)
                out = [n]
                for m in marks:
                    has = np.fromiter((m.search(t) is not None for t in texts), bool, len(texts)) if m is not None else np.zeros(len(texts), bool)
                    p, k = np.unique(np.unique(key[has[which]]) % (size * size), return_counts=True)
                    got = np.zeros(len(every), np.int64)
                    got[np.searchsorted(every, p)] = k
                    out.append(got)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(every // size)), names.take(pa.array(every % size)), *[pa.array(x, pa.int64()) for x in out]], ["src", "dst", "n", "contrast", "affect"])

    return run


def pair_counts(docs: DataFrame, profile: Profile, labels: list[str], marked: bool = True) -> DataFrame:
    """(src, dst, n, contrast, affect): what cooccurrence, rhetorical and emotional count, in one pass over the texts.

    Sentences, labels and marks are sought in whole batches, and only sums by pair leave a task:
    nothing as large as the texts is kept or shuffled.
    """
    lemmas = profile.lexicon.arrays_for([w for x in labels for w in x.split(" ")]) if profile.lexicon else None
    run = _pair_sums(profile.token, labels, profile.contrast if marked else (), profile.affect if marked else (), lemmas)
    found = codes.frame(docs, profile).mapInArrow(run, "src string, dst string, n long, contrast long, affect long")
    return found.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("n", "contrast", "affect")])


def sentence_counts(docs: DataFrame, profile: Profile, labels: list[str], group: Column) -> DataFrame:
    """(g, src, dst, n): by the value of an integer column, in how many sentences each pair is; documents without a value are left out."""
    lemmas = profile.lexicon.arrays_for([w for x in labels for w in x.split(" ")]) if profile.lexicon else None
    run = _pair_sums(profile.token, labels, (), (), lemmas, "_g")
    d = docs.withColumn("_g", group.cast("long")).filter(F.col("_g").isNotNull())
    return codes.frame(d, profile, "_g").mapInArrow(run, "g long, src string, dst string, n long").groupBy("g", "src", "dst").agg(F.sum("n").alias("n"))


def _of_counts(counts: DataFrame, column: str) -> DataFrame:
    return counts.filter(F.col(column) > 0).select("src", "dst", F.col(column).alias("n"))


def _typed(pairs: DataFrame, method: str, factor: int = 1, relation: str | None = None, emotional: bool | None = None) -> DataFrame:
    return pairs.select(
        "src", "dst", (F.col("n") * factor).cast("long").alias("weight"), F.array(F.lit(method)).alias("methods"), F.lit(relation).cast("string").alias("relation"),
        F.lit(emotional).cast("boolean").alias("emotional"), F.lit(None).cast("double").alias("surprisal"),
    )


def cooccurrence(docs: DataFrame, profile: Profile, labels: list[str], level: str = "sentence", window: int = 3, found: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    if counts is None and found is None and level == "sentence" and countable(profile):
        counts = pair_counts(docs, profile, labels, False)
    pairs = _of_counts(counts, "n") if counts is not None else _pairs(mentions(docs, profile, labels, level, window, False) if found is None else found)
    return _typed(pairs, "cooccurrence")


def rhetorical(docs: DataFrame, profile: Profile, labels: list[str], found: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Pairs in sentences with a contrast marker, two points a document."""
    if counts is None and found is None and countable(profile):
        counts = pair_counts(docs, profile, labels)
    pairs = _of_counts(counts, "contrast") if counts is not None else _pairs(mentions(docs, profile, labels) if found is None else found, lambda m: m["contrast"])
    return _typed(pairs, "rhetorical", 2, relation="contrast")


def emotional(docs: DataFrame, profile: Profile, labels: list[str], found: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    if counts is None and found is None and countable(profile):
        counts = pair_counts(docs, profile, labels)
    pairs = _of_counts(counts, "affect") if counts is not None else _pairs(mentions(docs, profile, labels) if found is None else found, lambda m: m["affect"])
    return _typed(pairs, "emotional", emotional=True)


def anaphora(docs: DataFrame, profile: Profile, labels: list[str], found: DataFrame | None = None) -> DataFrame:
    """Labels of a sentence with a pronoun, linked to each of the last three mentions before it; one point an event.

    Mentions of a document are numbered inside its row, so nothing is shuffled but pairs.
    """
    m = mentions(docs, profile, labels) if found is None else found
    # how many mentions lie before each unit
    before = F.aggregate("ms", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.size(x["ls"])))
    m = m.select("ms", before.alias("before"), F.flatten(F.transform("ms", lambda x: x["ls"])).alias("every"))
    hit = F.filter(F.zip_with("ms", "before", lambda x, n: F.struct(x["pronoun"].alias("pronoun"), x["ls"].alias("ls"), n.alias("n"))), lambda x: x["pronoun"] & (x["n"] > 0))
    recent = lambda n: F.slice(F.col("every"), F.greatest(n - 2, F.lit(1)), F.least(n, F.lit(3)))
    events = F.flatten(F.transform(hit, lambda x: F.flatten(F.transform(recent(x["n"]), lambda r: F.transform(x["ls"], lambda e: F.struct(F.least(r, e).alias("a"), F.greatest(r, e).alias("b")))))))
    e = m.select(F.explode(F.filter(events, lambda p: p["a"] != p["b"])).alias("p"))
    return _typed(e.groupBy(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).agg(F.count(F.lit(1)).alias("n")), "anaphora")


def _gram_sums(pattern: str, words: list[str], pairs: list[tuple[str, str]], lemmas: tuple | None):
    """Of each chunk of texts: (g, h, n), the counts of the wanted words and pairs by g, and of every token and bigram by a digest h of 63 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, left, right = pa.array(words, pa.string()), pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())
        for batch in batches:
            for c in codes.chunks(batch.column("_x"), pattern, lemmas):
                v = len(c.names)
                if not len(c.code):
                    continue
                h = pd.util.hash_array(np.array(c.names.to_pylist(), object), categorize=False)
                count = np.bincount(c.code, minlength=v)
                next_to = c.doc[:-1] == c.doc[1:]
                key, n = np.unique((c.code[:-1] * v + c.code[1:])[next_to], return_counts=True)
                h2 = h[key // v] * np.uint64(0x9E3779B97F4A7C15) + (h[key % v] ^ (h[key % v] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                there = np.flatnonzero(count)
                digests = np.concatenate([h[there] | np.uint64(1), (h2 ^ (h2 >> np.uint64(32))) & ~np.uint64(1)]).view(np.int64)
                at = lambda x, names=c.names: pc.index_in(x, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
                own = at(one)
                ab = np.where((at(left) < 0) | (at(right) < 0), -1, at(left) * v + at(right))
                k = np.minimum(np.searchsorted(key, ab), max(len(key) - 1, 0))
                hit = np.flatnonzero((ab >= 0) & (key[k] == ab)) if len(key) else np.zeros(0, np.int64)
                own_hit = np.flatnonzero(own >= 0)
                g = [words[i] for i in own_hit.tolist()] + [" ".join(pairs[i]) for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.nulls(len(g), pa.int64()), pa.array(np.concatenate([count[own[own_hit]], n[k[hit]]]), pa.int64())], ["g", "h", "n"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(digests), pa.string()), pa.array(digests), pa.array(np.concatenate([count[there], n]), pa.int64())], ["g", "h", "n"])

    return run


def surprisal(docs: DataFrame, profile: Profile, edges: DataFrame) -> DataFrame:
    """(src, dst, surprisal): mean over token pairs of -log2 of a smoothed bigram estimate, in the direction src to dst.

    The counts of the edges' own words are exact; of all others only how many there are is asked
    for, so they are told apart by digests (of a thousand million bigrams, one pair in twenty
    corpora may fall together, which moves no decimal that is given).
    """
    from . import graph

    each = edges.select("src", "dst", F.explode(F.split("src", " ")).alias("a"), F.split("dst", " ").alias("bs")).select("src", "dst", "a", F.explode("bs").alias("b"))
    each = graph.pinned(each.withColumn("ab", F.concat_ws(" ", "a", "b")))
    spark = docs.sparkSession
    # words of labels, which are bounded
    pairs = [(r["a"], r["b"]) for r in each.select("a", "b").distinct().collect()]
    run = _gram_sums(profile.token, sorted({a for a, _ in pairs}), pairs, codes.lemmas_of(profile))
    counted = codes.frame(docs, profile).mapInArrow(run, "g string, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n"))
    # digests of bigrams are even, those of tokens odd
    rows = counted.groupBy("g", F.when(F.col("g").isNull(), F.col("h") % 2 == 0).alias("two")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    total = {r["two"]: float(r["n"] + r["kinds"]) for r in rows if r["g"] is None}
    known = spark.createDataFrame([(r["g"], r["n"]) for r in rows if r["g"] is not None], "g string, n long")
    j = each.join(F.broadcast(known.select(F.col("g").alias("ab"), F.col("n").alias("nb"))), "ab", "left").join(F.broadcast(known.select(F.col("g").alias("a"), F.col("n").alias("nu"))), "a", "left")
    p_bi = (F.coalesce("nb", F.lit(0)) + 1) / F.lit(total.get(True, 1.0))
    p_uni = 0.01 * (F.coalesce("nu", F.lit(0)) + 1) / F.lit(total.get(False, 1.0))
    s = -F.log2(F.greatest(p_bi, p_uni, F.lit(1e-9)))
    return graph.pinned(j.groupBy("src", "dst").agg(F.round(F.avg(s), 4).alias("surprisal")))  # as many rows as edges


def merge(parts: list[DataFrame]) -> DataFrame:
    """One edge a pair: weights add up, methods are a sorted set."""
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
        F.max("relation").alias("relation"), F.bool_or("emotional").alias("emotional"), F.max("surprisal").alias("surprisal"),
    )


#: The edge methods by name: (docs, config, labels, mentions by sentence, counts by pair) to typed edges.
MAKERS: dict[str, Callable[[DataFrame, BuildConfig, list[str], DataFrame | None, DataFrame | None], DataFrame]] = {
    "cooccurrence": lambda d, c, ls, found, n: cooccurrence(d, c.profile, ls, c.level, c.window, *((found, n) if c.level == "sentence" else (None, None))),
    "rhetorical": lambda d, c, ls, found, n: rhetorical(d, c.profile, ls, found, n),
    "emotional": lambda d, c, ls, found, n: emotional(d, c.profile, ls, found, n),
    "anaphora": lambda d, c, ls, found, n: anaphora(d, c.profile, ls, found),
}


def typed(docs: DataFrame, labels: list[str], config: BuildConfig) -> DataFrame:
    """The edges of all configured methods but surprisal, at most len(labels)**2 rows, pinned.

    Methods that count pairs by document share one pass; anaphora, and patterns that cannot be
    sought in batches, share one table of mentions.
    """
    from . import graph

    methods = [m for m in config.edge_methods if m in MAKERS]
    fast = countable(config.profile)
    counts = graph.pinned(pair_counts(docs, config.profile, labels)) if fast and set(methods) - {"anaphora"} else None
    found = mentions(docs, config.profile, labels).persist() if "anaphora" in methods or not fast else None
    out = graph.pinned(merge([MAKERS[m](docs, config, labels, found, counts) for m in methods]))
    if found is not None:
        found.unpersist()
    return out


def build(docs: DataFrame, labels: list[str], config: BuildConfig) -> DataFrame:
    """All configured edge methods; surprisal is put on what they found."""
    edges = typed(docs, labels, config)
    if "perplexity" in config.edge_methods:
        s = surprisal(docs, config.profile, edges)
        edges = edges.drop("surprisal").join(s, ["src", "dst"], "left").withColumn("methods", F.array_append("methods", F.lit("perplexity")))
        edges = edges.select("src", "dst", "weight", "methods", "relation", "emotional", "surprisal")
    return edges


def by_method(edges: DataFrame, method: str) -> DataFrame:
    """The edges that a method has found."""
    return edges.filter(F.array_contains("methods", method))


def baseline(docs: DataFrame, profile: Profile, column: str = "entities", min_weight: int = 2, min_pmi: float = 1.0, top: int = 20, max_features: int = 300) -> DataFrame:
    """Document-level pairs of entities or, where no document has any, of each document's top TF-IDF terms."""
    from . import graph, vertices

    lists = None
    if column in docs.columns:
        lab = F.filter(F.transform(column, lambda e: tx.normalize_label(e["text"])), lambda x: F.length(x) >= 2)
        found = docs.select("doc_id", F.array_sort(F.array_distinct(lab)).alias("ls"))
        if not found.filter(F.size("ls") > 0).isEmpty():
            lists = found
    if lists is None:
        pairs = vertices.top_pairs(docs, profile, top, max_features, 2)
        pairs = graph.pinned(pairs)  # of max_features terms, and read several times
    else:
        pairs = pairs_of(lists, "ls").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return graph.filtered(_typed(pairs, "document"), 300, min_weight, min_pmi, 0)


def legacy_cooccurrence(docs: DataFrame, labels: str = "labels", least: int = 20) -> DataFrame:
    """Pairs of a document's own labels that are substrings of one sentence; one point a sentence."""
    s = docs.select(F.explode(F.transform(tx.long_pieces(F.col("text"), least), lambda u: F.array_sort(F.array_distinct(F.filter(labels, lambda x: F.contains(F.lower(u), x)))))).alias("ls"))
    return pairs_of(s, "ls").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
