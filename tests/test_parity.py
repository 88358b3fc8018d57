"""Rules that SQL cannot hold against: plain Python beside them, on small frames."""

import collections
import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgraph import config, reports
from textgraph.config import UNICODE
from textgraph.functions import metrics as mx
from textgraph.functions import text as tx
from textgraph.operators import corpus, edges, evaluation, graph, profile, retrieval, stability, vertices


def test_lemmas_and_content_words_through_the_build(spark):
    docs = spark.createDataFrame([(i, "Towns grow. The town has rivers and a river.") for i in range(3)], "doc_id long, text string")
    lemmas = spark.createDataFrame([("towns", "town"), ("rivers", "river")], "token string, lemma string")
    content = spark.createDataFrame([("grow", False), ("has", False)], "term string, is_content boolean")
    p = replace(UNICODE, lexicon=tx.Lexicon(lemmas, content))
    labels = edges.labels_of(vertices.docfreq(docs, p))
    assert labels == ["river", "town"]
    assert [(r.src, r.dst, r.weight) for r in edges.cooccurrence(docs, p, labels).collect()] == [("river", "town", 3)]
    assert {r.label for r in vertices.tfidf(docs, p).collect()} >= {"town", "river", "town has"}
    plain = edges.labels_of(vertices.docfreq(docs, UNICODE))
    assert "towns" in plain and "rivers" in plain


def test_two_word_labels_by_place(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma. They saw beta gamma and alpha.")], "doc_id long, text string")
    (row,) = edges.mentions(docs, UNICODE, ["alpha", "beta gamma", "gamma"]).collect()
    assert [m.ls for m in row.ms] == [["alpha", "beta gamma", "gamma"], ["beta gamma", "gamma", "alpha"]]
    assert [m.pronoun for m in row.ms] == [False, True]


def test_relevance_walks_candidates_and_skips():
    rng = np.random.default_rng(0)
    cand = rng.normal(size=(40, 8))
    cand /= np.linalg.norm(cand, axis=1, keepdims=True)
    doc = cand[0]
    names = [f"c{i}" for i in range(40)]
    chosen = []
    for i in np.argsort(-(cand @ doc), kind="stable"):
        red = max((float(cand[i] @ cand[j]) for j in chosen), default=None)
        if red is None or 0.5 * float(cand[i] @ doc) - 0.5 * red > 0.05 or len(chosen) < 5:
            chosen.append(int(i))
    assert [n for n, _ in vertices.mmr(names, cand, doc, 40)] == [names[i] for i in chosen]


def test_last_valid_object_of_a_reply(spark):
    rows = [('<think>{"a": 9}</think>{"a": 1} {"a": 2} {"a": }', '{"a": 2}'), ("```json\n{\"a\": 3}\n```", '{"a": 3}'), ("none", None), ("{broken} {a}", None), (None, None)]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string").select("i", mx.judge_json(F.col("r")).alias("j")).orderBy("i").collect()
    assert [g.j for g in got] == [w for _, w in rows]


def test_longest_common_subsequence_and_rouge(spark):
    rng = random.Random(1)
    pairs = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=rng.randint(0, 30))), " ".join(rng.choices(["aa", "bb", "cc"], k=rng.randint(0, 30)))) for i in range(60)] + [(98, None, "aa"), (99, "aa", None)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(pairs, "k int, answer string, reference string")
    got = {r.k: r for r in evaluation.scored(df, ["k"]).collect()}
    for k, a, b in pairs:
        h, r = (a or "").split(), (b or "").split()
        n = lcs(h, r)
        want = 0.0 if not n else 2 * (n / len(h)) * (n / len(r)) / (n / len(h) + n / len(r))
        assert got[k].rouge_l == pytest.approx(want)
        for size in (1, 2):
            grams = lambda w: collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))  # noqa: B023, E731
            g = grams(r)
            assert got[k][f"rouge{size}"] == pytest.approx(sum((grams(h) & g).values()) / g.total() if g else 0.0)


def test_window_pairs_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(vertices, "CHUNK_TOKENS", 20)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(30)]
    want = collections.Counter()
    for t in texts:
        toks = t.split()
        for i in range(len(toks)):
            want.update(itertools.combinations(sorted(set(toks[i : i + 4])), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = vertices.window_pairs(docs, UNICODE)
    assert {(r.a, r.b): r.weight for r in pairs.collect()} == dict(want)
    rank = {w: 1 / 6 for w in words}
    total = {w: sum(n for p, n in want.items() if w in p) for w in words}
    for _ in range(200):
        rank = {w: 0.15 / 6 + 0.85 * sum(rank[a if b == w else b] * n / total[a if b == w else b] for (a, b), n in want.items() if w in (a, b)) for w in words}
    got = {r.label: r["rank"] for r in vertices.pagerank(pairs).collect()}
    assert all(math.isclose(got[w], rank[w], abs_tol=1e-5) for w in words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, actor string, source string")


def test_dropout_of_known_actors(spark):
    docs = frame(spark, [(i, "x" if i < 20 else None, "s") for i in range(60)])
    got = stability.runs(docs, 4, 0.25, 42).groupBy("run_id").agg(F.collect_list("doc_id").alias("ids")).collect()
    assert len(got) == 4
    for r in got:  # 5 of 20 go, then 5 of 55
        assert len(r.ids) == math.floor(55 * 0.9) and len(set(r.ids)) == len(r.ids)
    assert len({tuple(sorted(r.ids)) for r in got}) == 4
    few = frame(spark, [(i, "x", "s") for i in range(11)])
    assert {r["count"] for r in stability.runs(few, 3, 0.9, 1).groupBy("run_id").count().collect()} == {11}  # undone: fewer than ten would stay


def test_dropout_by_source_where_no_actor_is_known(spark):
    docs = frame(spark, [(i, "", f"s{i % 4}" if i % 4 else None) for i in range(20)])
    got = stability.runs(docs, 6, 0.3, 7).groupBy("run_id").agg(F.count_distinct(F.coalesce("source", F.lit("-"))).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all((r.s, r.n) == (3, 15) for r in got)
    one = frame(spark, [(i, None, "s") for i in range(40)])
    assert {r["count"] for r in stability.runs(one, 3, 0.2, 7).groupBy("run_id").count().collect()} == {math.floor(32 * 0.9)}
    assert {r["count"] for r in stability.runs(one.filter("doc_id < 8"), 3, 0.5, 7).groupBy("run_id").count().collect()} == {8}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(150)], "src string, dst string, weight long")
    assert {r.component for r in graph.components(chain).collect()} == {"000"}
    assert graph.n_components(chain).first()[0] == 1 and graph.metrics(chain).first()["components"] == 1


def test_betweenness_against_all_shortest_paths():
    rng = random.Random(5)
    es = [(str(a), str(b), 1.0) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.35]
    adj = collections.defaultdict(set)
    for a, b, _ in es:
        adj[a].add(b)
        adj[b].add(a)

    def paths(a, b):
        todo, found = [[a]], []
        while todo and not found:
            found = [p for p in todo if p[-1] == b]
            todo = [[*p, n] for p in todo for n in sorted(adj[p[-1]]) if n not in p]
        return found

    want = dict.fromkeys(adj, 0.0)
    for a, b in itertools.combinations(sorted(adj), 2):
        ps = paths(a, b)
        for p in ps:
            for v in p[1:-1]:
                want[v] += 1 / len(ps)
    got = graph.betweenness(es)
    ratio = {round(got[v] / want[v], 6) for v in want if want[v]}
    assert len(ratio) == 1 and all(got[v] == 0 for v in want if not want[v])  # up to the scale


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(120, 6))
    e[7] = e[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "id long, e array<double>")
    q = rows.filter("id % 10 = 3").withColumnRenamed("id", "q_id")
    want = {(i, int(j), k + 1) for i in range(3, 120, 10) for k, j in enumerate(sorted(range(120), key=lambda j: (-round(float(e[i] @ e[j]), 9), j))[:4])}
    for block in (1024, 5):
        assert {tuple(r) for r in retrieval.nearest(q, rows, 4, block).collect()} == want
    assert retrieval.nearest(q.filter("false"), rows).count() == 0


def test_reports_and_community_context(spark):
    e = spark.createDataFrame([("a", "b", 5, ["cooccurrence"], "contrast", 2.5), ("b", "c", 3, ["emotional"], None, 4.0), ("x", "y", 1, ["cooccurrence"], None, 1.0)], "src string, dst string, weight long, methods array<string>, relation string, surprisal double")
    text = reports.hot_edges(e, "towns", 2, explain=lambda p: p.upper())
    assert text.index("1. b - c") < text.index("2. a - b") and "relation: contrast" in text and "TOWNS" in text
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("x", 1), ("y", 1)], "id string, community int")
    q = spark.createDataFrame([(1, "cooccurrence")], "q_id int, q string")
    (row,) = retrieval.community_context(e, labels, q, 2).collect()
    assert '"a" - "b" [contrast] (cooccurrence)' in row.context and "b, a, c" in row.context
    (own,) = retrieval.community_context(e, labels, q, 2, summarise=lambda m: "own " + "+".join(m)).collect()
    assert "own b+a+c" in own.context
    scores = spark.createDataFrame([("walk", 0.5, 0.25), ("long", 0.75, 0.5)], "method string, rouge1 double, composite double")
    table = reports.metrics(scores, ["rouge1", "composite"])
    assert table.index("| long |") < table.index("| walk |")
    answers = spark.createDataFrame([(1, m, f"answer of {m}") for m in ("walk", "long")], "q_id int, method string, answer string")
    report, key = reports.blind(answers, q, 42)
    assert "answer of walk" in report and "walk" in key and report.count("**") == 4


def test_presets_and_tags(spark):
    assert config.SCIENCE_CITIES.vertex_methods == ("ner", "yake", "tfidf", "textrank", "paraphrase_cluster") and "anaphora" in config.SCIENCE_CITIES.edge_methods
    assert "она" in config.CYRILLIC.stop_words
    rows = spark.createDataFrame([("'a', \"b\" ,",), ("nan",), ("True",), (None,)], "t string")
    assert [r.x for r in rows.select(tx.parse_listed_tags(F.col("t")).alias("x")).collect()] == [["a", "b"], [], [], []]
    named = spark.createDataFrame([("from new haven to york",), ("none",)], "t string").select(corpus.city(F.col("t"), ["york", "new haven"]).alias("c"), corpus.text_kind(F.lit("speech")).alias("k")).collect()
    assert [r.c for r in named] == ["York", None] and named[0].k == "speech"
    nbsp = spark.createDataFrame([("One.\u00a0Two.",)], "t string").select(tx.sentences(F.col("t")).alias("s")).first()
    assert nbsp.s == ["One.", "Two."]


def test_budgets_with_reference(spark):
    ctx = spark.createDataFrame([("walk", 1, "towns and rivers"), ("long", 1, "nothing")], "method string, q_id int, context string")
    gold = spark.createDataFrame([(1, ["rivers"], "towns and rivers")], "q_id int, keypoints array<string>, reference string")
    got = {(r.method, r.budget): (r.recall, round(r.semantic, 6)) for r in evaluation.budget_eval(ctx, gold, (5, 100), "reference").collect()}
    assert got["walk", 100] == (1.0, 1.0) and got["walk", 5][0] == 0.0 and got["long", 100][0] == 0.0


def test_command_line(spark, tmp_path):
    from textgraph.__main__ import main

    main(["build", "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "out"), "--preset", "unicode"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out/graph/edges")).count() > 100
    assert spark.read.json(str(tmp_path / "out/run_meta")).first()["nodes"] > 10
    main(["stats", "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "stats")])
    assert spark.read.json(str(tmp_path / "stats/corpus_stats")).first()["n_docs"] == 200
