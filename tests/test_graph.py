import itertools
import random

from pyspark.sql import functions as F

from textgraph.config import CYRILLIC, UNICODE
from textgraph.operators import corpus, edges, evaluation, graph, profile, retrieval, stability, vertices


def frame(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src string, dst string, weight long")


def test_backbone_pmi_and_ties(spark):
    g = frame(spark, [("a", "b", 5), ("a", "c", 5), ("a", "d", 1), ("b", "c", 2), ("d", "e", 3), ("e", "f", 3)])
    kept = {(r.src, r.dst) for r in graph.backbone(g, 1).collect()}
    assert kept == {("a", "b"), ("a", "c"), ("d", "e"), ("e", "f")}
    p = {(r.src, r.dst): r.pmi for r in graph.pmi(g).collect()}
    assert p["e", "f"] == 2.6630 or round(p["e", "f"], 3) == round(__import__("math").log2(3 * 19 / (6 * 3)), 3)
    assert graph.components(g).select("component").distinct().count() == 1


def test_walk_equals_queue_rule(spark):
    g = frame(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1)])
    s = spark.createDataFrame([(1, "a")], "q_id int, id string")
    seen = retrieval.walk(g, s, 2)
    assert {r["id"] for r in seen.collect()} == {"a", "b", "c"}
    g2 = g.withColumn("relation", F.lit(None).cast("string")).withColumn("methods", F.array(F.lit("cooccurrence")))
    assert {(r.src, r.dst) for r in retrieval.walk_edges(g2, seen, s).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}


def test_anaphora_equals_sequential_rule(spark):
    rng = random.Random(3)
    labels = ["aaaa", "bbbb", "cccc", "dddd", "eeee"]
    docs = []
    for i in range(60):
        sents = [" ".join(rng.sample(labels, rng.randint(0, 3)) + (["they"] if rng.random() < 0.5 else ["xx"])).capitalize() + "." for _ in range(6)]
        docs.append((i, " ".join(sents)))
    want = {}
    for _, t in docs:
        recent = []
        for s in t.split(". "):
            low = s.lower().rstrip(".").split()
            ents = [w for w in low if w in labels]
            if "they" in low and recent and ents:
                for r, e in itertools.product(recent[-3:], ents):
                    if r != e:
                        k = (min(r, e), max(r, e))
                        want[k] = want.get(k, 0) + 1
            recent = (recent + ents)[-5:]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.src, r.dst): r.weight for r in edges.anaphora(df, UNICODE, labels).collect()}
    assert got == want


def test_typed_edges_of_russian_sentences(spark):
    df = spark.createDataFrame([(1, "Не ложь, а истина. Это манипуляция: истина и ложь."), (2, "Истина рядом. Ложь далеко.")], "doc_id long, text string")
    labels = ["истина", "ложь", "истина ложь"]
    e = edges.merge([edges.cooccurrence(df, CYRILLIC, labels), edges.rhetorical(df, CYRILLIC, labels), edges.emotional(df, CYRILLIC, labels)])
    got = {(r.src, r.dst): (r.weight, r.relation, r.emotional) for r in e.collect()}
    assert got["истина", "ложь"] == (4, "contrast", True)


def test_votes_floor_and_core(spark):
    assert [stability.vote_floor(5, t) for t in (0.5, 0.6, 0.1)] == [2, 3, 1]
    runs = spark.createDataFrame([(i, "a", "b") for i in range(5)] + [(0, "a", "c"), (1, "b", "c")], "run_id int, src string, dst string")
    nodes, pairs = stability.core(runs, 5, 0.5)
    assert {r["id"]: r["stability"] for r in nodes.collect()} == {"a": 1.0, "b": 1.0, "c": 0.4}
    assert {(r.src, r.dst) for r in pairs.collect()} == {("a", "b")}


def test_communities(spark):
    two = [(a, b, 1.0) for part in ("abcd", "wxyz") for a, b in itertools.combinations(part, 2)] + [("d", "w", 1.0)]
    for method in (graph.louvain, graph.greedy_modularity):
        c = method(two)
        assert len(set(c.values())) == 2 and len({c[v] for v in "abcd"}) == 1
    assert max(graph.betweenness(two), key=graph.betweenness(two).get) in "dw"
    lp = {r["id"]: r["community"] for r in graph.label_propagation(frame(spark, [(a, b, int(w)) for a, b, w in two])).collect()}
    assert len({lp[v] for v in "abcd"}) == 1


def test_docfreq_merge_and_longest(spark):
    df = spark.createDataFrame([(i, "интересное слово истина") for i in range(3)] + [(9, "истина")], "doc_id long, text string")
    v = {r["label"]: r["score"] for r in vertices.docfreq(df, CYRILLIC, 10).collect()}
    assert v["истина"] == 1.0 and v["слово"] == 0.75
    urls = spark.createDataFrame([(1, "u", "aa"), (2, "u", "bbb"), (3, "u", "ccc"), (4, "", "x"), (5, None, "x"), (6, "v", None)], "doc_id long, url string, text string")
    assert sorted(r.doc_id for r in corpus.keep_longest(urls).collect()) == [2, 6]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert vertices.docfreq(none, UNICODE).count() == 0
    assert edges.cooccurrence(none, UNICODE, ["a"]).count() == 0 and edges.cooccurrence(none, UNICODE, []).count() == 0
    assert profile.corpus_stats(none).first()["n_docs"] == 0
    assert graph.pmi(frame(spark, []) if False else spark.createDataFrame([], "src string, dst string, weight long")).count() == 0
    pairs = spark.createDataFrame([(1, None, "a b"), (2, "a", None)], "k int, answer string, reference string")
    assert evaluation.semantic(pairs.na.fill(""), ["k"]).filter("semantic = 0").count() == 2


def test_every_label_has_a_summary(spark):
    from textgraph import queries as q

    d = "/root/testdata/sf0.001"
    got = [r.label for r in q.QUERIES["vertex_summaries"](spark, d).collect()]
    assert sorted(got) == sorted(q._labels(spark, d)) and len(got) > 10
