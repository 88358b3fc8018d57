"""Steps that grow with the text: each beside plain Python or the form that it stands for, and without the shuffle that it had."""

import collections
import itertools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textgraph.config import UNICODE
from textgraph.functions import codes
from textgraph.functions import metrics as mx
from textgraph.functions import text as tx
from textgraph.operators import corpus, edges, evaluation, retrieval, stability, vertices

WORDS = ["the", "tion", "able", "from", "with", "élan", "ab-c", "-x-ray", "no", "ñandú", "straße", "漢字漢", "und", "that", "Ünder", "able.", "from!", "rest…", "a\tb", "--", "x" * 9]


def texts(seed: int, n: int = 60) -> list:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(n)] + ["", None, "...  ", "-- -a-- ab-c --abc-"]


def frame(spark, rows, n=5):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(n)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(codes, "CHUNK_BYTES", 400)


@pytest.mark.parametrize("pattern", [UNICODE.token, mx.EVAL_TOKEN, r"[а-яё][а-яё\-]{2,}"])
def test_tokens_of_batches_are_those_of_the_pattern(spark, pattern):
    docs = frame(spark, texts(1) + ["Не ложь, а Истина-мать. ёж ёлка"])
    want = {r.doc_id: r.t for r in docs.select("doc_id", tx.tokens(F.col("text"), pattern).alias("t")).collect()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for c in codes.chunks(b.column("_x"), pattern):
                lists = [[] for _ in range(c.last - c.first)]
                for d, k in zip(c.doc, c.code):
                    lists[d].append(c.names[int(k)].as_py())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.last - c.first), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "t"])

    got = codes.frame(docs, replace(UNICODE, token=pattern), "doc_id").mapInArrow(run, "doc_id long, t array<string>").collect()
    assert codes.kind_of(pattern) is not None and {r.doc_id: r.t for r in got} == want


def test_one_pass_counts_what_three_passes_over_mentions_count(spark):  # F9, F10, F12, F15, F16, F18, F20, F21
    docs = frame(spark, texts(2, 120))
    labels = ["able", "from", "that", "the", "tion", "und", "élan", "the tion", "tion able", "straße und", "absent", "a b c"]
    found = edges.mentions(docs, UNICODE, labels)
    rows = lambda df: sorted((r.src, r.dst, r.weight) for r in df.collect())
    for make in (edges.cooccurrence, edges.rhetorical, edges.emotional):
        want = rows(make(docs, UNICODE, labels, found=found))
        assert want and rows(make(docs, UNICODE, labels)) == want
        assert "MapInArrow" in plan(make(docs, UNICODE, labels))


def test_surprisal_counts_by_digest(spark):  # F15, F12
    docs = frame(spark, texts(3, 80))
    e = edges.cooccurrence(docs, UNICODE, ["able", "from", "that", "the tion", "tion"])
    one, two = collections.Counter(), collections.Counter()
    for r in docs.select(tx.tokens(F.col("text"), UNICODE.token).alias("t")).collect():
        one.update(r.t)
        two.update(zip(r.t, r.t[1:]))
    size = lambda c: c.total() + len(c)
    for r in edges.surprisal(docs, UNICODE, e).collect():
        each = [-math.log2(max((two[a, b] + 1) / size(two), 0.01 * (one[a] + 1) / size(one), 1e-9)) for a in r.src.split() for b in r.dst.split()]
        assert r.surprisal == pytest.approx(sum(each) / len(each), abs=6e-5)
    assert "explode" not in plan(vertices.term_counts(docs, UNICODE))


def test_runs_count_sentences_by_residue(spark):  # F13, F23
    docs = frame(spark, texts(4, 80))
    labels = ["able", "from", "that", "the", "tion"]
    want = collections.Counter()
    for r in docs.select("doc_id", F.transform(tx.sentences(F.col("text")), lambda u: tx.tokens(u, UNICODE.token)).alias("u")).collect():
        for u in r.u:
            want.update((r.doc_id % 5, a, b) for a, b in itertools.combinations(sorted(set(u) & set(labels)), 2))
    got = edges.sentence_counts(docs, UNICODE, labels, F.pmod("doc_id", F.lit(5))).collect()
    assert {(r.g, r.src, r.dst): r.n for r in got} == dict(want)


def test_ranks_without_pairs(spark):  # F1, F2
    docs = frame(spark, texts(5, 80) + ["lone"])
    want = {r.label: r["rank"] for r in vertices.pagerank(vertices.window_pairs(docs, UNICODE), 4, tolerance=0.0).collect()}
    got = {r.label: r["rank"] for r in vertices.window_rank(docs, UNICODE, 4, tolerance=0.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)
    assert {r.label for r in vertices.textrank(docs, UNICODE, 5).collect()} <= want.keys()


def test_terms_that_always_go_together_are_equal(spark):  # F3
    rng = random.Random(6)
    passage = "zeta yota kappa omega"
    rows = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 9))) + (f". {passage}" if rng.random() < 0.5 else "") for _ in range(600)]
    got = [(r.label, r.score) for r in vertices.tfidf(frame(spark, rows, 9), UNICODE, 40).orderBy(F.desc("score"), "label").collect() if set(r.label.split()) <= set(passage.split())]
    assert len(got) == 7 and len({s for _, s in got}) == 1 and [x for x, _ in got] == sorted(x for x, _ in got)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_grams_and_weights(spark, k):  # F6, F7
    docs = frame(spark, texts(7, 80))
    df, total, tf = collections.Counter(), collections.Counter(), {}
    for r in docs.select("doc_id", tx.tokens(F.col("text"), UNICODE.token).alias("t")).collect():
        t = [w for w in r.t if w not in UNICODE.stop_words]
        tf[r.doc_id] = collections.Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
        total.update(tf[r.doc_id])
        df.update(tf[r.doc_id].keys())
    best = sorted((w for w in total if df[w] >= 3), key=lambda w: (-total[w], w))[:k]
    assert vertices.top_grams(docs, UNICODE, k, 3) == [(w, df[w]) for w in best]
    idf = {w: math.log((1 + len(tf)) / (1 + df[w])) + 1 for w in best}
    want = {}
    for i, c in tf.items():
        x = {w: c[w] * idf[w] for w in best if c[w]}
        want |= {(i, w): v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()}
    w = vertices.tfidf_weights(docs, UNICODE, k, 3)
    got = {(r.doc_id, r.term): r.tfidf for r in w.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-12) for x in want)
    lists = collections.defaultdict(list)
    for (i, t), v in want.items():
        lists[i].append((-round(v, 9), t))
    pairs = collections.Counter(p for x in lists.values() for p in itertools.combinations(sorted(t for _, t in sorted(x)[:4]), 2))
    assert {(r.src, r.dst): r.n for r in vertices.top_pairs(docs, UNICODE, 4, k, 3).collect()} == dict(pairs)
    assert "doc_id" not in plan(vertices.top_pairs(docs, UNICODE, 4, k, 3)).split("Exchange")[1].split("\n")[0]


def test_phrases_are_scored_in_the_row(spark):  # F5, F16
    docs = spark.createDataFrame(list(enumerate(texts(8, 50))), "doc_id long, text string")
    found = corpus.keyphrases(docs, UNICODE.token, UNICODE.stop_words, 3, 6)
    tops = corpus.top_tokens(docs, UNICODE.token, 4)
    assert "Exchange" not in plan(found) + plan(tops)
    got, best = {r.doc_id: r.keywords for r in found.collect()}, {r.doc_id: r.keywords for r in tops.collect()}
    rows = docs.select("doc_id", tx.tokens(F.col("text"), UNICODE.token).alias("t")).collect()
    assert len(got) == len(rows) == len(best)
    for r in rows:
        f, at = collections.Counter(), {}
        for n in (1, 2, 3):
            for i in range(len(r.t) - n + 1):
                if r.t[i] not in UNICODE.stop_words and r.t[i + n - 1] not in UNICODE.stop_words:
                    f[n, " ".join(r.t[i : i + n])] += 1
                    at.setdefault((n, " ".join(r.t[i : i + n])), i)
        ranked = sorted(f, key=lambda x: (-round(f[x] * x[0] / math.log2(at[x] + 4), 9), x[1]))
        assert got[r.doc_id] == [g for _, g in ranked[:6]]
        c = collections.Counter(r.t)
        assert best[r.doc_id] == sorted(c, key=lambda w: (-c[w], w))[:4]


def test_scores_shuffle_no_grams(spark):  # F4, F8, F14, F17
    rows = [(1, "Ab cd ab. ef", "ab cd xx"), (2, None, "ab"), (3, "", ""), (None, "ab", "ab"), (5, "aa bb", "aa bb"), (5, "cc", "aa bb")]
    pairs = spark.createDataFrame(rows, "k int, answer string, reference string")
    for df, c in ((evaluation.semantic(pairs, ["k"]), "semantic"), (evaluation.rouge_n(pairs, ["k"], 2), "rouge2")):
        got = sorted(((r.k, r[c]) for r in df.collect()), key=str)
        assert len(got) == len(rows) and ", g#" not in plan(df)
        assert {s for k, s in got if k in (None, 2, 3)} == {0.0}
    two = {r.k: r.rouge2 for r in evaluation.rouge_n(pairs, ["k"], 2).collect()}
    assert two[1] == 0.5 and two[5] == 0.5  # rows of one key are counted together, as its SQL does
    points = spark.createDataFrame([(["alphabet", "beta", "no"], "ALPHABETIC order"), ([], "x"), (["no"], None)], "p array<string>, a string")
    cover = points.select("p", "a", mx.keypoint_coverage(F.col("p"), F.col("a")).alias("c"), F.when(F.size("p") > 0, F.size(F.filter("p", lambda p: mx.keypoint_hit(p, F.lower(F.coalesce("a", F.lit(""))))) ) / F.size("p")).otherwise(0.0).alias("w"))
    assert [r.c for r in cover.collect()] == [r.w for r in cover.collect()]


def test_a_dictionary_beyond_the_bound_is_used_in_parts(spark, monkeypatch):  # F19
    rng = random.Random(9)
    forms = [f"stem{chr(97 + i % 26)}{chr(97 + i // 26)}{e}" for i in range(100) for e in ("one", "two", "six")]
    docs = frame(spark, [" ".join(rng.choices(forms, [1 / (1 + i // 3) ** 2 for i in range(300)], k=12)) + "." for _ in range(150)])
    lemmas = spark.createDataFrame([(f, f[:6]) for f in forms], "token string, lemma string")
    want = replace(UNICODE, lexicon=tx.Lexicon(lemmas))
    want.lexicon.arrays()
    labels = [r.label for r in vertices.docfreq(docs, want, 5).collect()]
    df = collections.Counter()
    for r in docs.collect():
        df.update({w.strip(".")[:6] for w in r.text.split()})
    assert sorted(labels) == sorted(sorted(df, key=lambda w: (-df[w], w))[:5])
    pairs = sorted(edges.cooccurrence(docs, want, sorted(labels)).select("src", "dst", "weight").collect())
    monkeypatch.setattr(tx.Lexicon, "MAX_FORMS", 290)
    p = replace(UNICODE, lexicon=tx.Lexicon(lemmas))
    assert sorted(r.label for r in vertices.docfreq(docs, p, 5).collect()) == sorted(labels)
    assert sorted(edges.cooccurrence(docs, p, sorted(labels)).select("src", "dst", "weight").collect()) == pairs


def test_first_documents_by_seed(spark):  # F22
    docs = frame(spark, texts(10, 60))
    seed = spark.createDataFrame([(1, "the"), (1, "the tion"), (2, "élan"), (3, "absent"), (4, "able from")], "q_id long, id string")
    got = collections.defaultdict(list)
    out = retrieval.snippets(docs, seed, UNICODE, 3)
    for r in sorted(out.collect()):
        got[r.q_id].append(r.doc_id)
    rows = sorted((r.doc_id, r.t) for r in docs.select("doc_id", tx.tokens(F.col("text"), UNICODE.token).alias("t")).collect())
    for q in (1, 2, 3, 4):
        ids = {r.id for r in seed.collect() if r.q_id == q}
        assert got[q] == [i for i, t in rows if ids & {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}][:3]


def test_runs_of_a_stress_test_move_a_text_once(spark):  # F10
    docs = frame(spark, texts(11, 90)).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))
    want = {r.run_id: sorted(r.ids) for r in stability.runs(docs, 3, 0.2, 42).groupBy("run_id").agg(F.collect_list("doc_id").alias("ids")).collect()}
    seen = []

    def build(kept):
        seen.append((sorted(r.doc_id for r in kept.select("doc_id").collect()), plan(kept)))
        return edges.cooccurrence(kept, UNICODE, ["able", "that", "the", "tion"])

    nodes, _ = stability.stress(docs, build, 3, 0.2, 42, 0.5)
    assert [ids for ids, _ in seen] == [want[i] for i in range(3)] and {r.votes for r in nodes.collect()} == {3}
    assert all("explode" not in line or "text" not in line for _, p in seen for line in p.split("\n"))
