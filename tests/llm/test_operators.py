"""Each operator against brute force on small tables, with nulls, ties, repeats, clashing columns and no rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textgraph.llm import byte_bpe, common, decontamination, fingerprints, html_extraction, kernels, line_dedup, near_dedup, pu_learning, quality, queries, sharding, suffix_dedup, toxicity

PASSAGE = "this shared passage of text runs on for well over one hundred bytes so that it can be found wherever it has been copied to"
ROWS = [
    (1, "Alpha one two three four five\nfoot line\n" + PASSAGE, "x"),
    (2, None, "y"),
    (3, "", None),
    (4, "lead " + PASSAGE + " tail\n Foot Line ", "x"),
    (5, "Alpha one two three four five\nfoot line\n" + PASSAGE, "x"),
    (6, " ".join(f"w{i}" for i in range(300)), "z"),
    (7, " ".join(f"w{i}" if i != 150 else "changed" for i in range(300)), "z"),
    (7, "a repeated id", "z"),
    (None, "no id at all", "z"),
    (8, "x", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with names used inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("_uid", F.lit(5)).withColumn("score", F.lit("s")).withColumn("label", F.lit(1))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_line_dedup(docs, empty):
    out = line_dedup.dropped_lines(docs, min_docs=3, batches=2).collect()
    got = sorted((r.text or "", r._n_lines, r._n_dropped, r._kept) for r in out)
    key = lambda s: s.strip(line_dedup.STRIPPED).lower()
    count = {}
    for _, t, _ in ROWS:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = []
    for _, t, _ in ROWS:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (key(x) and count[key(x)] >= 3)]
        want.append((t or "", len(ls), len(ls) - len(stay), "\n".join(stay)))
    assert got == sorted(want)
    assert line_dedup.dropped_lines(empty).count() == 0


def test_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fan_in=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1), (2, i)], "a long, b int"))
    assert [r.a for r in runs.frequent_keys().collect()] == [1]
    assert sum(map(len, runs.levels)) < 5


def test_runs_stay_frequent_over_many_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fan_in=2)
    for i in range(9):
        runs.add(spark.createDataFrame([(1, 1), (2, 10 + i), (3, i // 2), (4, 8 if i in (0, 8) else 100 + i)], "a long, b int"))
    assert sorted((r.a, r.b) for r in runs.frequent_keys().collect()) == [(1, 1), (3, 0), (3, 1), (3, 2), (3, 3), (4, 8)]


@pytest.mark.parametrize("hot_keys", [1, 3, 1 << 14])
def test_lines_hot_or_not(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    rows = [(i, "\n".join(["everywhere", f"half {i % 2}", f"own {i}"])) for i in range(20)]
    out = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert sorted((r.doc_id, r._n_dropped, r._kept) for r in out) == [(i, 2, f"own {i}") for i in range(20)]


def test_ranges_of_ids(spark):
    ids = [None, -(2**63), -5, *range(0, 3000, 7), 2**63 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "i long")
    for bounds in ([], [3], [-(2**63), 0, 7], list(range(-10, 3000, 10)), list(range(1, 2000, 3))):
        got = {r.i: r.r for r in rows.select("i", common.range_of(F.col("i"), bounds).alias("r")).collect()}
        assert got == {i: 0 if i is None else sum(b <= i for b in bounds) for i in ids}
    bounds = common.id_bounds(spark.range(100_000), "id", 3000)  # approximate percentiles
    assert len(bounds) == 2999 and max(abs(b - 100_000 * i / 3000) for i, b in enumerate(bounds, 1)) < 10


def removed(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [PASSAGE + "ab" * 90, None, "", "zz" + PASSAGE[5:] + "ab" * 80, PASSAGE + "ab" * 90, "short", "é" * 120, "q" + "é" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, t string")
    got = [tuple(r) for r in suffix_dedup.deduplicated(df, False).orderBy("uid").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == removed(texts)
    assert suffix_dedup.deduplicated(df.filter("false")).count() == 0


def test_near_dedup(docs, empty):
    known = docs.select("doc_id", "text")
    got = near_dedup.representatives(docs)
    assert got.columns == docs.columns
    texts = [r.text for r in got.collect()]
    # one of each: the repeated document, the null and the empty text, the pair of long ones
    assert len(texts) == len(ROWS) - 3 and texts.count(ROWS[0][1]) == 1 and ROWS[5][1] in texts and ROWS[6][1] not in texts
    assert near_dedup.classes(known).count() == len(ROWS)
    assert near_dedup.classes(empty.select("doc_id", "text")).count() == 0


def test_chain_of_links_is_one_class(spark):
    base = [f"v{i}" for i in range(400)]
    rows = []
    for k in range(6):  # each differs from the one before in a few words
        base = [w if i % 57 != k else f"n{k}_{i}" for i, w in enumerate(base)]
        rows.append((k, " ".join(base)))
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_uid for r in out} == {0}


def test_copies_that_meet_only_in_a_shared_passage(spark):
    """The hub of their buckets is a foreign text with the same passage."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, passage + [f"f{k}_{i}" for i in range(50 + 9 * k)]) for k in range(12)]
    for k in range(12, 36, 2):
        own = [f"d{k}_{i}" for i in range(40)]
        changed = [w if i % 3 else f"x{k}_{i}" for i, w in enumerate(own)]
        rows += [(k, passage + own), (k + 1, passage + changed)]
    got = {r.uid: r.class_uid for r in near_dedup.classes(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()}
    want = {k: min(j for j, v in rows if near_dedup.similar(w, v)) for k, w in rows}
    assert got == want and sum(k != c for k, c in got.items()) == 12


@pytest.mark.parametrize("block", [1024, 16])
def test_copies_among_many_texts_with_a_passage(spark, monkeypatch, block):
    """However many foreign texts of like length share the passage, no hub stands between two copies."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(0, 120, 2):
        own = [f"d{k}_{i}" for i in range(40)]
        rows += [(k, passage + own), (k + 1, passage + [w if i % 3 else f"x{k}_{i}" for i, w in enumerate(own)])]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert {r.uid: r.class_uid for r in near_dedup.classes(table).collect()} == {k: k - k % 2 for k, _ in rows}


def test_only_members_with_a_partner_go_to_blocks(spark, monkeypatch):
    """All that have one of another class within the length rule in their bucket, and not the large classes whose lengths lie apart."""

    def received(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("rep")], ["a", "b"])

    monkeypatch.setattr(near_dedup, "_compared", received)
    rng = np.random.default_rng(5)
    members = [(key, rep, 150 if rep % 2 else 80, 2 + rep % 2) for key in range(8) for rep in range(10, 210)]  # two classes
    members += [(key, rep, 100, 5) for key in range(8, 12) for rep in range(210, 260)]  # one class, not the hub's
    lengths = {rep: int(n) for rep, n in zip(range(300, 500), np.exp(rng.uniform(np.log(4), np.log(4000), 200)), strict=True)}
    lengths |= {500: 80, 501: 100, 502: 200, 503: 251, 504: 1000, 505: 1250}  # at the ratio, just beyond it, at it
    members += [(key, rep, n, rep if rep % 3 else 300) for key in range(12, 40) for rep, n in lengths.items() if rep >= 500 and key == 12 or rep < 500 and rng.random() < 0.08]
    met = spark.createDataFrame([(k, rep, n, 1, n, 1000, 100_000) for k, rep, n, _ in members], "key long, rep long, n long, hub long, hub_n long, size long, all_words long")
    roots = spark.createDataFrame(sorted({(rep, root) for _, rep, _, root in members}), "node long, root long")
    texts = spark.createDataFrame(sorted({(rep, "x") for _, rep, _, _ in members}), "uid long, t string")
    got = [(r.a, r.b) for r in near_dedup._rest(met, roots, texts).collect()]

    def partnered(ratio):
        return {(k, a) for k, a, n, r in members if any(k == l and r != q and min(n, m) >= ratio * max(n, m) - 1e-9 for l, _, m, q in members)}

    assert len(got) == len(set(got)) and {(12, 500), (12, 501), (12, 504), (12, 505)} <= set(got)
    assert partnered(0.8) <= set(got) <= partnered(0.8 ** (18 / 16)) and 0 < len(got) < len(members) - 1600


def test_sketches_keep_the_miss_rate():
    for n in range(near_dedup.TINY + 1, 2000):
        length = near_dedup.SHORT_LENGTH if n <= near_dedup.SHORT else near_dedup.LENGTH
        assert (1 - near_dedup.sketch_chance(n, length)) ** near_dedup.SKETCHES <= near_dedup.MISS


@pytest.mark.parametrize("n,every", [(5, 3), (6, 4), (7, 4), (9, 5), (10, 5), (12, 6), (20, 5), (49, 5), (60, 5), (200, 5), (200, 6)])
def test_copies_at_the_threshold(n, every):
    """Evenly spread changes, as many as the threshold allows, leave a common key."""
    found = 0
    for k in range(200):
        a = kernels.mix(np.arange(n, dtype=np.uint64) + np.uint64(1 + 10_000 * k))
        b = a.copy()
        b[every - 1 :: every] ^= np.uint64(1)
        assert near_dedup.similar(a.tolist(), b.tolist())
        owner, keys = near_dedup._keys(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        found += bool(np.intersect1d(keys[owner == 0], keys[owner == 1]).size)
    assert found == 200 if n <= near_dedup.TINY else found >= 190


def test_bins_rule_no_copies_out():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(60)]
    texts += [np.where(rng.random(len(t)) < 0.15, 99, t) for t in texts]
    wh = np.concatenate(texts).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bins = near_dedup.binned(wh, bounds)
    at = np.arange(len(texts))
    got = {(int(a), int(b)) for p in near_dedup._open_pairs(np.diff(bounds), at, bins, at, at) for a, b in zip(*p, strict=True)}
    near = {(a, b) for a in at for b in at if a < b and near_dedup.similar(texts[a].tolist(), texts[b].tolist())}
    assert near and near <= got


@pytest.mark.parametrize("changed", [0.1, 0.15, 0.18, 0.2])
@pytest.mark.parametrize("n", [30, 100, 400])
def test_recall_by_similarity(changed, n):
    """Of pairs within the threshold with edits at random places, at least nine in ten share a key."""
    rng = np.random.default_rng(n)
    near = found = 0
    for k in range(200):
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        b = np.where(rng.random(n) < changed, rng.integers(0, 2**62, n).astype(np.uint64), a)
        if near_dedup.similar(a.tolist(), b.tolist()):
            owner, keys = near_dedup._keys(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            near, found = near + 1, found + bool(np.intersect1d(keys[owner == 0], keys[owner == 1]).size)
    assert near >= 20 and found >= 0.9 * near


def test_components_against_plain_search(spark):
    rng = np.random.default_rng(4)
    path = [(i, i + 1) for i in range(100, 300)]  # a long chain in order of the ids
    pairs = path + [(int(a), int(b)) for a, b in rng.integers(400, 700, (250, 2))] + [(800, 801), (801, 800), (802, 802)]
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprints.compared(docs).select("id", "n", "edited_sha256", "near_edited", "near_next").collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = {}
    for i, (k, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        plain.setdefault(k, set()).add(hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
    # rows that share an id follow each other by a hash, so they and the row before may differ
    assert all(r.edited_sha256 in plain[r.id] for r in got if r.id not in (6, 7))
    assert fingerprints.compared(empty).count() == 0
    lone = docs.filter("doc_id = 6")
    r = fingerprints.compared(lone).first()
    assert r.near_next == 1.0


def test_sketch_estimates(spark):
    a = F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.xxhash64(i))
    b = F.transform(F.sequence(F.lit(2001), F.lit(6000)), lambda i: F.xxhash64(i))
    s = spark.range(1).select(fingerprints.sketch(a, 512).alias("a"), fingerprints.sketch(b, 512).alias("b"), fingerprints.sketch(F.concat(a, b), 512).alias("u"))
    r = s.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("r"), fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"),
        fingerprints.distinct_count(F.col("a"), 512).alias("n"), (fingerprints.merge(F.col("a"), F.col("b"), 512) == F.col("u")).alias("m"),
    ).first()
    assert abs(r.r - 1 / 3) < 0.08 and abs(r.c - 0.5) < 0.12 and abs(r.n - 4000) < 600 and r.m


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "w5 w6 w7"), (1, PASSAGE)], "item_id long, text string")
    got = sorted((r.id, r.item_id) for r in decontamination.contained(docs, items).collect())
    assert got == [(1, 1), (4, 1), (5, 1), (6, 3), (7, 3)]
    assert decontamination.clean(docs, items).count() == len(ROWS) - 5
    assert decontamination.contained(empty, items).count() == 0 and decontamination.clean(docs, items.filter("false")).count() == len(ROWS)


def plain_fingerprint(text):
    words = text.lower().split()
    def chained(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return h - (1 << 64) if h >> 63 else h
    if len(words) >= 5:
        hashes = {chained(words[i : i + 5]) for i in range(len(words) - 4)}
    else:
        hashes = {chained([" ".join(words)])} if words else set()
    return sorted(hashes)[: fingerprints.K]


def plain_likeness(a, b):
    union = sorted({*a, *b})[: fingerprints.K]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def test_fingerprints_against_plain_python(spark):
    """The whole query at sf0.001: counts, digests, sketches and likenesses."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op2_fingerprints"](spark, d).collect()}
    assert len(got) == len(rows)
    hexed = lambda f: "".join(f"{h % (1 << 64):016X}" for h in f)
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        f, fe, fn = (plain_fingerprint(x) for x in (t, edited, nxt))
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(f), hexed(fe))
        assert abs(r.near_edited - plain_likeness(f, fe)) < 1e-9 and abs(r.near_next - plain_likeness(f, fn)) < 1e-9


def test_items_in_many_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "w5 w6 w7"), (4, "nowhere at all")], "item_id long, text string")
    assert sorted((r.id, r.item_id) for r in decontamination.contained(docs, items).collect()) == [(1, 1), (4, 1), (5, 1), (6, 3), (7, 3)]
    assert decontamination.clean(docs, items).count() == len(ROWS) - 5


def test_names_that_clash_keep_their_values(spark):
    """Each operator that returns the input's columns leaves values of columns named as its own."""
    import corpus_pipeline as cp
    import public_tokenizers as p

    names = ["_uid", "_r", "_id", "_lines", "_gone", "_parts", "_stay", "_score", "_kept", "_n_lines", "_n_dropped", "score", "key", "rep"]
    base = spark.createDataFrame([(i if i < 8 else 7, f"line one {i}\nshared", "xx", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    docs = base.withColumns({n: F.concat(F.lit(n), "text") for n in names}).withColumn("n_chars", F.length("text").cast("long"))
    d = "/root/testdata/sf0.001"
    kept = lambda df: {(r.doc_id, tuple(r[n] for n in names)) for r in df.collect()}
    every = kept(docs)
    for stage in (cp.keep_quality, cp.drop_lines, cp.drop_near_copies, cp.drop_contaminated):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and kept(out) <= every
    assert kept(cp.drop_lines(spark, docs, d)) == every and kept(cp.drop_near_copies(spark, docs, d)) == every
    assert {r.text for r in cp.drop_lines(spark, docs, d).collect()} == {f"line one {i}" for i in range(12)}
    for op in (lambda: byte_bpe.encoded(docs.withColumn("_IDS", F.lit(1)), p.path("byte_bpe_50k.tiktoken"), p.PATTERN), lambda: html_extraction.extracted(docs.withColumn("_text", F.lit(1)), "text"), lambda: line_dedup.dropped_lines(docs)):
        with pytest.raises(ValueError):
            op()


def test_texts_beyond_a_chunk(spark):
    """A text of over 1 MiB between short ones, through every operator on texts."""
    import public_tokenizers as p

    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4000)]
    long = " ".join(words[i] for i in rng.integers(0, 4000, 200_000)) + "\ntail"
    near = long.replace(words[0], "changed").replace(words[1], "changed")
    texts = ["short one here now", long, None, near, long, "another short one"]
    assert len(long) > kernels.CHUNK_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    out = {r.doc_id: r for r in line_dedup.dropped_lines(df, min_docs=3).select("doc_id", "_n_dropped", F.sha2("_kept", 256).alias("s")).collect()}
    assert [out[i]._n_dropped for i in range(6)] == [0, 1, 0, 1, 1, 0] and out[1].s == sha(long.removesuffix("\ntail"))
    assert {r.uid: r.class_uid for r in near_dedup.classes(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    cut = {r.uid: r for r in suffix_dedup.deduplicated(df.select(F.col("doc_id").alias("uid"), F.col("text").alias("t")), False).collect()}
    assert cut[4].n_removed == len(long) and cut[1].n_removed == removed(["", long])[1][1]
    items = spark.createDataFrame([(1, " ".join(long.split()[100_000:100_020]))], "item_id long, text string")
    assert {r.id for r in decontamination.contained(df, items).collect()} >= {1, 4}
    enc = {r.doc_id: r for r in byte_bpe.encoded(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, keep_ids=False).drop("text").collect()}
    assert all(enc[i]._decoded_sha256 == sha(t) for i, t in enumerate(texts))
    fp = {r.id: r for r in fingerprints.compared(df).select("id", "n", "f").collect()}
    assert fp[1].n == len(long) and fp[1].f == fp[4].f == plain_fingerprint(long)
    sh = {r.id: r for r in sharding.shards(df, bins=2).collect()}
    assert sh[1].size == len(long) + 16 and sh[1].shard == sh[4].shard
    scorer = quality.fit(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in pu_learning.with_score(df, "text", scorer).drop("text").collect()}
    assert scores[1] == scores[4] and all(0 <= s <= 1 for s in scores.values())
    page = "<nav><a href=/>Home</a></nav><article>" + f"<p>{long}</p></article>"
    pages = spark.createDataFrame([(1, page), (1, page), (2, "")], "page_id long, html string")
    text = [r._text for r in html_extraction.extracted(pages).collect()]
    assert text[0] == text[1] == " ".join(long.split()) and text[2] == ""
    assert html_extraction.extracted(pages.filter("false")).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<div><h1>A plain title</h1><p>The first paragraph of the text, which runs on for a while.</p><p>Then a second one follows, with more to say.</p></div>",
     "A plain title The first paragraph of the text, which runs on for a while. Then a second one follows, with more to say."),
    ("<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>On tables</h1><p>Old pages put their text into cells, like this one here.</p><p>More of it follows, as it did then.</p></td></tr></table>",
     "On tables Old pages put their text into cells, like this one here. More of it follows, as it did then."),
    ("<body><div><a href=/>Home</a> <a href=/b>About</a></div><div><div><p>The story starts here, with a long sentence that says a lot.</p><p>It goes on for another sentence, and then it ends.</p></div></div><div>&copy; 2020 Me, all rights reserved</div></body>",
     "The story starts here, with a long sentence that says a lot. It goes on for another sentence, and then it ends."),
])
def test_layouts_that_the_page_maker_does_not_draw(page, want):
    assert html_extraction.default_model().extract(page) == want


def test_groups_are_packed_as_if_one_by_one(spark, monkeypatch):
    """Bin sizes equal those of packing every group by itself; few large sizes, many equal small ones."""
    rng = np.random.default_rng(3)
    texts = [f"{i:03d}" + "x" * int(rng.choice([5, 5, 5, 40, 41, 300])) for i in range(400)]
    texts += [texts[int(i)] for i in rng.integers(0, 400, 80)] + ["y" * 50] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len(t) + 16
    counted = sorted(((s, list(sizes.values()).count(s)) for s in set(sizes.values())), reverse=True)
    for most in (200_000, 1):  # the bins of each size by broadcast, and by a shuffle
        monkeypatch.setattr(sharding, "MAX_SIZES", most)
        r = sharding.shards(df, bins=7).toPandas()
        assert len(r) == len(texts) and all(sorted(g) == list(range(len(g))) for _, g in r.groupby("shard")["slot"])
        shard_of = dict(zip(r["id"], r["shard"]))
        assert len({(t, shard_of[i]) for i, t in enumerate(texts)}) == len(sizes)
        low = max(max(sizes.values()), -(-sum(sizes.values()) // 7))
        plain = next(p for c in range(low, 2 * low) if (p := sharding.best_fit_decreasing(list(sizes.values()), c, 7)) is not None)
        want = sorted(sum(s for s, b in zip(sizes.values(), plain) if b == k) for k in range(7))
        assert sorted(r.groupby("shard")["size"].sum()) == want or max(r.groupby("shard")["size"].sum()) <= 1.01 * max(want)
        dealt = sharding.pack_into(counted, 7)
        full = [sum(s * k for (s, _), d in zip(counted, dealt) for b, k in d if b == shard) for shard in range(7)]
        assert r.groupby("shard")["size"].sum().to_dict() == {i: x for i, x in enumerate(full) if x}


def test_shards_of_near_equal_size(spark):
    d = "/root/testdata/sf0.01"
    s = queries.QUERIES["op6_sharding"](spark, d).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(s) == sharding.SHARDS and s.max() <= 1.001 * s.mean()


def test_sharding(docs, empty):
    r = sharding.shards(docs, bins=3).toPandas()
    assert len(r) == len(ROWS) and set(r["shard"]) <= {0, 1, 2}
    assert all(sorted(g) == list(range(len(g))) for _, g in r.groupby("shard")["slot"])
    assert r[r["id"].isin([1, 5])]["shard"].nunique() == 1 and r[r["id"].isin([2, 3])]["shard"].nunique() == 1
    assert sharding.shards(empty, bins=3).count() == 0


def test_html_and_bpe_frames(spark, docs, empty):
    import public_tokenizers as p

    out = byte_bpe.encoded(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()
    assert all(r._decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r._n_tokens * 4 == len(r._ids) for r in out)
    pages = spark.createDataFrame([(1, None), (2, "<p>one, two and three.</p><p>four five six.</p>"), (2, "")], "page_id long, html string")
    assert html_extraction.extracted(pages).count() == 3
    assert byte_bpe.encoded(empty, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == 0


@pytest.mark.parametrize("page", [
    "<head><title>x</title><body><article><p>text", "<head><title>x</title><article><p>text", "<head><script>'</head><p>'</script></head><p>text",
    "<noscript><p>text", "<template><p>text", "<svg><p>text", "<p>text<script>hidden", "<head><meta a><!-- <p>no --><style>p</style><p>text</p>",
])
def test_hidden_elements_left_open(page):
    assert [b[0] for b in html_extraction.blocks(page)] == ["text"]


def test_risk_is_non_negative_and_learns():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (400, 5)), rng.normal(-1.5, 1, (800, 5))
    model = pu_learning.fit_nnpu(pos[:200].astype(np.float32), np.vstack([pos[200:], neg[:600]]).astype(np.float32), 0.25)
    assert model.score(pos).mean() > 0.8 and model.score(neg).mean() < 0.2
    none = pu_learning.fit_nnpu(np.zeros((0, 3), np.float32), np.zeros((5, 3), np.float32), 0.3)
    assert np.allclose(none.score(np.zeros((2, 3))), 0.3)


def test_classifiers_on_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for op, target in ((quality, "quality"), (toxicity, "toxic")):
        for lab in (labels, labels.filter("false")):
            scorer = op.fit(docs, lab, target)
            got = pu_learning.with_score(docs, "text", scorer, "score").collect()
            assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert pu_learning.with_score(empty, "text", op.fit(empty, labels.filter("false"), target)).count() == 0


@pytest.mark.parametrize("name,target,least", [("op1_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, target, least):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[target] for r in rows]) >= least


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{d}/documents.parquet")
    names, n = frame.columns, frame.count()
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, d).persist()
        assert frame.count() <= n
        n = frame.count()
        assert name == "byte_bpe" or frame.columns == names
    assert n > 100 and cp.run(spark, d).count() == n


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def plain_near(a, b):
    longest = max(len(a), len(b))
    most = int(0.2 * longest + 1e-9)
    if longest - (Counter(a) & Counter(b)).total() > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1] <= most


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() over the small table with planted copies, passages and lines: the same rows as one text at a time."""
    import base64

    import corpus_pipeline as cp
    import pyarrow as pa
    import pyarrow.parquet as pq
    import public_tokenizers as p
    import tiktoken

    d = "/root/testdata/sf0.001"
    table = pq.read_table(f"{d}/documents.parquet")
    rows, items = table.to_pylist(), [r["text"] for r in pq.read_table(f"{d}/benchmark.parquet").to_pylist()]
    top = max(r["doc_id"] for r in rows)
    long = [r for r in rows if len(r["text"] or "") > 300][:40]
    planted = []
    for i, r in enumerate(long[:10]):  # exact copies, near copies, passages, a line that twelve share
        words = r["text"].split(" ")
        planted.append(r["text"])
        planted.append(" ".join(w if k % 12 != 5 else f"new{i}x{k}" for k, w in enumerate(words)))
        planted.append(long[20 + i]["text"] + " " + items[i])
    planted += [f"  One Line for All \n{r['text']}" for r in long[10:16]] + [f"{r['text']}\none line for all" for r in long[14:20]] + [None, ""]
    rows += [{**rows[0], "doc_id": top + 1 + i, "text": t, "n_chars": len(t or "")} for i, t in enumerate(planted)]
    pq.write_table(pa.Table.from_pylist(rows, table.schema), str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        pq.write_table(pq.read_table(f"{d}/{name}.parquet"), str(tmp_path / f"{name}.parquet"))

    # 1: the fitted model on one text at a time
    scorer = quality.fit(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels"))
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    good = [r["doc_id"] for r in rows if scorer(np.frombuffer(raw[r["doc_id"]], np.uint8), np.array([0, len(raw[r["doc_id"]])]))[0] >= quality.THRESHOLD]
    texts = {k: raw[k].decode() for k in sorted(good)}
    # 2: lines in at least ten documents
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    count = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    cut = {i: "\n".join(x for x in t.split("\n") if not (key(x) and count[key(x)] >= 10)) for i, t in texts.items()}
    # 3: every pair
    words = {i: plain_words(t) for i, t in cut.items()}
    root = {i: i for i in words}
    for i in words:
        for j in words:
            if i < j and root[i] != root[j] and plain_near(words[i], words[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    first = [i for i in root if root[i] == i]
    # 4: the five-word shingles of an item
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    clean = []
    for i in first:
        wanted = [(n, grams(w, n)) for w in map(plain_words, items) if (n := min(5, len(w)))]
        if not any(len(g & grams(words[i], n)) >= 0.8 * len(g) for n, g in wanted):
            clean.append(i)
    # 5: the tokenizer library
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: np.array(lib.encode_ordinary(cut[i]), "<u4").tobytes() for i in clean}
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert len(good) < len(rows) and cut != texts and len(clean) < len(first) < len(good)  # every stage had work
    assert set(got) == set(want)
    assert all(r.ids == want[i] and r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(cut[i].encode()).hexdigest() for i, r in got.items())
