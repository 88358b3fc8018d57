import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textgraph.llm import byte_bpe, decontamination, html_extraction, kernels, near_dedup, sharding, suffix_dedup

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab éZ,\n", max_size=40)), min_size=1, max_size=6)


def plain_words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return "".join(c if c.isalnum() or not c.isascii() else " " for c in low).split(" ")


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_and_shingles(texts):
    data, offsets = kernels.column_bytes(pa.array(texts, pa.string()))
    h, _, _, b = kernels.words(data, offsets)
    want = [[w for w in plain_words(t) if w] for t in texts]
    assert np.diff(b).tolist() == [len(w) for w in want]
    names = {}
    for x, w in zip(h.tolist(), [w for ws in want for w in ws], strict=True):
        assert names.setdefault(x, w) == w
    assert len(set(names.values())) == len(names)
    s, _, sb = kernels.shingles(h, b, 3)
    assert np.diff(sb).tolist() == [max(len(w) - 2, min(len(w), 1)) for w in want]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, most):
    d = distance(a, b)
    assert near_dedup.banded_distance(a, b, most) == (d if d <= most else None)


@given(st.text(alphabet="ab", min_size=100, max_size=400), st.integers(0, 300))
@settings(max_examples=30, deadline=None)
def test_refined_buckets_order_strings(t, copy):
    raw = (t + t[copy:] + "x" * 30).encode()
    places = np.arange(len(raw) - 99)
    b = suffix_dedup.equal_strings(np.frombuffer(raw, np.uint8), places)
    s = [raw[p : p + 100] for p in places]
    rank = {x: i for i, x in enumerate(sorted(set(s)))}
    order = np.argsort(b, kind="stable")
    assert len(set(b.tolist())) == len(rank) and all(rank[s[i]] <= rank[s[j]] for i, j in zip(order, order[1:], strict=False))


@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 60))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing(sizes, capacity):
    got = sharding.best_fit_decreasing(sizes, capacity)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if not fits:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        r, b = min(fits)
        want[i], room[b] = b, r - sizes[i]
    assert got == want
    assert sharding.best_fit_decreasing([61], 60) is None and sharding.pack_into([], 4) == []


def test_bpe_equals_library():
    import base64

    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = byte_bpe.Vocabulary.load(path, p.PATTERN)
    texts = ["", " ", "the theatre's  end\n\n x", "日本語🎉", "aaaa" * 500, "ciónosta émènt"] * 2
    ids = v.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [lib.encode_ordinary(t) for t in texts]
    assert [v.decode(i).decode() for i in ids] == texts


def test_html_on_unseen_layouts():
    crf = html_extraction.default_model()
    maker = html_extraction.PageMaker(5)
    pages = [maker.page() for _ in range(150)]
    right = sum(crf.extract(p) == " ".join(x for x in m if x) for p, m in pages)
    assert right >= 140
    assert crf.extract(None) == crf.extract("") == ""
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A  title &amp; more</h1><p>First one,<br>two.<p>Second</p></article><footer>&copy; me</footer>"
    assert crf.extract(page) == "A title & more First one, two. Second"


def test_items_in_a_long_document():
    words = [f"w{i}" for i in range(4000)]
    item = " ".join(words[1000:1030])
    index = decontamination.Index([7, 8], [item, "absent one two three four five six"])
    data, offsets = kernels.column_bytes(pa.array([" ".join(words), None, item.upper(), " ".join(words[1000:1015])]))
    assert [(r, index.ids[i], c) for r, i, c in index.search(data, offsets)] == [(0, 7, 26), (2, 7, 26)]
