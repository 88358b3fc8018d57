"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks, the runs of text between block-level tags.  Each block
has the tags and the class, id and role words of its ancestors, its own tag, and features
of its text (length, punctuation, share of links, place in the page).  The chain has two
labels, main text or not, and transitions that depend on whether two neighbours share
their nearest sectioning ancestor.  It is trained in numpy by maximum likelihood on
labelled pages (a generator of varied layouts, TRAINING_PAGES of them, is the labelled
set here; training takes any) and decoded by Viterbi.

Character references are decoded once, white space inside a block becomes one space, and
blocks of main text are joined by one space.  Scripts, styles, templates, comments and the
head never hold text; a head ends at the first tag that cannot stand in it, and of other hidden
elements that are never closed (scripts and styles apart) only the tag is skipped.  Null or empty pages give an empty text, broken markup is read as
browsers mostly do (unclosed paragraphs, stray end tags), repeated pages give equal rows,
very long pages are read whole in one pass, an empty table gives no rows, and other columns
pass through whatever their names (``out`` names the added one).
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAINING_PAGES = 500

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = {"script", "style", "template", "noscript", "head", "svg", "iframe", "object", "canvas", "math", "audio", "video"}
_RAW = {"script", "style"}
_IN_HEAD = set("base basefont bgsound head link meta noscript script style template title".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SECTIONS = set("article main section aside nav header footer div body form ul ol table".split())
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead"}, "option": {"select"}}
_WORDS = set("cookie cookies subscribe newsletter login sign advertisement sponsored share copyright rights reserved privacy terms comments comment reply related menu search home".split())


@lru_cache(maxsize=None)
def _closed(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


def _after(page: str, tag: str, at: int) -> int:
    """Where a hidden element ends; of one that is never closed, only the tag is skipped (scripts and styles run to the end)."""
    close = _closed(tag).search(page, at)
    return close.end() if close else len(page) if tag in _RAW else at


def _after_head(page: str, at: int) -> int:
    """Where a head ends: after its end tag, or before the first tag that cannot stand in it."""
    while m := _TOKEN.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if m[1]:
            if tag == "head":
                return at
        elif tag and tag not in _IN_HEAD:
            return m.start()
        elif tag in _HIDDEN - {"head"} or tag == "title":
            at = _after(page, tag, at)
    return len(page)


def _names(attrs: str) -> list[str]:
    out = []
    for m in _ATTR.finditer(attrs):
        out += ["c:" + w.lower() for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return out


def blocks(page: str, known: dict | None = None) -> list[tuple[str, list[str], int, int]]:
    """(text, features, section number, characters in links) of each leaf block with text.

    With ``known``, names of ancestors that no weight stands for are left out, so that deep
    or odd markup costs no more than its tags.
    """
    out: list[tuple[str, list[str], int, int]] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # tag, features, section before it
    counts: dict[str, int] = {}
    opened: dict[str, int] = {}
    parts: list[str] = []
    section = sections = links = 0
    leaf = "body"

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, [*counts, "l:" + leaf], section, links))
            parts.clear()
        links = 0

    def pop() -> str:
        nonlocal section
        tag, feats, section = stack.pop()
        opened[tag] -= 1
        for f in feats:
            counts[f] -= 1
            if not counts[f]:
                del counts[f]
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if opened.get("a"):
                links += m.start() - at
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:  # an end tag
            if not opened.get(tag):
                if tag == "p":
                    flush()
                continue
            if tag not in _INLINE:
                flush()
            elif stack[-1][0] != tag and any(t not in _INLINE for t, _, _ in stack[-8:]):
                # a formatting tag left open across blocks: only its own entry goes
                for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                    if stack[i][0] == tag:
                        opened[tag] -= 1
                        stack[i] = ("", stack[i][1], stack[i][2])
                        opened[""] = opened.get("", 0) + 1
                        break
                continue
            while stack and pop() != tag:
                pass
        elif tag in _HIDDEN:
            if not m[3].endswith("/"):
                at = _after_head(page, at) if tag == "head" else _after(page, tag, at)
        elif tag in _VOID:
            if tag == "br" or tag == "hr":
                parts.append(" ")
                if tag == "hr":
                    flush()
        else:
            if tag not in _INLINE:
                flush()
                if tag in _CLOSES_P and opened.get("p"):
                    while stack and stack[-1][0] not in _SECTIONS and pop() != "p":
                        pass
                if tag in _SAME and opened.get(tag):
                    while stack and stack[-1][0] not in _SAME[tag] and pop() != tag:
                        pass
            feats = [] if tag in _INLINE else ["t:" + tag, *_names(m[3])]
            if known is not None:
                feats = [f for f in feats if f in known]
            stack.append((tag, tuple(feats), section))
            opened[tag] = opened.get(tag, 0) + 1
            for f in feats:
                counts[f] = counts.get(f, 0) + 1
            if tag in _SECTIONS:
                sections += 1
                section = sections
        leaf = next((t for t, _, _ in stack[-1:-6:-1] if t and t not in _INLINE), "body")
    flush()
    return out


def _bucket(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def text_features(text: str, links: int, i: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    marks = sum(text.count(c) for c in ".!?…")
    out = [
        f"w{_bucket(words, (2, 4, 8, 15, 30, 60))}", f"m{_bucket(marks, (1, 2, 4, 8))}", f",{_bucket(text.count(','), (1, 3, 6))}",
        f"k{_bucket(links / max(len(text), 1), (0.01, 0.3, 0.7))}", f"e{text[-1] in '.!?…:»”'}", f"p{_bucket(i / max(n, 1), (0.05, 0.2, 0.5, 0.8, 0.95))}",
    ]
    if "©" in text:
        out.append("copy")
    if words < 30:
        out += ["x:" + w for w in _WORDS.intersection(text.lower().split())]
    return out


class Crf:
    """Two labels; features weigh label 1 against 0; trans[same section][from][to]."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, bias: float):
        self.weights, self.trans, self.bias = weights, trans.tolist(), bias

    def labels(self, page_blocks: list[tuple[str, list[str], int, int]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        get, n = self.weights.get, len(page_blocks)
        zero, one, back = 0.0, 0.0, []
        last = None
        for i, (text, feats, section, links) in enumerate(page_blocks):
            e = self.bias + sum(get(f, 0.0) for f in feats) + sum(get(f, 0.0) for f in text_features(text, links, i, n))
            if last is None:
                zero, one = 0.0, e
            else:
                (a, b), (c, d) = self.trans[section == last]
                back.append((zero + a < one + c, zero + b < one + d))
                zero, one = max(zero + a, one + c), max(zero + b, one + d) + e
            last = section
        out = [int(one > zero)] if n else []
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        found = blocks(page, self.weights)
        return " ".join(b[0] for b, y in zip(found, self.labels(found), strict=True) if y)


def train(pages: list[tuple[list[tuple[str, list[str], int, int]], list[int]]], *, epochs: int = 120, rate: float = 0.1, l2: float = 0.05, least: int = 3) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam over forward-backward expectations; deterministic."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    feats = []
    for page, _ in pages:
        rows = [list(dict.fromkeys([*f, *text_features(t, k, i, len(page))])) for i, (t, f, _, k) in enumerate(page)]
        feats.append(rows)
        for row in rows:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, c in seen.items() if c >= least)
    place = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(p) for p, _ in pages)
    size = np.array([len(p) for p, _ in pages])
    row, col = [], []
    same = np.zeros((n, longest), np.int64)
    y = np.zeros((n, longest), np.int64)
    for i, ((page, lab), rows) in enumerate(zip(pages, feats, strict=True)):
        y[i, : len(lab)] = lab
        for t, fs in enumerate(rows):
            same[i, t] = t > 0 and page[t][2] == page[t - 1][2]
            for f in fs:
                if f in place:
                    row.append(i * longest + t)
                    col.append(place[f])
    row, col = np.array(row), np.array(col)
    live = np.arange(longest)[None, :] < size[:, None]
    target = np.bincount(col, (y.ravel()[row]).astype(float), len(names))
    w, tr, bias = np.zeros(len(names)), np.zeros((2, 2, 2)), 0.0
    m, v = np.zeros(len(names) + 9), np.zeros(len(names) + 9)
    truth = np.zeros((2, 2, 2))
    for t in range(1, longest):
        at = live[:, t]
        np.add.at(truth, (same[at, t], y[at, t - 1], y[at, t]), 1)
    for step in range(1, epochs + 1):
        e = (np.bincount(row, w[col], n * longest).reshape(n, longest) + bias) * live
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0, 1] = e[:, 0]
        for t in range(1, longest):
            s = np.logaddexp.reduce(alpha[:, t - 1, :, None] + tr[same[:, t]], axis=1)
            s[:, 1] += e[:, t]
            alpha[:, t] = np.where(live[:, t, None], s, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1].copy()
            ahead[:, 1] += e[:, t + 1]
            s = np.logaddexp.reduce(tr[same[:, t + 1]] + ahead[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], s, beta[:, t + 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * live
        expect = np.bincount(col, p1.ravel()[row], len(names))
        pairs = np.zeros((2, 2, 2))
        for t in range(1, longest):
            b = beta[:, t].copy()
            b[:, 1] += e[:, t]
            q = np.exp(alpha[:, t - 1, :, None] + tr[same[:, t]] + b[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            np.add.at(pairs, same[:, t], q)
        g = np.concatenate([target - expect - l2 * w, (truth - pairs).ravel() - l2 * tr.ravel(), [y.sum() - p1.sum()]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, tr, bias = w + d[: len(names)], tr + d[len(names) : -1].reshape(2, 2, 2), bias + d[-1]
    return Crf(dict(zip(names, w.tolist(), strict=True)), tr, float(bias))


class PageMaker:
    """Labelled pages of varied layouts: (html, texts of the main blocks in page order)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(s) for s in ("bdfglmnprstvz", "aeiou", ("", "n", "r", "s"))) for _ in range(90)]

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.syllables) for _ in range(r.choice((1, 1, 2, 2, 3)))) + ("," if r.random() < 0.06 else "") for _ in range(n))

    def sentence(self) -> str:
        return self.words(self.r.randint(1, 18)).rstrip(",").capitalize() + self.r.choice("....!?")

    def prose(self) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 4, 6))))
        return s.replace(" ", " &amp; ", 1) if self.r.random() < 0.1 else s

    def named(self, tag: str, names: list[str], body: str) -> str:
        pick = self.r.choice(names)
        attr = self.r.choice(("class", "class", "id")) if pick else ""
        return f'<{tag} {attr}="{pick}">{body}</{tag}>' if pick else f"<{tag}>{body}</{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        items = "".join(f'<{tag}><a href="/{i}">{self.words(self.r.randint(1, 3)).rstrip(",").capitalize()}</a></{tag}>' for i in range(n))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def junk(self) -> str:
        r = self.r
        kind = r.randrange(10)
        short = lambda: r.choice((self.sentence(), self.words(r.randint(1, 6)), f"<p>{self.prose()}</p>"))
        if kind == 0:
            return self.named(r.choice(("nav", "nav", "div", "ul")), ["", "menu", "navbar", "site-nav", "breadcrumbs"] if r.random() < 0.5 else ["menu", "main-menu"], self.links(r.randint(2, 9)))
        if kind == 1:
            return self.named("header", ["", "site-header", "masthead"], f"<h1>{self.words(2)}</h1>" * r.randrange(2) + self.links(r.randint(0, 4)) + short())
        if kind == 2:
            return self.named(r.choice(("footer", "footer", "div")), ["footer", "site-footer", "copyright"], r.choice(("&copy; ", "© 2020 ", "")) + short())
        if kind == 3:
            return self.named(r.choice(("aside", "aside", "div")), ["sidebar", "side-bar", "widget", "related", "related-posts"], f"<h3>{self.words(2)}</h3>" + r.choice((self.links(r.randint(2, 6)), f"<p>{self.prose()}</p>")))
        if kind == 4:
            return self.named("div", ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"], short())
        if kind == 5:
            return self.named(r.choice(("div", "section")), ["cookie-notice", "notice", "cookie-banner", "consent", "banner", "alert", "gdpr"], short() + r.choice(("", "<button>Ok</button>")))
        if kind == 6:
            return self.named(r.choice(("form", "form", "div")), ["", "subscribe", "newsletter", "login-form", "search-form"] if r.random() < 0.5 else ["newsletter", "subscribe", "search"], f"<label>{self.words(2)}</label><input name=q><select><option>{self.words(1)}<option>{self.words(1)}</select><button>{self.words(1)}</button>" + r.choice(("", f"<p>{self.sentence()}</p>")))
        if kind == 7:
            one = lambda: self.named("div", ["comment", "comment-body", "reply"], f"<b>{self.words(1)}</b> <p>{self.prose()}</p>")
            return self.named(r.choice(("section", "div", "ol")), ["comments", "comment-list", "discussion", "respond"], f"<h3>{self.words(1)}</h3>" * r.randrange(2) + "".join(one() for _ in range(r.randint(1, 5))))
        if kind == 8:
            return self.named("div", ["share", "social", "tags", "pagination", "breadcrumb"], self.links(r.randint(2, 5), "span"))
        return f'<script>var s="<p>{self.words(3)}</p>";</script><style>p{{margin:0}}</style>'

    def page(self) -> tuple[str, list[str]]:
        r, main, body = self.r, [], ""

        def say(tag: str, text: str) -> str:
            main.append(" ".join(_html.unescape(text).split()))
            style = r.random()
            if style < 0.1 and " " in text:
                a, b = text.split(" ", 1)
                text = f"<b>{a}</b> {b}"
            elif style < 0.2 and tag == "p":
                return f"<p>{text}<br>"
            elif style < 0.3 and tag == "p":
                return f"<p><b>{text}<br>"
            return f"<{tag}>{text}</{tag}>"

        if r.random() < 0.8:
            body += say("h1", self.words(r.randint(2, 12)).rstrip(","))
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.8:
                body += say("p", self.prose())
            elif kind < 0.86:
                body += say(r.choice(("h2", "h3")), self.words(r.randint(1, 6)).rstrip(","))
            elif kind < 0.92:
                body += "<ul>" + "".join(say("li", self.sentence()) for _ in range(r.randint(1, 4))) + "</ul>"
            elif kind < 0.95:
                body += "<blockquote>" + say("p", self.prose()) + "</blockquote>"
            else:
                body += self.junk() if r.random() < 0.5 else self.named("div", ["ad", "related", "share"], self.sentence())
        if r.random() < 0.6:
            core = self.named("article", ["", "", "", "post", "hentry"], body)
        else:
            core = self.named(r.choice(("div", "main", "section")), ["content", "post-content", "entry-content", "article-body", "story", "main-content", "text"], body)
        if r.random() < 0.3:
            core = self.named(r.choice(("main", "div")), ["", "main", "container", "wrapper", "page"], core + (self.junk() if r.random() < 0.4 else ""))
        top = "".join(self.junk() for _ in range(r.randint(0, 4)))
        foot = "".join(self.junk() for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(4)}</title></head><body>{top}<!-- {self.words(1)} -->{core}{foot}</body></html>", main


def labelled_page(page: str, main: list[str]) -> tuple[list[tuple[str, list[str], int, int]], list[int]]:
    """The blocks of a page and their labels: 1 for those that are the next of the main texts."""
    found, lab, at = blocks(page), [], 0
    for b in found:
        hit = at < len(main) and b[0] == main[at]
        lab.append(int(hit))
        at += hit
    return found, lab


@lru_cache(maxsize=2)
def default_model(n: int = TRAINING_PAGES, seed: int = 11) -> Crf:
    maker = PageMaker(seed)
    return train([labelled_page(*maker.page()) for _ in range(n)])


def extracted(pages: DataFrame, html_col: str = "html", model: Crf | None = None, out: str = "_text") -> DataFrame:
    """pages with the main text of each page as a further column, which must not be there yet."""
    if common.unused(pages.columns, out) != [out]:
        raise ValueError(f"pages has a column named {out}")
    crf = model or default_model()
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = pa.array([crf.extract(x) for x in batch.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, out])

    return pages.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
