"""Answer metrics as Column expressions over token arrays."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EVAL_TOKEN = r"\p{L}{2,}"


def eval_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(EVAL_TOKEN), 0)


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays: built-in functions would copy a row of the table at every cell."""
    return F.arrow_udf(lambda x, y: pa.array([_lcs(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32()), "int")(a, b)


def rouge_overlaps(hyp: Column, ref: Column, sizes: list[int]) -> Column:
    """For arrays of token arrays: by size, the clipped overlap of n-grams over the reference's; null without any there."""

    def grams(lists: list, n: int) -> Counter:
        found: Counter = Counter()
        for t in lists or []:
            found.update(zip(*(t[i:] for i in range(n)), strict=False) if n > 1 else t)
        return found

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for h, r in zip(x.to_pylist(), y.to_pylist(), strict=True):
            row = []
            for n in sizes:
                a, b = grams(h, n), grams(r, n)
                row.append(sum(min(k, a[g]) for g, k in b.items() if g in a) / total if (total := b.total()) else None)
            out.append(row)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(hyp, ref)


def char_cosine(a: Column, b: Column, low: int = 3, high: int = 5) -> Column:
    """For arrays of word arrays: the cosine of their char_wb grams by TF-IDF fitted on the two alone; 0 without any."""

    def of_word(w: str) -> list[str]:
        p = f" {w} "
        return [p[i : i + n] for n in range(low, high + 1) if len(p) >= n or n == low for i in range(max(len(p) - n + 1, 1))]

    def counted(lists: list, known: dict) -> Counter:
        found: Counter = Counter()
        for w, k in Counter(w for ws in lists or [] for w in ws).items():
            if w not in known:
                if len(known) > 50_000:
                    known.clear()
                known[w] = of_word(w)
            for g in known[w]:
                found[g] += k
        return found

    lone = (math.log(1.5) + 1) ** 2  # the square of the idf of a gram that one text has; of two, 1

    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for s, t in zip(p.to_pylist(), q.to_pylist(), strict=True):
            x, y = counted(s, known), counted(t, known)
            both = x.keys() & y.keys()
            xy, sx, sy = sum(x[g] * y[g] for g in both), sum(x[g] ** 2 for g in both), sum(y[g] ** 2 for g in both)
            xx = sx + lone * (sum(k * k for k in x.values()) - sx)
            yy = sy + lone * (sum(k * k for k in y.values()) - sy)
            out.append(xy / math.sqrt(xx * yy) if xx and yy else 0.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def words(c: Column) -> Column:
    """What char_wb splits a text into."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def f1(common: Column, n_hyp: Column, n_ref: Column) -> Column:
    p, r = common / n_hyp, common / n_ref
    return F.when((n_hyp == 0) | (n_ref == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def ttr(toks: Column) -> Column:
    return F.when(F.size(toks) == 0, 0.0).otherwise(F.size(F.array_distinct(toks)) / F.size(toks))


def coverage(query: Column, answer: Column) -> Column:
    """Share of the query's distinct words of three letters or more that the answer has."""
    q = F.array_distinct(F.filter(query, lambda w: F.length(w) >= 3))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, answer)) / F.size(q))


def length_v1(n: Column, target: float = 300.0) -> Column:
    return F.when(n == 0, 0.0).when(n <= target, n / target).otherwise(target / n)


def length_v2(n: Column, target: float = 220.0, floor: float = 0.4) -> Column:
    return F.when(n == 0, 0.0).when(n <= target, n / target).otherwise(F.greatest(F.lit(floor), target / n))


def keypoint_hit(point: Column, answer_lower: Column) -> Column:
    """A key point is hit if the 6-letter stem of any of its words of four letters or more is in the answer."""
    words = F.filter(eval_tokens(point), lambda w: F.length(w) >= 4)
    stems = F.when(F.size(words) > 0, F.transform(words, lambda w: F.substring(w, 1, 6))).otherwise(F.array(F.substring(F.lower(point), 1, 6)))
    return F.exists(stems, lambda s: F.contains(answer_lower, s))


def keypoint_coverage(points: Column, answer: Column) -> Column:
    """Share of the points that keypoint_hit() finds in an answer; each text is put in lower case once, not once a point."""

    def run(lows: pa.Array, tokens: pa.Array, answers: pa.Array) -> pa.Array:
        out = []
        for ps, ts, a in zip(lows.to_pylist(), tokens.to_pylist(), answers.to_pylist(), strict=True):
            n = 0
            for p, t in zip(ps or [], ts or [], strict=True):
                stems = [w[:6] for w in t if len(w) >= 4] or ([p[:6]] if p is not None else [])
                n += any(s in a for s in stems)
            out.append(n)
        return pa.array(out, pa.int32())

    n = F.arrow_udf(run, "int")(F.transform(points, lambda p: F.lower(p)), F.transform(points, eval_tokens), F.lower(F.coalesce(answer, F.lit(""))))
    return F.when(F.size(points) == 0, 0.0).otherwise(n / F.size(points))


def composite_v1(*metrics: Column) -> Column:
    return sum(metrics[1:], metrics[0]) / len(metrics)


#: Weights of rouge1, rouge2, rougeL, semantic, keypoints, faithfulness, length.
WEIGHTS_V2 = (0.10, 0.10, 0.15, 0.20, 0.25, 0.15, 0.05)


def composite_v2(*metrics: Column) -> Column:
    parts = [F.lit(w) * m for w, m in zip(WEIGHTS_V2, metrics, strict=True)]
    return sum(parts[1:], parts[0])


def char_wb(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by one space; a word shorter than n gives itself, once."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        n_p = F.length(p)
        def of_size(n: int) -> Column:
            full = F.transform(F.sequence(F.lit(1), F.greatest(n_p - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
            # sizes beyond the first that reaches the word's length add nothing
            return F.when((n_p <= n - 1) & F.lit(n > low), F.array().cast("array<string>")).otherwise(full)
        return F.concat(*[of_size(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, of_word))


def judge_json(c: Column) -> Column:
    """The last valid flat JSON object of a reply, without its thinking part and code fences."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(json)?", "")
    found = F.filter(F.regexp_extract_all(t, F.lit(r"\{[^{}]*\}"), 0), lambda x: F.json_object_keys(x).isNotNull())
    return F.get(found, F.size(found) - 1)


def judge_score(raw: Column) -> Column:
    """Marks of 1 to 5 on a scale of 0 to 1."""
    return (F.least(F.lit(5.0), F.greatest(F.lit(1.0), raw.cast("double"))) - 1) / 4
