"""Evaluation over frames of (method, q_id, answer, reference, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as mx


def _by_key(pairs: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """(key, _m, _a, _b): what the rows of a key have, and how many they are; a key names a pair, so mostly one."""
    return pairs.select(*key, a.alias("_a"), b.alias("_b")).groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.collect_list("_a").alias("_a"), F.collect_list("_b").alias("_b"))


def _known(key: list[str]) -> Column:
    """A key with a null is no pair's."""
    return F.forall(F.array(*[F.col(k).isNotNull() for k in key]), lambda x: x)


def _repeated(df: DataFrame, times: Column) -> DataFrame:
    return df.withColumn("_i", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("_i", "_m")


def _rouge(pairs: DataFrame, key: list[str], sizes: list[int], hyp: str, ref: str) -> DataFrame:
    """(key, _m, rouge<n>...), one row a key: n-grams are counted in the row, so no gram is shuffled."""
    g = _by_key(pairs, key, mx.eval_tokens(F.col(hyp)), mx.eval_tokens(F.col(ref))).withColumn("_s", mx.rouge_overlaps(F.col("_a"), F.col("_b"), sizes))
    return g.select(*key, "_m", *[F.when(_known(key), F.coalesce(F.get("_s", F.lit(i)), F.lit(0.0))).otherwise(0.0).alias(f"rouge{n}") for i, n in enumerate(sizes)])


def rouge_n(pairs: DataFrame, key: list[str], n: int, hyp: str = "answer", ref: str = "reference") -> DataFrame:
    """(key, rouge<n>): clipped overlap of n-grams over the reference's, from counts by gram; 0 for an empty reference."""
    return _repeated(_rouge(pairs, key, [n], hyp, ref), F.col("_m"))


def scored(pairs: DataFrame, key: list[str], hyp: str = "answer", ref: str = "reference") -> DataFrame:
    """ROUGE-1, -2 and -L, type-token ratio, coverage and both length scores of each pair; ``key`` names a pair."""
    t = pairs.withColumn("_h", mx.eval_tokens(F.col(hyp))).withColumn("_r", mx.eval_tokens(F.col(ref)))
    h, r = F.col("_h"), F.col("_r")
    t = t.withColumn("_l", mx.lcs_length(h, r))
    t = t.withColumns({
        "rouge_l": mx.f1(F.col("_l"), F.size(h), F.size(r)), "ttr": mx.ttr(h),
        "coverage": mx.coverage(r, h), "length_v1": mx.length_v1(F.size(h)), "length_v2": mx.length_v2(F.size(h)),
    }).drop("_h", "_r", "_l")
    # rows that share a key meet each other's scores, once for each size
    return _repeated(t.join(_rouge(pairs, key, [1, 2], hyp, ref), key), F.col("_m") * F.col("_m"))


def semantic(pairs: DataFrame, key: list[str], a: str = "answer", b: str = "reference") -> DataFrame:
    """Cosine of the TF-IDF vectors, fitted on each pair alone, of character n-grams inside words; counted in the row, so no gram is shuffled."""
    g = _by_key(pairs, key, mx.words(F.col(a)), mx.words(F.col(b))).withColumn("_s", mx.char_cosine(F.col("_a"), F.col("_b")))
    return _repeated(g.select(*key, "_m", F.when(_known(key), F.col("_s")).otherwise(0.0).alias("semantic")), F.col("_m"))


def specificity(answers: DataFrame, docs: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """Share of an answer's tokens whose idf in the corpus is above the median; unknown words count as 0. The idf is built once."""
    df = docs.select(F.explode(F.array_distinct(mx.eval_tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("w", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    mid = idf.agg(F.median("idf").alias("mid"))
    t = answers.select(*key, F.explode(mx.eval_tokens(F.col(answer))).alias("w")).join(idf, "w", "left").crossJoin(F.broadcast(mid))
    s = t.groupBy(*key).agg((F.count_if(F.coalesce("idf", F.lit(0.0)) > F.col("mid")) / F.count(F.lit(1))).alias("specificity"))
    return answers.select(*key).join(s, key, "left").withColumn("specificity", F.coalesce("specificity", F.lit(0.0)))


def compare_methods(scores: DataFrame, metrics: list[str]) -> DataFrame:
    return scores.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics])


def question_matrix(scores: DataFrame, value: str) -> DataFrame:
    """Questions by methods."""
    return scores.groupBy("q_id").pivot("method").agg(F.first(value))


def budget_eval(contexts: DataFrame, gold: DataFrame, budgets: tuple[int, ...] = (800, 1500, 3000, 6000, 12000), reference: str | None = None) -> DataFrame:
    """Mean key-point recall of contexts (method, q_id, context) cut to each budget, against gold (q_id, keypoints).

    With ``reference``, a column of gold, also the mean cosine of the cut context to it.
    """
    cut = contexts.join(gold, "q_id").withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("_c", F.left("context", F.col("budget")))
    hit = cut.withColumn("recall", mx.keypoint_coverage(F.col("keypoints"), F.col("_c")))
    out = [F.avg("recall").alias("recall")]
    if reference is not None:
        key = ["method", "q_id", "budget"]
        hit = hit.join(semantic(cut, key, "_c", reference), key)
        out.append(F.avg("semantic").alias("semantic"))
    return hit.groupBy("method", "budget").agg(*out)


def judged(replies: DataFrame, reply: str = "reply", criteria: tuple[str, ...] = ("faithfulness", "relevance", "completeness", "clarity")) -> DataFrame:
    """Judge replies parsed, clamped to 1..5 and averaged on a scale of 0 to 1."""
    parsed = replies.withColumn("_j", F.from_json(mx.judge_json(F.col(reply)), ", ".join(f"{c} double" for c in criteria)))
    marks: list[Column] = [mx.judge_score(F.col(f"_j.{c}")) for c in criteria]
    total = sum((F.coalesce(m, F.lit(0.0)) for m in marks[1:]), F.coalesce(marks[0], F.lit(0.0)))
    n = sum((m.isNotNull().cast("int") for m in marks[1:]), marks[0].isNotNull().cast("int"))
    return parsed.withColumn("judge", F.when(n > 0, total / n)).drop("_j")


def blinded(answers: DataFrame, seed: int = 42) -> DataFrame:
    """Letters A, B, C ... in an order that a digest of the seed fixes for each question."""
    n = F.row_number().over(Window.partitionBy("q_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("q_id").cast("string"), "method").cast("binary"))))
    return answers.withColumn("letter", F.chr(F.lit(64) + n))
