import io
import zipfile

from pyspark.sql import functions as F

from textgraph import sources
from textgraph.config import TESTDATA
from textgraph.plans import GraphConstructor, QuestionAnswering


def test_graphml_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b & c", 3, ["x", "y"], "contrast", True, 1.5, -0.25), ("a", "d", 1, ["x"], None, None, None, None)],
                              "src string, dst string, weight long, methods array<string>, relation string, emotional boolean, surprisal double, pmi double")
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    path = str(tmp_path / "g.graphml")
    sources.write_graphml(n, e, path)
    nodes, back = sources.read_graphml(spark, path)
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b & c", "d"]
    assert sorted(map(str, back.select(e.columns).collect())) == sorted(map(str, e.collect()))


def test_csv_round_trip_and_json(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 3, ["x", "y"], 1.5)], "src string, dst string, weight long, methods array<string>, pmi double")
    sources.write_graph(e.select(F.col("src").alias("id")), e, str(tmp_path / "g"))
    got = sources.read_edges_csv(spark, str(tmp_path / "g/edges")).first()
    assert (got.src, got.dst, got.weight, got.methods, got.pmi, got.surprisal) == ("a", "b", 3, ["x", "y"], 1.5, None)
    (tmp_path / "d.json").write_text('[{"doc_id": "1", "text": "a", "entities": [{"text": "X", "type": "PER"}]}, {"doc_id": "2"}]')
    assert [r["doc_id"] for r in sources.read_documents(spark, str(tmp_path / "d.json")).orderBy("doc_id").collect()] == ["1", "2"]


def test_xlsx(spark, tmp_path):
    sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
             '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Date</t></is></c></row>'
             '<row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>61</v></c></row></sheetData></worksheet>')
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><t>Summary</t></si><si><t>Hello</t></si></sst>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    cols = {"title": "title", "summary": "summary", "date": "date", "author": "author", "tags": "tags", "url": "url"}
    d = sources.spreadsheet_documents(sources.read_xlsx(spark, str(tmp_path / "a.xlsx"), cols)).first()
    assert (d.title, d.text, d.date, d.tags) == ("Hello", "Hello", "1900-03-01", [])


def test_build_answer_and_stream(spark, tmp_path):
    from textgraph.operators import edges
    from textgraph.streaming import incremental

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    built = GraphConstructor(TESTDATA).build(docs)
    rows = built.edges.collect()
    assert rows and all(r.src < r.dst for r in rows) and built.nodes().filter("score is null").count() == 0
    q = spark.createDataFrame([(1, "the then that and this")], "q_id long, q string")
    out = QuestionAnswering(docs, built.edges, TESTDATA).answer_all(q, "combined").first()
    assert out.q_id == 1 and out.answer
    labels = edges.labels_of(built.vertices)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.count_stream(s, labels, TESTDATA, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.src, r.dst): r.weight for r in incremental.current(spark, str(tmp_path / "out")).collect()}
    from dataclasses import replace

    want = {(r.src, r.dst): r.weight for r in edges.build(docs, labels, replace(TESTDATA, edge_methods=TESTDATA.edge_methods[:3])).collect()}
    assert got == want


def test_small_tables_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    out = sources.spread(one)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 1000
    spark.range(1000).repartition(spark.sparkContext.defaultParallelism).write.parquet(path + "s")
    many = spark.read.parquet(path + "s")
    assert sources.spread(many) is many  # enough files to feed every core
