"""JSON, CSV, GraphML and spreadsheet files, all read by Spark."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

DOCUMENT_SCHEMA = (
    "doc_id string, source string, url string, date string, title string, text string, authors array<string>, top_image string, "
    "entities array<struct<text:string,type:string>>, keywords array<string>, tags array<string>, domain string, voice_type string, "
    "text_type string, actor string, city string, discovery_query string, relevance_reason string"
)
GOLD_SCHEMA = "q string, gold string, keypoints array<string>"
#: Bytes of a row group by Parquet's own default.
ROW_GROUP = 128 << 20


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """A JSON array of documents, or one document a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path)


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """One term a line: stop words and the like, a short list by its nature."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly over the cores where its scan cannot feed them all; else df as it is.

    A row group of Parquet is one task's work however small the splits, so a table of fewer
    files than cores and less than a row group for each core would keep most of them idle.
    Only such tables are shuffled, which bounds what is moved; larger ones are read in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size < cores * ROW_GROUP and len(df.inputFiles()) < cores  # the files of a large table are not listed
    return df.repartition(cores) if small else df


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """edges.csv with source, target, weight, methods (brackets and quotes removed), pmi and surprisal if there."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0)) if c in raw.columns else F.lit(None).cast("double")
    methods = F.split(F.regexp_replace("methods", r"[\[\]' ]", ""), ",") if "methods" in raw.columns else F.lit(None).cast("array<string>")
    return raw.select(
        F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), F.coalesce(F.expr("try_cast(weight as bigint)"), F.lit(1)).alias("weight") if "weight" in raw.columns else F.lit(1).cast("long").alias("weight"),
        methods.alias("methods"), number("pmi").alias("pmi"), number("surprisal").alias("surprisal"),
    )


def read_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: attributes by the names that its keys declare."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = {r["_id"]: r["_attr.name"] for r in xml("key", "`_id` string, `_attr.name` string").select("_id", F.col("`_attr.name`")).collect()}
    nodes = xml("node", "_id string").select(F.col("_id").alias("id"))
    raw = xml("edge", "_source string, _target string, data array<struct<_VALUE:string,_key:string>>")
    m = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    by = {name: F.try_element_at(m, F.lit(k)) for k, name in keys.items()}
    get = lambda n, t: by[n].cast(t) if n in by else F.lit(None).cast(t)
    edges = raw.select(
        F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("dst"), F.coalesce(get("weight", "long"), F.lit(1)).alias("weight"),
        F.split(get("methods", "string"), ",").alias("methods"), get("relation", "string").alias("relation"), get("emotional", "boolean").alias("emotional"),
        get("surprisal", "double").alias("surprisal"), get("pmi", "double").alias("pmi"),
    )
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A pruned graph (bounded by the build's max_vertices) as one GraphML file on the driver."""
    kinds = {"bigint": "long", "double": "double", "boolean": "boolean"}
    cols = [(c, t) for c, t in edges.dtypes if c not in ("src", "dst")]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for i, (c, t) in enumerate(cols):
            f.write(f'<key id="d{i}" for="edge" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>\n')
        f.write('<graph edgedefault="undirected">\n')
        for r in nodes.select("id").orderBy("id").toLocalIterator():
            f.write(f'<node id="{escape(r["id"], {chr(34): "&quot;"})}"/>\n')
        for r in edges.orderBy("src", "dst").toLocalIterator():
            data = ""
            for i, (c, _) in enumerate(cols):
                v = r[c]
                if v is not None:
                    data += f'<data key="d{i}">{escape(",".join(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v))}</data>'
            f.write("<edge source=\"{}\" target=\"{}\">{}</edge>\n".format(*(escape(r[c], {'"': "&quot;"}) for c in ("src", "dst")), data))
        f.write("</graph>\n</graphml>\n")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as CSV folders, arrays joined by commas."""
    flat = lambda df: df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat(nodes).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    flat(edges).withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _sheet(raw: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by header."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        name = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in row.findall("m:c", ns):
                col = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                v = c.find("m:v", ns)
                if c.get("t") == "inlineStr":
                    cells[col] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[col] = shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append(cells)
    if not rows:
        return []
    head = {col: name.strip().lower() for col, name in rows[0].items()}
    return [{head[c]: v for c, v in r.items() if c in head} for r in rows[1:]]


def read_xlsx(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Spreadsheets as string columns: ``columns`` maps our names to the header's (in lower case)."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                rows = _sheet(raw)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(columns[n].lower()) for r in rows], pa.string()) for n in names], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def spreadsheet_documents(rows: DataFrame) -> DataFrame:
    """Documents from rows (title, author, summary, tags, date, url): untitled and unsummarised rows go."""
    s = lambda c: F.coalesce(tx.strip(F.col(c)), F.lit(""))
    keep = rows.filter((s("title") != "") | (s("summary") != ""))
    text = F.array_join(F.filter(F.array(s("title"), s("author"), s("summary")), lambda x: x != ""), ". ")
    tags = tx.parse_tags(F.col("tags"))
    return keep.select(
        "url", tx.excel_date(F.expr("try_cast(date as double)")).cast("string").alias("date"), s("title").alias("title"), text.alias("text"),
        F.when(s("author") != "", F.array(s("author"))).otherwise(F.array().cast("array<string>")).alias("authors"), tags.alias("tags"), F.array_distinct(tags).alias("keywords"), F.lit("article").alias("voice_type"),
    )
