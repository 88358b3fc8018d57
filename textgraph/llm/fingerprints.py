"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the K smallest distinct 64-bit hashes of a text's
shingles (five successive words).  Sketches of parts merge by the K smallest of their
union.  From two sketches follow resemblance and containment, and from one the number of
distinct shingles: exact below K of them, else from the K-th smallest hash.

Words are what white space divides, lower-cased.  A text of one to four words has one
shingle of them all; a null, empty or blank text has an empty sketch, and two empty
sketches are alike (1.0).

The successor of each document in ascending id comes without any global sort: ids are cut
into even ranges, and each range also receives the first rows of the next one (the last:
those of the first).  Ids may repeat (rows then follow by a hash of their text) or be null
(first); ids are integers; a lone row follows itself.  Very long texts are one row as any
other, an empty table gives no rows, and only the id and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 5
K = 128


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a column of words (not an expression, which would be evaluated at each place)."""
    full = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, width)]),
    )
    return F.when(F.size(words) >= width, full).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(
        F.array().cast("array<bigint>")
    )


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1.0 if a has none."""
    r = resemblance(a, b, k)
    common_count = r * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common_count / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    """Hexadecimal hashes, ascending, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, object]:
    """docs with ``_range`` and ``_halo`` (rows there only to follow others), and the window in which lead() gives the successor."""
    bounds = common.id_bounds(docs, id_col)
    ranged = docs.withColumn("_range", common.range_of(F.col(id_col), bounds))
    # one row for each range, at most common.MAX_RANGES
    least = [tuple(r) for r in ranged.groupBy("_range").agg(F.min(id_col).alias("m"), F.count_if(F.col(id_col).isNull()).alias("nulls")).orderBy("_range").collect()]
    firsts = [(r, None if nulls else m, least[i - 1][0]) for i, (r, m, nulls) in enumerate(least)]
    heads = docs.sparkSession.createDataFrame(firsts, "_r int, _first long, _prev int")
    joined = ranged.join(F.broadcast(heads), (F.col("_range") == F.col("_r")) & F.col(id_col).cast("long").eqNullSafe(F.col("_first")), "left")
    places = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("halo")))
    places = F.when(F.col("_r").isNotNull(), F.concat(places, F.array(F.struct(F.col("_prev").alias("r"), F.lit(True).alias("halo"))))).otherwise(places)
    spread = joined.withColumn("_p", F.explode(places))
    out = spread.drop("_range", "_r", "_first", "_prev").withColumn("_range", F.col("_p.r")).withColumn("_halo", F.col("_p.halo")).drop("_p")
    return out, Window.partitionBy("_range").orderBy("_halo", F.col(id_col).asc_nulls_first(), "_tie")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness to each other and to the successor's."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("_tie", F.xxhash64("t"))
    spread, order = with_next(base, "id")
    rows = spread.withColumn("n", F.length("t").cast("long")).withColumn("next", F.lead("t").over(order))
    half = F.expr("CAST(n div 2 AS INT)")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(t, 1, CAST(n - n div 2 AS INT))"), F.coalesce(F.substring("next", F.lit(1), half), F.lit(""))))
    rows = rows.select("id", "n", "_range", "_halo", "_tie", F.sha2("edited", 256).alias("edited_sha256"), words_of(F.col("t")).alias("w"), F.when(~F.col("_halo"), words_of(F.col("edited"))).alias("we"))
    rows = rows.select("id", "n", "_range", "_halo", "_tie", "edited_sha256", sketch(shingle_hashes(F.col("w")), k).alias("f"), sketch(shingle_hashes(F.col("we")), k).alias("fe"))
    rows = rows.withColumn("fn", F.lead("f").over(order)).filter(~F.col("_halo"))
    return rows.select("id", "n", "edited_sha256", "f", "fe", resemblance(F.col("f"), F.col("fe"), k).alias("near_edited"), resemblance(F.col("f"), F.col("fn"), k).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(docs).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", as_string(F.col("f")).alias("fingerprint"),
        as_string(F.col("fe")).alias("edited_fingerprint"), "near_edited", "near_next",
        distinct_count(F.col("f")).alias("n_shingles"), containment(F.col("f"), F.col("fe")).alias("edited_containment"),
    )
