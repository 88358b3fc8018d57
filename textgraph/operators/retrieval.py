"""Question answering contexts, for all questions at once: every frame carries q_id."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import codes
from ..functions import text as tx
from .graph import degrees, ends


def _rank(df: DataFrame, by: list[Column], keep: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("q_id").orderBy(*by)).cast("bigint")).filter(F.col(name) <= keep)


def seeds(nodes: DataFrame, questions: DataFrame, profile: Profile, top_k: int = 6) -> DataFrame:
    """(q_id, id, score): labels by the share of their words in the question, one more if all are.

    Candidates come from an equi-join on words; without any, the profile's core concepts that the graph has.
    """
    q = questions.select("q_id", F.array_distinct(tx.tokens(F.col("q"), profile.token)).alias("qt"))
    words = nodes.select("id", F.array_distinct(F.split("id", " ")).alias("nt"))
    hit = q.select("q_id", F.explode("qt").alias("w")).join(words.select("id", "nt", F.explode("nt").alias("w")), "w").groupBy("q_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("nt")).alias("size"))
    score = F.col("n") / F.col("size") + F.when(F.col("n") == F.col("size"), 1.0).otherwise(0.0)
    found = _rank(hit.select("q_id", "id", score.alias("score")), [F.desc("score"), F.desc("id")], top_k)
    core = {c: i + 1 for i, c in enumerate(profile.core_concepts)}
    place = F.array_position(F.array(*map(F.lit, core)), F.col("id")) if core else F.lit(0)
    fallback = nodes.select("id", place.alias("rank")).filter(F.col("rank") > 0)
    # at most len(core_concepts) rows
    lone = questions.select("q_id").join(found.select("q_id"), "q_id", "left_anti").join(F.broadcast(fallback))
    extra = _rank(lone.select("q_id", "id", F.lit(0.0).alias("score"), F.col("rank").alias("o")), [F.col("o")], top_k).drop("o")
    return found.unionByName(extra.select("q_id", "id", "score", "rank"))


def walk(edges: DataFrame, seed: DataFrame, depth: int = 2) -> DataFrame:
    """(q_id, id, dist): nodes within ``depth`` steps, by frontier joins."""
    near = ends(edges).select("id", "nbr")
    seen = seed.select("q_id", "id").distinct().withColumn("dist", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        nxt = front.join(near, "id").select("q_id", F.col("nbr").alias("id")).distinct()
        front = nxt.join(seen.select("q_id", "id"), ["q_id", "id"], "left_anti").withColumn("dist", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def walk_edges(edges: DataFrame, seen: DataFrame, seed: DataFrame, keep: int = 22) -> DataFrame:
    """Edges at any visited node, those at a seed first, then contrast, then weight."""
    v = seen.select("q_id", "id")
    touch = edges.join(v, edges["src"] == v["id"]).drop("id").unionByName(edges.join(v, edges["dst"] == v["id"]).drop("id")).dropDuplicates(["q_id", "src", "dst"])
    s = seed.select("q_id", F.col("id").alias("sid")).distinct()
    at = touch.join(s, (touch["q_id"] == s["q_id"]) & ((touch["src"] == s["sid"]) | (touch["dst"] == s["sid"])), "left_semi").select("q_id", "src", "dst").withColumn("at_seed", F.lit(1))
    ranked = touch.join(at, ["q_id", "src", "dst"], "left").withColumn("at_seed", F.coalesce("at_seed", F.lit(0)))
    tag = F.when(F.col("relation") == "contrast", "contrast").when(F.array_contains("methods", "emotional"), "emotional").otherwise("co-occ")
    ranked = ranked.withColumn("tag", tag)
    return _rank(ranked, [F.desc("at_seed"), F.desc((F.col("tag") == "contrast").cast("int")), F.desc("weight"), F.col("src"), F.col("dst")], keep).select("q_id", "src", "dst", "weight", "tag", "at_seed", "rank")


def concepts(edges: DataFrame, seen: DataFrame, keep: int = 18) -> DataFrame:
    """Visited nodes by their weighted degree in the whole graph."""
    return _rank(seen.select("q_id", "id").join(degrees(edges).select("id", "weighted"), "id"), [F.desc("weighted"), F.col("id")], keep)


def _first_docs(pattern: str, ids: list[str], keep: int, lemmas: tuple | None = None):
    """(id, doc_id): of each chunk of texts, the ``keep`` least doc_ids that have the id among their grams."""

    def run(batches):
        one = pa.array(ids, pa.string())
        two = [(i, x.split(" ")) for i, x in enumerate(ids) if x.count(" ") == 1]
        ends = pa.array([w for _, ws in two for w in ws], pa.string())
        for batch in batches:
            for c in codes.chunks(batch.column("_x"), pattern, lemmas):
                size, n = max(c.last - c.first, 1), max(len(c.names), 1)
                own = pc.index_in(c.names, value_set=one).fill_null(-1).to_numpy().astype(np.int64)[c.code]
                keys = [own[own >= 0] * size + c.doc[own >= 0]]
                pair = c.code[:-1] * n + c.code[1:]
                for (i, _), (a, b) in zip(two, pc.index_in(ends, value_set=c.names).fill_null(-1).to_numpy().reshape(-1, 2).tolist(), strict=True):
                    if a >= 0 and b >= 0:
                        keys.append(i * size + c.doc[:-1][(pair == a * n + b) & (c.doc[:-1] == c.doc[1:])])
                key = np.unique(np.concatenate(keys))
                doc_ids = batch.column("doc_id").slice(c.first, c.last - c.first)
                place = np.empty(len(doc_ids), np.int64)
                place[pc.array_sort_indices(doc_ids).to_numpy()] = np.arange(len(doc_ids))
                label, doc = key // size, key % size
                order = np.lexsort((place[doc], label))
                label, doc = label[order], doc[order]
                first = np.arange(len(label)) - np.searchsorted(label, label) < keep
                yield pa.RecordBatch.from_arrays([one.take(pa.array(label[first])), doc_ids.take(pa.array(doc[first]))], ["id", "doc_id"])

    return run


def snippets(docs: DataFrame, seed: DataFrame, profile: Profile, keep: int = 4, chars: int = 220) -> DataFrame:
    """The first documents with a seed among their grams: [title] head of the text.

    The first documents of a question are among the first of each of its seeds, and seeds are
    nodes of a pruned graph: so texts are gone over where they lie, and ``keep`` ids a seed and
    chunk are shuffled.
    """
    ids = sorted(r["id"] for r in seed.select("id").distinct().collect())
    kind = dict(docs.dtypes)["doc_id"]
    have = codes.frame(docs.filter(F.col("doc_id").isNotNull()), profile, "doc_id").mapInArrow(_first_docs(profile.token, ids, keep), f"id string, doc_id {kind}").distinct()
    have = have.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("doc_id"))).filter(F.col("n") <= keep).select("id", "doc_id")
    have = docs.sparkSession.createDataFrame(have.collect(), have.schema)  # keep rows a seed
    first = _rank(seed.select("q_id", "id").join(F.broadcast(have), "id").select("q_id", "doc_id").distinct(), [F.col("doc_id")], keep)
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    heads = docs.join(F.broadcast(have.select("doc_id").distinct()), "doc_id", "left_semi")
    heads = heads.select("doc_id", F.concat(F.lit("["), F.substring(title, 1, 45), F.lit("] "), tx.strip(F.substring("text", 1, chars)), F.lit("…")).alias("snippet"))
    return first.join(heads, "doc_id").select("q_id", "rank", "doc_id", "snippet")


def walk_context(edges: DataFrame, docs: DataFrame, questions: DataFrame, profile: Profile, top_k: int = 6, depth: int = 2) -> DataFrame:
    """(q_id, context): seeds, typed edges, concepts nearby and snippets as text."""
    s = seeds(degrees(edges).select("id"), questions, profile, top_k)
    seen = walk(edges, s, depth)
    line = F.concat(F.lit("«"), "src", F.lit("» — «"), "dst", F.lit("» ["), "tag", F.lit(", "), "weight", F.lit("]"))
    ordered = lambda df, c: df.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))).alias("l")).select("q_id", F.transform("l", lambda r: r["x"]).alias("l"))
    parts = [
        ordered(s, F.col("id")).select("q_id", F.array_join("l", ", ").alias("a")),
        ordered(walk_edges(edges, seen, s), line).select("q_id", F.array_join("l", "\n").alias("b")),
        ordered(concepts(edges, seen), F.col("id")).select("q_id", F.array_join("l", ", ").alias("c")),
        ordered(snippets(docs, s, profile), F.col("snippet")).select("q_id", F.array_join("l", "\n").alias("d")),
    ]
    out = questions.select("q_id")
    for p in parts:
        out = out.join(p, "q_id", "left")
    return out.select("q_id", F.concat_ws("\n", "a", "b", "c", "d").alias("context"))


def community_index(edges: DataFrame, labels: DataFrame, top: int = 8) -> DataFrame:
    """(community, size, summary): a stub of the heaviest members and the edge types, computed once for all questions."""
    from .graph import communities

    base = communities(edges, labels, top)
    lab = labels.select("id", "community")
    types = edges.join(lab.select(F.col("id").alias("src"), "community"), "src").join(lab.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").filter(F.col("community") == F.col("c2"))
    types = types.select("community", F.explode("methods").alias("m")).groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("types"))
    return base.withColumnRenamed("community_id", "community").join(types, "community", "left").select("community", "size", F.concat_ws("; ", "top_entities", F.coalesce("types", F.lit("")), F.col("size").cast("string")).alias("summary"))


def community_scores(index: DataFrame, questions: DataFrame, top_k: int = 3) -> DataFrame:
    """Communities by the number of words that their summary shares with the question."""
    q = questions.select("q_id", F.explode(tx.overlap_words(F.col("q"))).alias("w"))
    s = index.select("community", F.explode(tx.overlap_words(F.col("summary"))).alias("w"))
    # communities without a common word score 0; they are few, as the graph is pruned
    base = questions.select("q_id").join(F.broadcast(index.select("community")))
    n = q.join(s, "w").groupBy("q_id", "community").agg(F.count(F.lit(1)).alias("score"))
    return _rank(base.join(n, ["q_id", "community"], "left").withColumn("score", F.coalesce("score", F.lit(0))), [F.desc("score"), F.col("community")], top_k)


def community_context(edges: DataFrame, labels: DataFrame, questions: DataFrame, top_k: int = 3, summarise=None, nodes: int = 15, links: int = 10) -> DataFrame:
    """The best communities of each question: summary, first members, and inner edges with their types.

    ``summarise`` is a plug-in (list of members) -> summary, which takes the place of the stub; it
    runs once for each community.
    """
    from .graph import degrees

    index = community_index(edges, labels)
    lab = labels.select("id", "community")
    by_degree = F.array_sort(F.collect_list(F.struct((-F.col("weighted")).alias("w"), F.col("id").alias("id"))))
    members = degrees(edges).join(lab, "id").groupBy("community").agg(by_degree.alias("m")).withColumn("m", F.transform("m", lambda x: x["id"]))
    inner = edges.join(lab.withColumnsRenamed({"id": "src", "community": "cs"}), "src").join(lab.withColumnsRenamed({"id": "dst", "community": "cd"}), "dst").filter("cs = cd")
    kind = F.when(F.col("relation").isNotNull(), F.concat(F.lit(" ["), "relation", F.lit("]"))).otherwise("")
    text = F.concat(F.lit('"'), "src", F.lit('" - "'), "dst", F.lit('"'), kind, F.lit(" ("), F.array_join("methods", ","), F.lit(")"))
    n = F.row_number().over(Window.partitionBy("cs").orderBy(F.desc("weight"), "src", "dst"))
    tied = inner.select(F.col("cs").alias("community"), text.alias("t"), n.alias("n"))
    tied = tied.groupBy("community").agg(F.count(F.lit(1)).alias("n_links"), F.array_sort(F.collect_list(F.when(F.col("n") <= links, F.struct("n", "t")))).alias("l"))
    known = index.join(members, "community").join(tied, "community", "left")
    if summarise is not None:
        rows = known.select("community", "m").collect()  # communities of a pruned graph, which is bounded
        own = edges.sparkSession.createDataFrame([(r["community"], summarise(r["m"])) for r in rows], f"community {dict(labels.dtypes)['community']}, own string")
        known = known.join(own, "community").withColumn("summary", F.coalesce("own", "summary"))
        index = known.select("community", "summary")
    part = F.concat_ws("\n", F.concat(F.lit("### "), F.col("community").cast("string"), F.lit(" ("), F.size("m").cast("string"), F.lit(")")), "summary", F.array_join(F.slice("m", 1, nodes), ", "),
                       F.concat(F.col("n_links").cast("string"), F.lit(": "), F.array_join(F.transform("l", lambda x: x["t"]), "; ")))
    best = community_scores(index, questions, top_k).join(known.select("community", part.alias("part")), "community")
    return best.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("l")).select("q_id", F.array_join(F.transform("l", lambda r: r["part"]), "\n\n").alias("context"))


def combined_context(local: DataFrame, broad: DataFrame) -> DataFrame:
    """Both contexts, one after the other, nothing removed."""
    return local.join(broad.withColumnRenamed("context", "c2"), "q_id", "full").select("q_id", F.concat_ws("\n\n", "context", "c2").alias("context"))


def long_context(docs: DataFrame, chars: int = 12000) -> DataFrame:
    """The first ``chars`` characters of all documents in order: only as many rows as can reach into them are read."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    piece = docs.select("doc_id", F.concat(F.lit("["), title, F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("p"))
    few = piece.select("doc_id", F.substring("p", 1, chars).alias("p")).orderBy("doc_id").limit(chars // 3 + 1)
    return few.groupBy().agg(F.array_sort(F.collect_list(F.struct("doc_id", "p"))).alias("l")).select(F.substring(F.array_join(F.transform("l", lambda r: r["p"]), "\n\n"), 1, chars).alias("context"))


def hot_edges(edges: DataFrame, n: int = 12) -> DataFrame:
    """Edges of the largest surprisal."""
    return edges.filter(F.col("surprisal").isNotNull()).orderBy(F.desc("surprisal"), "src", "dst").limit(n)


def answered(contexts: DataFrame, client, template: str = "{context}\n\n{question}") -> DataFrame:
    """(q_id, answer): a plug-in client(prompt) -> str on the executors; None gives the context's head, offline."""

    def run(batches):
        for b in batches:
            prompts = [template.format(context=c or "", question=q or "") for c, q in zip(b.column("context").to_pylist(), b.column("q").to_pylist(), strict=True)]
            answers = [client(p) if client else p[:400] for p in prompts]
            yield pa.RecordBatch.from_arrays([b.column("q_id"), pa.array(answers, pa.string())], ["q_id", "answer"])

    return contexts.select("q_id", "q", "context").mapInArrow(run, f"q_id {contexts.schema['q_id'].dataType.simpleString()}, answer string")


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """(q_id, id, rank): of all rows (id, e), the k of largest dot product, to nine places, with each query (q_id, e); ties by id.

    Queries travel in blocks of a set number with the code of their tasks; a task keeps k rows
    a query, so a block shuffles k rows a query and task, whatever the table's size.
    """
    spark = rows.sparkSession
    n = queries.count()
    parts = []
    for b in range(max(1, -(-n // block))):
        own = queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(-(-n // block))) == b) if n > block else queries
        found = own.select("q_id", "e").toArrow()
        ids = found.column("q_id").to_numpy()
        if not len(ids):
            continue
        q = np.array(found.column("e").to_pylist(), float)

        def run(batches, ids=ids, q=q):
            best_s, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    e = np.array(part.column("e").to_pylist(), float)
                    s = np.hstack([best_s, np.round(q @ e.T, 9)])
                    i = np.hstack([best_i, np.broadcast_to(part.column("id").to_numpy(), (len(ids), len(e)))])
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            if best_s.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["q_id", "id", "s"])

        near = rows.select("id", "e").mapInArrow(run, f"q_id {dict(queries.dtypes)['q_id']}, id long, s double")
        parts.append(_rank(near, [F.desc("s"), F.col("id")], k).select("q_id", "id", "rank"))
    if not parts:
        return spark.createDataFrame([], f"q_id {dict(queries.dtypes)['q_id']}, id long, rank int")
    return reduce(DataFrame.unionByName, parts)
