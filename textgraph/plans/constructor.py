"""The graph build and question answering, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRUTH_CORPUS, BuildConfig
from ..operators import edges, graph, retrieval, stability, vertices
from ..sources import files


@dataclass
class Built:
    vertices: DataFrame
    edges: DataFrame

    def nodes(self) -> DataFrame:
        """Nodes of the pruned graph with the attributes of their vertices."""
        ids = self.edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct()
        return ids.join(self.vertices, "label", "left").withColumnRenamed("label", "id")


class GraphConstructor:
    def __init__(self, config: BuildConfig = TRUTH_CORPUS):
        self.config = config

    def build(self, docs: DataFrame) -> Built:
        """Vertices, typed edges, pruning; lazy but for the bounded list of labels."""
        c, docs = self.config, files.spread(docs)
        v = vertices.extract(docs, c)
        e = edges.build(docs, edges.labels_of(v), c)
        return Built(v, graph.pinned(graph.filtered(e, c.max_vertices, c.min_weight, c.min_pmi, c.backbone_k)))

    def run(self, docs: DataFrame, stress: bool = True, baseline: bool = True) -> dict:
        built = self.build(docs)
        out: dict = {"graph": built, "meta": graph.metrics(built.edges)}
        if stress:
            c = self.config
            nodes, pairs = stability.stress(docs, lambda d: self.build(d).edges, c.stress_seeds, c.stress_fraction, c.seed, c.stress_threshold)
            out["stress"] = {"nodes": nodes, "edges": pairs}
        if baseline:
            b = edges.baseline(docs, self.config.profile)
            labels = graph.greedy_modularity(graph.collected(b), weighted=False)
            rows = docs.sparkSession.createDataFrame(sorted(labels.items()), "id string, community int")
            out["baseline"] = {"edges": b, "communities": graph.communities(b, rows)}
        return out

    @staticmethod
    def save(made: dict, path: str) -> None:
        """What run() made: the graph as CSV, run_meta, stress votes and communities as JSON."""
        files.write_graph(made["graph"].nodes(), made["graph"].edges, f"{path}/graph")
        files.write_json(made["meta"], f"{path}/run_meta")
        if "stress" in made:
            files.write_json(made["stress"]["nodes"], f"{path}/stress_nodes")
            files.write_json(made["stress"]["edges"], f"{path}/stress_edges")
        if "baseline" in made:
            files.write_graph(made["baseline"]["edges"].select(F.explode(F.array("src", "dst")).alias("id")).distinct(), made["baseline"]["edges"], f"{path}/baseline")
            files.write_json(made["baseline"]["communities"], f"{path}/communities")


class QuestionAnswering:
    """Contexts by strategy (walk, community, combined, long) and, with a client, answers."""

    def __init__(self, docs: DataFrame, pruned: DataFrame, config: BuildConfig = TRUTH_CORPUS, client=None):
        self.docs, self.edges, self.config, self.client = docs, pruned, config, client

    def _labels(self) -> DataFrame:
        found = graph.louvain(graph.collected(self.edges))
        return self.docs.sparkSession.createDataFrame(sorted(found.items()), "id string, community int")

    def contexts(self, questions: DataFrame, strategy: str = "combined") -> DataFrame:
        p = self.config.profile
        if strategy == "walk":
            return retrieval.walk_context(self.edges, self.docs, questions, p)
        if strategy == "community":
            return retrieval.community_context(self.edges, self._labels(), questions)
        if strategy == "combined":
            return retrieval.combined_context(retrieval.walk_context(self.edges, self.docs, questions, p, 5), retrieval.community_context(self.edges, self._labels(), questions, 2))
        if strategy == "long":
            return questions.select("q_id").join(F.broadcast(retrieval.long_context(self.docs)))
        raise ValueError(strategy)

    def answer_all(self, questions: DataFrame, strategy: str = "combined") -> DataFrame:
        return retrieval.answered(self.contexts(questions, strategy).join(questions, "q_id"), self.client)
