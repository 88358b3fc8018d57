"""Markdown reports from small frames: hot edges, metrics by method, and blind answers with their key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evaluation, retrieval


def _table(names: list[str], rows: list[list]) -> list[str]:
    cell = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def hot_edges(edges: DataFrame, domain: str, n: int = 15, explain: Callable[[str], str] | None = None) -> str:
    """The edges of largest surprisal with their attributes; ``explain`` is a plug-in prompt -> text."""
    out = ["# Surprising links", "", f"Domain: {domain}", ""]
    for i, r in enumerate(retrieval.hot_edges(edges, n).collect(), 1):
        out += [f"## {i}. {r['src']} - {r['dst']}", f"- surprisal: {r['surprisal']:.2f}", f"- weight: {r['weight']}", f"- methods: {', '.join(r['methods'] or [])}"]
        if r["relation"]:
            out.append(f"- relation: {r['relation']}")
        if explain:
            out += ["", explain(f"Why do '{r['src']}' and '{r['dst']}' stand together in texts on {domain}? Surprisal {r['surprisal']:.2f}.")]
        out.append("")
    return "\n".join(out)


def metrics(scores: DataFrame, names: list[str]) -> str:
    """Means by method, best composite first if there is one, and the number of questions."""
    means = evaluation.compare_methods(scores, names).join(scores.groupBy("method").agg(F.count(F.lit(1)).alias("n")), "method")
    by = "composite" if "composite" in names else names[-1]
    rows = [[r["method"], r["n"], *(r[c] for c in names)] for r in means.orderBy(F.desc(by), "method").collect()]
    return "\n".join(["# Answers by method", "", *_table(["method", "n", *names], rows), ""])


def blind(answers: DataFrame, questions: DataFrame, seed: int = 42) -> tuple[str, str]:
    """(report, key): answers under letters, question by question, and which method is which."""
    rows = evaluation.blinded(answers, seed).join(questions, "q_id").orderBy("q_id", "letter").collect()
    out, key, last = ["# Answers to be judged", ""], [], None
    for r in rows:
        if r["q_id"] != last:
            last = r["q_id"]
            out += [f"## {last}. {r['q']}", ""]
        out += [f"**{r['letter']}**", "", r["answer"] or "", ""]
        key.append([last, r["letter"], r["method"]])
    return "\n".join(out), "\n".join(_table(["question", "letter", "method"], key))
