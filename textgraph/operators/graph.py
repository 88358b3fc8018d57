"""Pruning and analysis of undirected graphs given as edges (src < dst, weight)."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush
from itertools import count as counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most edges that the algorithms on the driver take; larger graphs need the distributed ones.
MAX_LOCAL_EDGES = 200_000


def ends(edges: DataFrame) -> DataFrame:
    """(id, nbr, weight) in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))).alias("e"), "weight").select("e.id", "e.nbr", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("id").agg(F.sum("weight").alias("weighted"), F.count(F.lit(1)).alias("degree"))


def pmi(edges: DataFrame) -> DataFrame:
    """log2(w T / (d_u d_v)), rounded to four places."""
    d = degrees(edges).select("id", F.col("weighted").alias("d"))
    total = edges.agg(F.sum("weight").alias("T"))
    j = edges.join(d.select(F.col("id").alias("src"), F.col("d").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dv")), "dst").crossJoin(F.broadcast(total))
    value = F.round(F.log2(F.col("weight") * F.col("T") / (F.col("du").cast("double") * F.col("dv"))), 4)
    return j.withColumn("pmi", value).select(*edges.columns, "pmi")


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The edges among the n nodes of largest weighted degree."""
    top = degrees(edges).orderBy(F.desc("weighted"), "id").limit(n).select("id")
    return edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi")


def backbone(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k heaviest of either end."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "nbr"))
    kept = ends(edges).withColumn("n", n).filter(F.col("n") <= k).select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct()
    return edges.join(kept, ["src", "dst"], "left_semi")


def filtered(edges: DataFrame, max_nodes: int = 400, min_weight: int = 2, min_pmi: float = 5.0, backbone_k: int = 0) -> DataFrame:
    """Top nodes, then least weight, then PMI of what is left, then the backbone."""
    g = pmi(top_nodes(edges, max_nodes).filter(F.col("weight") >= min_weight)).filter(F.col("pmi") >= min_pmi)
    return backbone(g, backbone_k) if backbone_k > 0 else g


def induced(edges: DataFrame, n: int) -> DataFrame:
    return top_nodes(edges, n)


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def threshold_curve(edges: DataFrame) -> DataFrame:
    """Edges that survive each threshold from 1 to the largest weight: suffix sums of the weight histogram."""
    h = edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    t = edges.agg(F.max("weight").alias("m")).select(F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("threshold"))
    return t.join(F.broadcast(h), h["weight"] >= t["threshold"], "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least label reachable; rounds of neighbours' roots and of the root's root go on until nothing changes."""
    both = ends(edges).select("id", "nbr").persist()
    root = both.groupBy("id").agg(F.least(F.min("id"), F.min("nbr")).alias("component"))
    sc = edges.sparkSession.sparkContext
    held: list[DataFrame] = []
    while True:
        near = both.join(root.select(F.col("id").alias("nbr"), "component"), "nbr").groupBy("id").agg(F.min("component").alias("c"))
        new = root.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = root.select(F.col("id").alias("component"), F.col("component").alias("c2"))
        new = new.join(up, "component").select("id", "old", F.least("component", "c2").alias("component"))
        new = new.checkpoint() if sc.getCheckpointDir() else new.persist()
        changed = not new.filter(F.col("old") != F.col("component")).isEmpty()
        root = new.select("id", "component")
        held.append(new)
        for spent in held[:-2]:
            spent.unpersist()
        if not changed:
            return root


def n_components(edges: DataFrame, most: int = MAX_LOCAL_EDGES) -> DataFrame:
    """One row, ``components``: by union-find on the driver for a bounded graph, else by components()."""
    rows = edges.select("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        return components(edges).agg(F.count_distinct("component").alias("components"))
    above: dict = {}

    def find(x):
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for r in rows:
        above[find(r["src"])] = find(r["dst"])
    return edges.sparkSession.createDataFrame([(sum(find(x) == x for x in list(above)),)], "components long")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over communities of L_c/m - (D_c/2m)^2, for labels (id, community)."""
    inside = (
        edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src")
        .join(labels.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
        .filter(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("community")).agg(F.sum("weight").alias("l"))
    )
    deg = degrees(edges).join(labels, "id").groupBy("community").agg(F.sum("weighted").alias("d"))
    m = edges.agg(F.sum("weight").alias("m"))
    q = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), F.lit(2.0))
    return deg.join(inside, "community", "left").crossJoin(F.broadcast(m)).agg(F.sum(q).alias("modularity"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row of size, degree, density and medians."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"))
    aggs = [F.count(F.lit(1)).alias("edges"), F.median("weight").alias("weight_median")]
    if "pmi" in edges.columns:
        aggs.append(F.median("pmi").alias("pmi_median"))
    e = edges.agg(*aggs)
    n, m = F.col("nodes"), F.col("edges")
    d = d.crossJoin(F.broadcast(n_components(edges)))
    return d.crossJoin(F.broadcast(e)).withColumn("density", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0)).withColumn("edges_per_node", F.round(2 * m / n, 2))


def compared(graphs: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [degrees(g).agg(F.count(F.lit(1)).alias("nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges")).select(F.lit(k).alias("graph"), "nodes", "edges") for k, g in graphs.items()])


def pinned(df: DataFrame, most: int = MAX_LOCAL_EDGES) -> DataFrame:
    """A small frame that many branches of a plan read, as a local relation; a larger one is persisted.

    Without this, each branch repeats the whole build, and the plan grows with every use.
    """
    rows = df.limit(most + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= most else df.persist()


def collected(edges: DataFrame, most: int = MAX_LOCAL_EDGES) -> list[tuple[str, str, float]]:
    """The edges on the driver; refused beyond the bound rather than cut."""
    rows = edges.select("src", "dst", F.col("weight").cast("double")).orderBy("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: use label_propagation")
    return [tuple(r) for r in rows]


def louvain(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Deterministic Louvain on a bounded graph: nodes in label order, communities numbered by size."""
    adj: dict = defaultdict(dict)
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    member = {v: v for v in adj}
    while True:
        two_m = sum(sum(x.values()) for x in adj.values()) or 1.0
        deg = {v: sum(x.values()) for v, x in adj.items()}
        com, tot = {v: v for v in adj}, dict(deg)
        moved = True
        any_move = False
        while moved:
            moved = False
            for v in sorted(adj, key=str):
                near: dict = defaultdict(float)
                for u, w in adj[v].items():
                    if u != v:
                        near[com[u]] += w
                tot[com[v]] -= deg[v]
                best, gain = com[v], near.get(com[v], 0.0) - tot[com[v]] * deg[v] / two_m
                for c in sorted(near, key=str):
                    g = near[c] - tot[c] * deg[v] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += deg[v]
                if best != com[v]:
                    com[v], moved, any_move = best, True, True
        member = {v: com[c] for v, c in member.items()}
        if not any_move:
            break
        new: dict = defaultdict(dict)
        for v, x in adj.items():
            for u, w in x.items():
                a, b = com[v], com[u]
                new[a][b] = new[a].get(b, 0) + w
        adj = new
    return _numbered(member)


def greedy_modularity(edges: list[tuple[str, str, float]], weighted: bool = True) -> dict[str, int]:
    """Clauset-Newman-Moore: join the two communities of the largest gain while it is positive."""
    w = {(a, b): (x if weighted else 1.0) for a, b, x in edges}
    m = sum(w.values()) or 1.0
    deg: dict = defaultdict(float)
    e: dict = defaultdict(dict)
    for (a, b), x in w.items():
        deg[a] += x
        deg[b] += x
        e[a][b] = e[b][a] = x
    group = {v: [v] for v in deg}
    tick = counter()
    heap: list = []
    gain = lambda a, b: e[a][b] / m - deg[a] * deg[b] / (2 * m * m)
    stamp: dict = {}

    def push(a: str, b: str) -> None:
        a, b = min(a, b), max(a, b)
        stamp[a, b] = t = next(tick)
        heappush(heap, (-gain(a, b), a, b, t))

    for a, b in w:
        push(a, b)
    while heap:
        g, a, b, t = heappop(heap)
        if a not in group or b not in group or stamp.get((a, b)) != t:
            continue
        if -g <= 1e-12:
            break
        group[a] += group.pop(b)
        for c, x in e.pop(b).items():
            e[c].pop(b, None)
            if c != a:
                e[a][c] = e[c][a] = e[a].get(c, 0) + x
        e[a].pop(b, None)
        deg[a] += deg.pop(b)
        for c in e[a]:
            push(a, c)
    return _numbered({v: root for root, vs in group.items() for v in vs})


def _numbered(member: dict) -> dict[str, int]:
    groups: dict = defaultdict(list)
    for v, c in member.items():
        groups[c].append(v)
    ranked = sorted(groups.values(), key=lambda vs: (-len(vs), min(vs)))
    return {v: i for i, vs in enumerate(ranked) for v in vs}


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) without a driver: each node takes the heaviest label of its neighbours and itself."""
    both = ends(edges).persist()
    own = both.groupBy("id").agg(F.max("weight").alias("w"))
    lab = own.select("id", F.col("id").alias("community"))
    sc = edges.sparkSession.sparkContext
    for _ in range(rounds):
        votes = both.join(lab.select(F.col("id").alias("nbr"), "community"), "nbr").select("id", "community", "weight").unionByName(own.join(lab, "id").select("id", "community", F.col("w").alias("weight")))
        s = votes.groupBy("id", "community").agg(F.sum("weight").alias("s"))
        lab = s.groupBy("id").agg(F.min_by("community", F.struct(-F.col("s"), F.col("community"))).alias("community"))
        if sc.getCheckpointDir():
            lab = lab.checkpoint()
    return lab


def betweenness(edges: list[tuple[str, str, float]]) -> dict[str, float]:
    """Brandes with Dijkstra: weights are lengths; normalised for undirected graphs."""
    adj: dict = defaultdict(list)
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, pred, order = {}, defaultdict(float), defaultdict(list), []
        sigma[s] = 1.0
        seen, heap, tick = {s: 0.0}, [(0.0, 0, s)], counter(1)
        while heap:
            d, _, v = heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in adj[v]:
                nd = d + w
                if u not in dist and (u not in seen or nd < seen[u] - 1e-12):
                    seen[u], sigma[u], pred[u] = nd, sigma[v], [v]
                    heappush(heap, (nd, next(tick), u))
                elif u not in dist and abs(nd - seen[u]) <= 1e-12:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        delta: dict = defaultdict(float)
        for v in reversed(order):
            for u in pred[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    n = len(adj)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def communities(edges: DataFrame, labels: DataFrame, top: int = 8) -> DataFrame:
    """(community_id, size, top_entities): members by weighted degree inside the community."""
    deg = (
        ends(edges).join(labels.select("id", "community"), "id").join(labels.select(F.col("id").alias("nbr"), F.col("community").alias("c2")), "nbr")
        .groupBy("id", "community").agg(F.sum(F.when(F.col("community") == F.col("c2"), F.col("weight")).otherwise(0)).alias("d"))
    )
    n = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("d"), "id"))
    ranked = deg.withColumn("n", n)
    return ranked.groupBy(F.col("community").alias("community_id")).agg(
        F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.struct("n", "id")))), lambda x: x["id"]), ", ").alias("top_entities")
    )
