"""Centralities. Degree, PageRank, eigenvector and Katz are joins; path-based ones shard their sources over tasks with a broadcast adjacency of checked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.storage import cut, discard

MAX_BROADCAST_EDGES = 5_000_000


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): degree over n-1, isolated nodes included."""
    n = nodes.count()
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return nodes.select("id").join(deg, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / max(n - 1, 1)).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(id, score) by power iteration; dangling mass is spread evenly. Each round is one join and one aggregate, written to shared storage."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total")).withColumnRenamed("src", "_s")
    shares = cut(e.join(out, e.src == out._s).select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
    rank = cut(nodes.select("id").join(out.select(F.col("_s").alias("_o")), F.col("id") == F.col("_o"), "left").select("id", F.col("_o").isNull().alias("dangling"), F.lit(1.0 / n).alias("score")), "rank")
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        got = shares.join(rank.select(F.col("id").alias("_i"), "score"), F.col("src") == F.col("_i")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = rank.join(got, rank.id == got.dst, "left").select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("new"), "score")
        new = cut(new, "rank")
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0]
        discard(rank)
        rank = new.select("id", "dangling", F.col("new").alias("score"))
        rank._kg_path = new._kg_path
        if change < tolerance * n:
            break
    discard(shares)
    return rank.select("id", "score")


def power_scores(nodes: DataFrame, edges: DataFrame, alpha: float | None = None, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(id, score) from in-neighbours: eigenvector centrality (``alpha`` null) or Katz with attenuation ``alpha`` and base 1; unit norm. Falls back on PageRank where it doesn't settle."""
    n = nodes.count()
    e = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")), "edges")
    score = cut(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("score")), "score")
    for _ in range(rounds):
        got = e.join(score.select(F.col("id").alias("_i"), "score"), F.col("src") == F.col("_i")).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        base = F.col("score") + F.coalesce("got", F.lit(0.0)) if alpha is None else F.lit(1.0) + alpha * F.coalesce("got", F.lit(0.0))
        raw = cut(score.join(got, score.id == got.dst, "left").select("id", "score", base.alias("raw")), "raw")
        norm = (raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0] or 0.0) ** 0.5 or 1.0
        new = raw.select("id", "score", (F.col("raw") / (norm if alpha is None else 1.0)).alias("new"))
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0] or 0.0
        discard(score)
        score = new.select("id", F.col("new").alias("score"))
        score._kg_path = raw._kg_path
        if change < n * tolerance:
            if alpha is None:
                return score
            norm = (score.agg(F.sum(F.col("score") * F.col("score"))).first()[0] or 0.0) ** 0.5 or 1.0
            return score.select("id", (F.col("score") / norm).alias("score"))
    return pagerank(nodes, edges)


def _brandes(n: int, starts: np.ndarray, targets: np.ndarray, costs: np.ndarray, sources: list[int], weighted: bool):
    """Partial betweenness and load over ``sources`` and, for each, (reached, total distance, total inverse distance) along out-edges.

    Load is the traffic of one packet from each node reached, which divides equally among the predecessors at every step; betweenness weighs them by their path counts.
    """
    import heapq

    between, loads, paths = np.zeros(n), np.zeros(n), []
    for s in sources:
        order, before, count, dist = [], [[] for _ in range(n)], np.zeros(n), np.full(n, np.inf)
        count[s], dist[s], done = 1.0, 0.0, np.zeros(n, bool)
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            order.append(v)
            for k in range(starts[v], starts[v + 1]):
                u, step = targets[k], costs[k] if weighted else 1.0
                far = d + step
                if far < dist[u] - 1e-12:
                    dist[u], count[u], before[u] = far, count[v], [v]
                    heapq.heappush(heap, (far, u))
                elif abs(far - dist[u]) <= 1e-12 and not done[u] and v not in before[u]:
                    count[u] += count[v]
                    before[u].append(v)
        delta, load = np.zeros(n), np.zeros(n)
        for v in reversed(order):
            for p in before[v]:
                delta[p] += count[p] / count[v] * (1 + delta[v])
                load[p] += (1 + load[v]) / len(before[v])
            if v != s:
                between[v] += delta[v]
                loads[v] += load[v]
        reach = dist[np.isfinite(dist) & (dist > 0)]
        paths.append((s, len(reach), float(reach.sum()), float((1 / reach).sum())))
    return between, loads, paths


def path_centralities(nodes: DataFrame, edges: DataFrame, weighted: bool = False, directed: bool = True, blocks: int = 64, max_edges: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """(id, betweenness, load, closeness, harmonic). Every task holds the adjacency, so its size is checked; sources are dealt in blocks.

    Distances are along in-edges for closeness and harmonic. Beyond ``max_edges`` this raises: path counts need the whole graph in reach of a task.
    """
    spark = nodes.sparkSession
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges: use degree, PageRank, eigenvector or Katz instead")
    listed = nodes.select("id").distinct()
    if listed.limit(2 * max_edges + 1).count() > 2 * max_edges:
        raise ValueError(f"more than {2 * max_edges} nodes: use degree, PageRank, eigenvector or Katz instead")
    ids = [r[0] for r in listed.orderBy("id").collect()]
    index = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    triples = [(index[r.src], index[r.dst], float(r.weight)) for r in edges.select("src", "dst", "weight").collect() if r.src in index and r.dst in index and r.src != r.dst]
    flip = [(b, a, w) for a, b, w in triples]
    triples = sorted(set(flip if directed else triples + flip))  # in-edges: from each node back to those that reach it
    heads = np.array([t[0] for t in triples], np.int64)
    starts = np.searchsorted(heads, np.arange(n + 1)) if n else np.zeros(1, np.int64)
    shared = spark.sparkContext.broadcast((n, starts, np.array([t[1] for t in triples], np.int64), np.array([t[2] for t in triples])))

    def work(batches):
        total, load, rows = None, None, []
        for b in batches:
            n_, s_, t_, c_ = shared.value
            part, loads, paths = _brandes(n_, s_, t_, c_, b["i"].tolist(), weighted)
            total, load = (part, loads) if total is None else (total + part, load + loads)
            rows += paths
        if total is not None:
            hit = np.flatnonzero((total != 0) | (load != 0))
            yield pd.DataFrame({"i": hit, "b": total[hit], "l": load[hit], "reach": 0, "far": 0.0, "near": 0.0})
            yield pd.DataFrame({"i": [r[0] for r in rows], "b": 0.0, "l": 0.0, "reach": [r[1] for r in rows], "far": [r[2] for r in rows], "near": [r[3] for r in rows]})

    parts = spark.range(n).withColumnRenamed("id", "i").repartition(blocks).mapInPandas(work, "i long, b double, l double, reach long, far double, near double")
    sums = parts.groupBy("i").agg(F.sum("b").alias("b"), F.sum("l").alias("l"), F.sum("reach").alias("reach"), F.sum("far").alias("far"), F.sum("near").alias("near"))
    pairs = (n - 1) * (n - 2) if n > 2 else 1
    close = F.when((F.col("far") > 0) & F.lit(n > 1), F.col("reach") / F.col("far") * (F.col("reach") / max(n - 1, 1))).otherwise(0.0)
    names = spark.createDataFrame(pd.DataFrame({"i": range(n), "id": ids}), f"i long, id {dict(nodes.dtypes)['id']}")
    return names.join(sums, "i", "left").select("id", (F.coalesce("b", F.lit(0.0)) / pairs).alias("betweenness"), (F.coalesce("l", F.lit(0.0)) / pairs).alias("load"), F.coalesce(close, F.lit(0.0)).alias("closeness"), F.coalesce("near", F.lit(0.0)).alias("harmonic"))


def current_flow(nodes: DataFrame, edges: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """(id, betweenness, closeness) by current flow on each undirected component, from the Laplacian's pseudo-inverse: dense, so components are bounded."""
    from kgspark.operators.components import components
    from kgspark.operators.graph import undirected

    und = undirected(edges)
    roots = components(und.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    kind = dict(nodes.dtypes)["id"]
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    if not sizes.where(F.col("n") > max_nodes).isEmpty():
        raise ValueError(f"a component has more than {max_nodes} nodes")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*g["src"], *g["dst"]})
        at = {x: i for i, x in enumerate(ids)}
        n = len(ids)
        lap = np.zeros((n, n))
        pairs = [(at[a], at[b], w) for a, b, w in zip(g["src"], g["dst"], g["weight"], strict=True) if a != b]
        for a, b, w in pairs:
            lap[a, a] += w
            lap[b, b] += w
            lap[a, b] -= w
            lap[b, a] -= w
        inv = np.linalg.pinv(lap)
        d = np.diag(inv)
        close = 1 / np.maximum((n * d + d.sum() - 2 * inv.sum(axis=1)), 1e-12)
        flow = np.zeros(n)
        for a, b, w in pairs:
            p = np.sort(w * (inv[a] - inv[b]))
            through = float((p * (2 * np.arange(1, n + 1) - n - 1)).sum())  # sum over s<t of |p_s - p_t|
            flow[a] += through / 2
            flow[b] += through / 2
        norm = (n - 1) * (n - 2) / 2 or 1.0
        return pd.DataFrame({"id": ids, "betweenness": np.maximum(0.0, flow - (n - 1) / 2) / norm if n > 2 else np.zeros(n), "closeness": close})

    return und.join(roots, und.src == roots.node).groupBy("root").applyInPandas(work, f"id {kind}, betweenness double, closeness double")


def long_form(scores: DataFrame, measures: list[str]) -> DataFrame:
    """(id, measure, score) from one column a measure."""
    pairs = ", ".join(f"'{m}', {m}" for m in measures)
    return scores.selectExpr("id", f"stack({len(measures)}, {pairs}) as (measure, score)")
