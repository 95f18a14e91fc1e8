"""Communities by modularity with a resolution: components too large for a task are coarsened over the cluster, then Leiden finishes each in one task."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.operators import held
from kgspark.operators.components import components
from kgspark.operators.graph import merge_small, modularity, undirected
from kgspark.operators.storage import cut, discard

RESOLUTIONS, RUNS, MIN_SIZE, SEED, TASK_EDGES = (0.5, 0.75, 1.0, 1.25, 1.5), 10, 3, 42, 2_000_000
MOVE_ROUNDS, STILL = 24, 200


def _strengths(adj: list[dict[int, float]], loops: list[float]) -> list[float]:
    return [sum(a.values()) + 2 * x for a, x in zip(adj, loops, strict=True)]


def _move(adj, strength, total, part, gamma, rnd) -> bool:
    """Queue-driven local moving: each node goes to the neighbouring community of highest gain; nodes around a moved one are looked at again."""
    weight = defaultdict(float)
    for v, c in enumerate(part):
        weight[c] += strength[v]
    queue = list(range(len(adj)))
    rnd.shuffle(queue)
    waiting, moved, at = set(queue), False, 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting.discard(v)
        links = defaultdict(float)
        for u, w in adj[v].items():
            links[part[u]] += w
        own = part[v]
        weight[own] -= strength[v]
        best, gain = own, links[own] - gamma * strength[v] * weight[own] / total
        for c in sorted(links):
            g = links[c] - gamma * strength[v] * weight[c] / total
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:
            best = max(weight) + 1
        weight[best] += strength[v]
        if best != own:
            part[v], moved = best, True
            for u in adj[v]:
                if part[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return moved


def _refine(adj, strength, total, part, gamma, rnd) -> list[int]:
    """Within each community singletons merge into well-connected parts only, so that every part stays connected."""
    sub = list(range(len(adj)))
    size, inside = list(strength), [0.0] * len(adj)
    whole = defaultdict(float)
    for v, c in enumerate(part):
        whole[c] += strength[v]
    cut_ = [sum(w for u, w in adj[v].items() if part[u] == part[v]) for v in range(len(adj))]
    order = list(range(len(adj)))
    rnd.shuffle(order)
    alone = [True] * len(adj)
    for v in order:
        c = part[v]
        if not alone[v] or cut_[v] < gamma * strength[v] * (whole[c] - strength[v]) / total - 1e-12:
            continue
        links = defaultdict(float)
        for u, w in adj[v].items():
            if part[u] == c:
                links[sub[u]] += w
        best, gain = v, 0.0
        for s in sorted(links):
            if s == v or cut_[s] < gamma * size[s] * (whole[c] - size[s]) / total - 1e-12:
                continue
            g = links[s] - gamma * strength[v] * size[s] / total
            if g > gain + 1e-12:
                best, gain = s, g
        if best != v:
            cut_[best] += cut_[v] - 2 * links[best]
            size[best] += strength[v]
            sub[v] = best
            alone[best] = alone[v] = False
    return sub


def leiden(edges: list[tuple[int, int, float]], n: int, gamma: float = 1.0, seed: int = SEED) -> list[int]:
    """Communities of an undirected weighted graph by local moving, refinement and aggregation until nothing moves."""
    rnd = random.Random(seed)
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    loops = [0.0] * n
    for u, v, w in edges:
        if u == v:
            loops[u] += w
        else:
            adj[u][v] = adj[u].get(v, 0.0) + w
            adj[v][u] = adj[v].get(u, 0.0) + w
    total = sum(_strengths(adj, loops))
    member, part = list(range(n)), list(range(n))
    if total <= 0:
        return member
    for _ in range(50):
        strength = _strengths(adj, loops)
        moved = _move(adj, strength, total, part, gamma, rnd)
        if not moved or len(set(part)) == len(adj):
            break
        sub = _refine(adj, strength, total, part, gamma, rnd)
        ids = {s: i for i, s in enumerate(dict.fromkeys(sub))}
        size = len(ids)
        new_adj: list[dict[int, float]] = [{} for _ in range(size)]
        new_loops, new_part = [0.0] * size, [0] * size
        for v, a in enumerate(adj):
            i = ids[sub[v]]
            new_loops[i] += loops[v]
            new_part[i] = part[v]
            for u, w in a.items():
                j = ids[sub[u]]
                if i == j:
                    new_loops[i] += w / 2
                else:
                    new_adj[i][j] = new_adj[i].get(j, 0.0) + w
        member = [ids[sub[m]] for m in member]
        done = size == len(adj)
        adj, loops, part = new_adj, new_loops, new_part
        if done:
            break
    return [part[m] for m in member]


def _local(g: pd.DataFrame, gamma: float, seed: int) -> pd.DataFrame:
    ids = sorted({*g["src"], *g["dst"]})
    index = {x: i for i, x in enumerate(ids)}
    g = g.sort_values(["src", "dst"])
    part = leiden([(index[a], index[b], float(w)) for a, b, w in zip(g["src"], g["dst"], g["weight"], strict=True)], len(ids), gamma, seed)
    least: dict[int, object] = {}
    for x, c in zip(ids, part, strict=True):
        least.setdefault(c, x)
    return pd.DataFrame({"id": ids, "rep": [least[c] for c in part]})


def propagate(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, rep) by synchronous label propagation over summed weights, for ``rounds`` rounds or until labels stay. A cheaper partition on its own; nothing falls back to it."""
    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "both")
    labels = cut(both.select(F.col("src").alias("id"), F.col("src").alias("rep")).distinct(), "labels")
    last = None
    for k in range(rounds):
        votes = both.join(labels, both.dst == labels.id).groupBy("src", "rep").agg(F.sum("weight").alias("w"))
        # half of the nodes, by hash, move in a round, so that two of them can't swap for ever
        won = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "rep")).alias("b")).select(F.col("src").alias("_i"), F.col("b.rep").alias("_r"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        new = cut(labels.join(won, labels.id == won._i).select("id", F.when(moves, F.col("_r")).otherwise(F.col("rep")).alias("rep")), "labels")
        discard(labels)
        labels = new
        mark = labels.agg(F.sum(F.xxhash64("id", "rep").cast("decimal(38,0)"))).first()[0]
        if mark == last:
            break
        last = mark
    discard(both)
    return labels


def _local_moves(both: DataFrame, gamma: float, seed: int, rounds: int = MOVE_ROUNDS) -> DataFrame:
    """(id, rep): local moving over the cluster. ``both`` has each edge in both directions; loops appear once, as (v, v).

    In a round a hashed half of the nodes looks at the communities next to it and goes to that of highest gain, w(v, c) - gamma * k(v) * K(c) / 2m; the halves are drawn
    anew each round, so two nodes don't swap for ever. Rounds end when fewer than one node in STILL moves.
    """
    nodes = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight"))).alias("k")), "strengths")
    total = nodes.agg(F.sum("k")).first()[0]
    state = cut(nodes.select("id", "k", F.col("id").alias("c")), "state")
    n = state.count()
    for r in range(rounds):
        to = state.select(F.col("id").alias("t"), F.col("c").alias("next"))
        links = both.where("src <> dst").join(to, F.col("dst") == F.col("t")).groupBy(F.col("src").alias("v"), "next").agg(F.sum("weight").alias("w"))
        weights = state.groupBy(F.col("c").alias("of")).agg(F.sum("k").alias("big"))
        # a node's own community is a choice too, also where no neighbour of it is left there
        mine = state.select("id", "k", "c")
        offers = links.unionByName(mine.select(F.col("id").alias("v"), F.col("c").alias("next"), F.lit(0.0).alias("w"))).groupBy("v", "next").agg(F.sum("w").alias("w"))
        scored = offers.join(mine, F.col("v") == F.col("id")).join(weights, F.col("next") == F.col("of"))
        gain = F.col("w") - F.lit(gamma) * F.col("k") * (F.col("big") - F.when(F.col("next") == F.col("c"), F.col("k")).otherwise(0.0)) / F.lit(total)
        best = scored.groupBy("id", "k", "c").agg(F.max(F.when(F.col("next") == F.col("c"), gain)).alias("stay"), F.min(F.struct((-gain).alias("g"), "next")).alias("b"))
        goes = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(2)) == 0) & (-F.col("b.g") > F.col("stay") + 1e-12)
        new = cut(best.select("id", "k", F.when(goes, F.col("b.next")).otherwise(F.col("c")).alias("c"), goes.alias("moved")), "state")
        discard(state)
        state = new
        if new.where("moved").count() * STILL < n and r:
            break
    discard(nodes)
    return state.select("id", F.col("c").alias("rep"))


def coarsen(edges: DataFrame, gamma: float, seed: int, task_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(members (id, super), edges between supers) of a graph of undirected edges, level by level until ``task_edges`` edges are left; no edges where nothing merges any more.

    Communities of local moving are cut into their connected parts before they become nodes of the next level. A super node is named by its least id.
    """
    members, level = None, 0
    while edges.count() > task_edges:
        both = cut(edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "both")
        moved = _local_moves(both, gamma, seed + level)
        a, b = moved.select(F.col("id").alias("x"), F.col("rep").alias("cx")), moved.select(F.col("id").alias("y"), F.col("rep").alias("cy"))
        inner = edges.where("src <> dst").join(a, F.col("src") == F.col("x")).join(b, (F.col("dst") == F.col("y")) & (F.col("cx") == F.col("cy")))
        parts = components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        step = cut(moved.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("super")), "supers")
        s, t = step.select(F.col("id").alias("x"), F.col("super").alias("sx")), step.select(F.col("id").alias("y"), F.col("super").alias("sy"))
        joined = edges.join(s, F.col("src") == F.col("x")).join(t, F.col("dst") == F.col("y"))
        smaller = cut(joined.groupBy(F.least("sx", "sy").alias("src"), F.greatest("sx", "sy").alias("dst")).agg(F.sum("weight").alias("weight")), "level")
        members = step if members is None else cut(members.join(step.select(F.col("id").alias("was"), F.col("super").alias("now")), F.col("super") == F.col("was")).select("id", F.col("now").alias("super")), "members")
        discard(both)
        if step.where("id <> super").isEmpty():  # no move gains anything: these are the communities
            return members, None
        edges, level = smaller, level + 1
    return members, edges


def detect(edges: DataFrame, gamma: float = 1.0, seed: int = SEED, task_edges: int = TASK_EDGES, held_nodes: int = held.HELD_NODES) -> DataFrame:
    """(id, rep) for the nodes with edges: Leiden by component. One objective, with ``gamma``, at every size: a component of more than ``task_edges`` edges is
    coarsened over the cluster until it fits a task, as Leiden's own first levels would. Up to ``held_nodes`` nodes the rounds send the nodes' state to the edges
    (``held``); beyond, they join edges and state, by the same rules."""
    return _detect(cut(undirected(edges), "undirected"), gamma, seed, task_edges, held_nodes)


def _detect(und: DataFrame, gamma: float, seed: int, task_edges: int = TASK_EDGES, held_nodes: int = held.HELD_NODES) -> DataFrame:
    kind = dict(und.dtypes)["src"]
    ids = held.ids_of(und, held_nodes)
    if ids is not None:
        rep, _, _ = held.detect(held.numbered(und, ids), len(ids), None, _local, gamma, seed, task_edges)
        return cut(und.sparkSession.createDataFrame(pa.table({"id": ids, "rep": ids.take(pa.array(rep))})), "found")
    roots = cut(components(und.select(F.col("src").alias("u"), F.col("dst").alias("v"))), "roots")
    tagged = und.join(roots, und.src == roots.node).select("root", "src", "dst", "weight")
    sizes = cut(tagged.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    leiden_of = lambda rows: rows.groupBy("root").applyInPandas(lambda g: _local(g, gamma, seed), f"id {kind}, rep {kind}")
    small = leiden_of(tagged.join(sizes.where(F.col("n") <= task_edges), "root"))
    large = [r.root for r in sizes.where(F.col("n") > task_edges).select("root").collect()]  # few: each has more edges than a task holds
    for root in large:
        members, coarse = coarsen(tagged.where(F.col("root") == root).select("src", "dst", "weight"), gamma, seed, task_edges)
        if coarse is None:
            small = small.unionByName(members.select("id", F.col("super").alias("rep")))
            continue
        top = leiden_of(coarse.withColumn("root", F.lit(root)))
        found = members.join(top.select(F.col("id").alias("s"), "rep"), F.col("super") == F.col("s")).select("id", "rep")
        small = small.unionByName(found)
    return small


def number(labelled: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by size, then least id. One row a community goes through the window."""
    by = labelled.groupBy("rep").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    ranked = by.select(F.col("rep").alias("_r"), (F.row_number().over(W.orderBy(F.desc("n"), "least")) - 1).alias("community"))
    return labelled.join(ranked, labelled.rep == ranked._r).select("id", "community")


def partition(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = SEED) -> DataFrame:
    """(id, community) of all ``nodes``; isolated ones are communities of their own, and so a tiny graph (under 3 nodes or no edge) is one community."""
    und = cut(undirected(edges), "undirected")
    if nodes.limit(3).count() < 3 or und.isEmpty():
        return nodes.select("id", F.lit(0).alias("community"))
    found = _detect(und, gamma, seed)
    alone = nodes.select("id").join(found.select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left_anti")
    return number(found.unionByName(alone.select("id", F.col("id").alias("rep"))))


def search(nodes: DataFrame, edges: DataFrame, resolutions=RESOLUTIONS, runs: int = RUNS, least: int = MIN_SIZE, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """The partition of highest directed modularity over resolutions and seeds, small communities merged; first of equals wins. Also one row of figures a cell."""
    und = cut(edges.select("src", "dst", "weight"), "edges")
    best, rows = None, []
    for i, gamma in enumerate(resolutions):
        for k in range(runs):
            found = cut(merge_small(cut(partition(nodes, und, gamma, seed + k), "found"), und, least), "merged")
            q = modularity(und, found).first()[0]
            rows.append({"resolution": gamma, "run": k, "modularity": q})
            if best is None or q > best[0] + 1e-12:
                best = (q, i, k, found)
    return best[3], rows


def search_grid(edges: DataFrame, resolutions=RESOLUTIONS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """(resolution, run, id, rep): all cells of the grid at once, one task a cell. For graphs that fit a task; the edges are sent to each cell."""
    kind = dict(edges.dtypes)["src"]
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("resolution"), F.lit(k).alias("run")) for g in resolutions for k in range(runs)]))
    grid = undirected(edges).select("src", "dst", "weight", cells.alias("cell")).select("cell.*", "src", "dst", "weight")

    def work(key, g: pd.DataFrame) -> pd.DataFrame:
        return _local(g, float(key[0]), seed + int(key[1])).assign(resolution=key[0], run=key[1])

    return grid.groupBy("resolution", "run").applyInPandas(work, f"resolution double, run int, id {kind}, rep {kind}")


def subcommunities(edges: DataFrame, assignments: DataFrame, min_sub: int = 2, seed: int = SEED, task_edges: int = TASK_EDGES, held_nodes: int = held.HELD_NODES) -> DataFrame:
    """(id, community, sub_id) inside communities of max(2 min_sub, 4) nodes or more that have edges and fall into two parts or more.

    A community of more than ``task_edges`` edges is coarsened first, as in ``detect``; beyond ``held_nodes`` nodes each community is one task, however large.
    """
    und = cut(undirected(edges.select("src", "dst", "weight")), "undirected")
    kind = dict(assignments.dtypes)["id"]
    sizes = assignments.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= max(2 * min_sub, 4))
    ids = held.ids_of(und, held_nodes)
    if ids is not None:
        found = _held_parts(und, ids, assignments.join(sizes.select("community"), "community"), min_sub, seed, task_edges)
        return _sub_ids(und.sparkSession.createDataFrame(found, f"id {kind}, community bigint, rep {kind}") if not found.num_rows else cut(und.sparkSession.createDataFrame(found), "parts"))
    a, b = assignments.select(F.col("id").alias("_a"), "community"), assignments.select(F.col("id").alias("_b"), F.col("community").alias("_c"))
    inner = und.join(a, F.col("src") == F.col("_a")).join(b, (F.col("dst") == F.col("_b")) & (F.col("community") == F.col("_c"))).select("community", "src", "dst", "weight").join(sizes.select("community"), "community")

    def work(key, g: pd.DataFrame) -> pd.DataFrame:
        out = _local(g, 1.0, seed)
        rep = dict(zip(out["id"], out["rep"], strict=True))
        size = Counter(rep.values())
        ties: dict = defaultdict(Counter)
        for s, t in zip(g["src"], g["dst"], strict=True):
            if rep[s] != rep[t]:
                ties[rep[s]][rep[t]] += 1
                ties[rep[t]][rep[s]] += 1
        largest = sorted(size, key=lambda r: (-size[r], r))
        to = {r: r for r in size}
        for r in size if len(size) > 1 else ():
            if size[r] < min_sub:
                to[r] = min(ties[r], key=lambda x: (-ties[r][x], x)) if ties[r] else next(x for x in largest if x != r)
        ids = list(rep) if len({*to.values()}) > 1 else []
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "community": pd.Series([int(key[0])] * len(ids), dtype="int64"), "rep": pd.Series([to[rep[i]] for i in ids], dtype=object)})

    return _sub_ids(inner.groupBy("community").applyInPandas(work, f"id {kind}, community bigint, rep {kind}"))


def _held_parts(und: DataFrame, ids: pa.Array, eligible: DataFrame, min_sub: int, seed: int, task_edges: int) -> pa.Table:
    """(id, community, rep) of the nodes with edges inside eligible communities that fall into two parts or more."""
    rows = eligible.select("id", F.col("community").cast("bigint").alias("community")).toArrow()
    at = pc.index_in(rows["id"].combine_chunks().cast(ids.type), value_set=ids)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    names, codes = np.unique(rows["community"].to_numpy()[known], return_inverse=True)
    group = np.full(len(ids), -1)
    group[at.drop_null().to_numpy()] = codes
    edges = held.numbered(und, ids, group)
    rep, linked, blocks = held.detect(edges, len(ids), np.where(group < 0, len(names), group), _local, 1.0, seed, task_edges)
    group = np.where(linked, group, -1)
    rep = held.absorb(blocks, rep, group, min_sub)
    parts = pd.DataFrame({"g": group, "rep": rep, "v": np.arange(len(ids))})[group >= 0]
    parts = parts[parts.groupby("g")["rep"].transform("nunique") > 1]
    return pa.table({"id": ids.take(pa.array(parts["v"].to_numpy())), "community": pa.array(names[parts["g"].to_numpy()].astype("int64")), "rep": ids.take(pa.array(parts["rep"].to_numpy()))})


def _sub_ids(found: DataFrame) -> DataFrame:
    """Parts numbered within each community by their least id."""
    local = F.dense_rank().over(W.partitionBy("community").orderBy("first")) - 1
    firsts = found.groupBy("community", "rep").agg(F.min("id").alias("first"))
    numbered = firsts.select("community", "rep", local.alias("sub_id"))
    return found.join(numbered, ["community", "rep"]).select("id", "community", "sub_id")


def balanced_groups(assignments: DataFrame, size: int = 20) -> DataFrame:
    """(id, community, sub_id): communities cut into runs of about ``size`` members by id hash, without a window over a community."""
    n = assignments.groupBy("community").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("parts"))
    return assignments.join(n, "community").select("id", "community", F.pmod(F.xxhash64("id"), F.col("parts")).alias("sub_id"))
