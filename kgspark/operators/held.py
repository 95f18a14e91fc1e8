"""Communities of graphs whose nodes, though not their edges, fit the memory of a task.

Nodes are numbered in the order of their ids. Edges lie in blocks on shared storage, each with all edges of its nodes as packed arrays; a round sends the state (a few
numbers a node) to the tasks, which go over their blocks and send back what changes. No round shuffles edges or joins them to anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.storage import cut, discard

#: Nodes up to which ids and state are sent to the tasks; edges in both directions that a block has about.
HELD_NODES, BLOCK_EDGES = 4_000_000, 500_000
LOOKUP_ROWS = 1_000_000
MOVE_ROUNDS, STILL = 24, 200


def ids_of(und: DataFrame, most: int = HELD_NODES) -> pa.Array | None:
    """The sorted ids of all ends, or nothing where there are more than ``most``."""
    ids = cut(und.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "ids")
    out = None
    if ids.count() <= most:
        found = ids.toArrow()["id"].combine_chunks()
        out = found.take(pc.array_sort_indices(found))
    discard(ids)
    return out


def _joined(batches: Iterator[pa.RecordBatch], rows: int = LOOKUP_ROWS) -> Iterator[pa.Table]:
    """Batches put together: each lookup of ids hashes all that are known."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) >= rows:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def numbered(und: DataFrame, ids: pa.Array, group: np.ndarray | None = None) -> DataFrame:
    """(u, v, w) of the edges with their ends as numbers; with ``group`` only those inside one group that isn't negative."""
    sent = und.sparkSession.sparkContext.broadcast((ids, group))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, g = sent.value
        for t in _joined(batches):
            u, v = (pc.index_in(t[c], value_set=known).to_numpy().astype("int32") for c in ("src", "dst"))
            w = t["weight"].to_numpy()
            if g is not None:
                at = (g[u] == g[v]) & (g[u] >= 0)
                u, v, w = u[at], v[at], w[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(w)], ["u", "v", "w"])

    return cut(und.select("src", "dst", F.col("weight").cast("double").alias("weight")).mapInArrow(work, "u int, v int, w double"), "numbered")


def blocks_of(edges: DataFrame, count: int) -> DataFrame:
    """One row a block: nodes, how many edges each has, their other ends and weights. A loop is there once."""
    n = max(1, -(-2 * count // BLOCK_EDGES))
    both = edges.unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).withColumn("block", F.pmod(F.xxhash64("u"), F.lit(n)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        u, v, w = (t[c].to_numpy() for c in "uvw")
        order = np.lexsort((v, u))
        nodes, counts = np.unique(u, return_counts=True)
        cells = [nodes.astype("int32"), counts.astype("int32"), v[order].astype("int32"), w[order]]
        return pa.table({k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("nodes", "counts", "ends", "weights"), cells, strict=True)})

    return cut(both.groupBy("block").applyInArrow(pack, "nodes binary, counts binary, ends binary, weights binary"), "blocks")


def over(blocks: DataFrame, f: Callable, schema: str, *state) -> DataFrame:
    """Rows of ``f(state, nodes, counts, ends, weights)``, a tuple of arrays a block."""
    sent = blocks.sparkSession.sparkContext.broadcast(state)
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                cells = [np.frombuffer(b[c][row].as_buffer(), d) for c, d in (("nodes", "int32"), ("counts", "int32"), ("ends", "int32"), ("weights", "float64"))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in f(sent.value, *cells)], names)

    out = blocks.mapInArrow(work, schema)
    out._kg_sent = sent
    return out


def now(blocks: DataFrame, f: Callable, schema: str, *state) -> pa.Table:
    """What ``over`` gives, on the driver; the state is let go."""
    df = over(blocks, f, schema, *state)
    out = df.toArrow()
    df._kg_sent.destroy()
    return out


def _draw(v: np.ndarray, seed: int, r: int) -> np.ndarray:
    """A hashed half of the nodes, drawn anew each round."""
    x = v.astype("uint64") + np.uint64(((seed * 1_000_003 + r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & np.uint64(1) == 0


def _strengths(_, nodes, counts, ends, weights):
    src = np.repeat(np.arange(len(nodes)), counts)
    loop = nodes[src] == ends
    k = np.bincount(src, weights * np.where(loop, 2, 1), len(nodes))
    return nodes, k, np.bincount(src, np.where(loop, 1.0, 0.5), len(nodes))


def _best(state, nodes, counts, ends, weights):
    """Each drawn node and the community of highest gain next to it, if that is above the gain of staying; the least of equals."""
    c, k, big, total, active, gamma, seed, r = state
    n = len(c)
    goes = active[nodes] & _draw(nodes, seed, r)
    src = np.repeat(np.arange(len(nodes)), counts)
    at = goes[src] & (nodes[src] != ends)
    own = np.flatnonzero(goes)
    key = np.concatenate([src[at] * n + c[ends[at]], own * n + c[nodes[own]]])
    if not len(key):
        return np.empty(0, "int32"), np.empty(0, "int32")
    order = np.argsort(key, kind="stable")
    key, w = key[order], np.concatenate([weights[at], np.zeros(len(own))])[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    w, key = np.add.reduceat(w, first), key[first]
    who, com = key // n, key % n
    v = nodes[who]
    stays = c[v] == com
    gain = w - gamma * k[v] * (big[com] - np.where(stays, k[v], 0.0)) / total[v]
    start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    top = np.maximum.reduceat(gain, start)
    place = np.cumsum(np.r_[True, who[1:] != who[:-1]]) - 1
    is_top = np.flatnonzero(gain == top[place])
    best = is_top[np.unique(place[is_top], return_index=True)[1]]
    better = top > gain[stays] + 1e-12
    return v[best][better], com[best][better].astype("int32")


def local_moves(blocks: DataFrame, k: np.ndarray, group: np.ndarray, active: np.ndarray, gamma: float, seed: int) -> np.ndarray:
    """The community of each node, named by a node, by rounds of local moving as in ``communities._local_moves``; each group is a graph of its own."""
    n = len(k)
    total = np.bincount(group, k, n)[group]
    c = np.arange(n, dtype="int32")
    for r in range(MOVE_ROUNDS):
        got = now(blocks, _best, "v int, c int", c, k, np.bincount(c, k, n), total, active, gamma, seed, r)
        c[got["v"].to_numpy()] = got["c"].to_numpy()
        if got.num_rows * STILL < active.sum() and r:
            break
    return c


def _hooks(state, nodes, counts, ends, weights):
    c, root = state
    src = np.repeat(nodes, counts)
    at = c[src] == c[ends]
    a, b = root[src[at]], root[ends[at]]
    apart = a < b  # each edge is there in both directions
    order = np.lexsort((a[apart], b[apart]))
    low, high = a[apart][order], b[apart][order]
    first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.empty(0, int)
    return high[first], low[first]


def connected(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part within its ``c``: roots hook on to the least root next to them, then paths are shortened."""
    root = np.arange(len(c), dtype="int32")
    while True:
        got = now(blocks, _hooks, "high int, low int", c, root)
        if not got.num_rows:
            return root
        np.minimum.at(root, got["high"].to_numpy(), got["low"].to_numpy())
        while (root[root] != root).any():
            root = root[root]


def _merged(state, nodes, counts, ends, weights):
    (to,) = state
    src = np.repeat(nodes, counts)
    once = src <= ends
    a, b = to[src[once]], to[ends[once]]
    key = np.minimum(a, b).astype("int64") << 32 | np.maximum(a, b)
    found, at = np.unique(key, return_inverse=True)
    return (found >> 32).astype("int32"), (found & 0xFFFFFFFF).astype("int32"), np.bincount(at, weights[once], len(found))


def detect(edges: DataFrame, n: int, group: np.ndarray | None, local: Callable, gamma: float, seed: int, task_edges: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(community, has edges, blocks): of each of ``n`` nodes the community, named by its least node, and the blocks. Groups are connected components if none are given.

    A group of more than ``task_edges`` edges is coarsened level by level until it fits a task; ``local`` finishes each group in one.
    """
    spark: SparkSession = edges.sparkSession
    first = blocks = blocks_of(edges, edges.count())
    group = connected(blocks, np.zeros(n, "int32")) if group is None else group
    member, level, frozen, linked = np.arange(n), 0, np.zeros(n, bool), None
    while True:
        k, count = np.zeros(n), np.zeros(n)
        got = now(blocks, _strengths, "v int, k double, m double")
        k[got["v"].to_numpy()], count[got["v"].to_numpy()] = got["k"].to_numpy(), got["m"].to_numpy()
        linked = np.isin(np.arange(n), got["v"].to_numpy()) if linked is None else linked
        active = (np.bincount(group, count, n)[group] > task_edges) & ~frozen
        if not active.any():
            break
        part = connected(blocks, local_moves(blocks, k, group, active, gamma, seed + level))
        part = np.where(active, part, np.arange(n)).astype("int32")
        # a group in which nothing merges any more has its communities
        frozen |= active & (np.bincount(group, part != np.arange(n), n)[group] == 0)
        supers, to = np.unique(part, return_inverse=True)
        smaller = cut(over(blocks, _merged, "u int, v int, w double", to.astype("int32")).groupBy("u", "v").agg(F.sum("w").alias("w")), "level")
        if blocks is not first:
            discard(blocks)
        _, firsts = np.unique(group[supers], return_inverse=True)
        edges, blocks = smaller, blocks_of(smaller, smaller.count())
        member, frozen, group, n, level = to[member], frozen[supers], firsts, len(supers), level + 1
    sent = spark.sparkContext.broadcast((group, frozen))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, done = sent.value
        for b in batches:
            at = g[b["u"].to_numpy()]
            keep = pa.array(~done[b["u"].to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), b["u"], b["v"], b["w"]], ["root", "src", "dst", "weight"]).filter(keep)

    rows = edges.mapInArrow(tagged, "root int, src int, dst int, weight double")
    found = rows.groupBy("root").applyInPandas(lambda g: local(g, gamma, seed), "id int, rep int").toArrow()
    rep = np.arange(n)
    rep[found["id"].to_numpy()] = found["rep"].to_numpy()
    names = pd.factorize(rep[member])[0]  # by first appearance, so that each community has its least node's place
    least = np.unique(names, return_index=True)[1]
    return least[names], linked, first


def _ties(state, nodes, counts, ends, weights):
    rep, small = state
    src = np.repeat(nodes, counts)
    at = small[src] & (rep[src] != rep[ends])
    key, n = np.unique(rep[src[at]].astype("int64") << 32 | rep[ends[at]], return_counts=True)
    return (key >> 32).astype("int32"), (key & 0xFFFFFFFF).astype("int32"), n


def absorb(blocks: DataFrame, rep: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Parts of fewer than ``least`` nodes join the part most of their edges lead to, the least of equals, else the largest other one of their group."""
    n = len(rep)
    size = np.bincount(rep, minlength=n)
    size[rep[group < 0]] = least  # outside of all groups, alone
    small = (size < least)[rep]
    to = np.arange(n)
    if not small.any():
        return rep
    ties = over(blocks, _ties, "r int, other int, n long", rep, small).groupBy("r", "other").agg(F.sum("n").alias("n"))
    best = ties.groupBy("r").agg(F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("b")).select("r", "b.other").toArrow()
    to[best["r"].to_numpy()] = best["other"].to_numpy()
    roots = np.unique(rep)
    ranked = pd.DataFrame({"g": group[roots], "n": -size[roots], "r": roots}).sort_values(["g", "n", "r"])
    top = {g: x["r"].to_numpy()[:2] for g, x in ranked[ranked["g"] >= 0].groupby("g")}
    left = np.setdiff1d(np.unique(rep[small]), best["r"].to_numpy())
    for r in left:
        to[r] = next((x for x in top[group[r]] if x != r), r)
    return to[rep]
