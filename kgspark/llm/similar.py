"""Near duplicates by shingle similarity, on top of SimHash and covering masks.

Texts are near duplicates if the Jaccard similarity of their sets of 5-word shingles (A-Z lower-cased) is 0.8 or more. SimHash alone can't tell that with 64 bits:
such pairs differ in about 10 of them, and covering a radius of 10 takes 2,047 tables. So candidates come from two covering families:

1. SimHash over the same shingles, with the masks of ``simhash`` (radius 4): all pairs within 4 bits.
2. The same kind of masks over coordinates instead of bits: a text has REPEATS vectors of 7 minwise hashes. Coordinate i carries the vector i+1 of
   3 bits; for each of the 7 non-zero vectors v a table keeps the 4 coordinates i with <i+1, v> odd. A pair that differs in at most 2 of 7 coordinates
   collides in some table, by construction; at similarity 0.8 one of three vectors does so with probability 0.997, above that more.

What shares a bucket, or is linked by ``simhash``, is joined to clusters: these links say only who may be similar, none is a verdict. All pairs of a cluster
are then decided on whole shingle sets, by a search that skips pairs already connected, and groups are the connected components of what is similar enough.
A cluster over ``bucket_cap`` sets or BLOCK_BYTES goes in two steps. It is dealt into blocks, each searched alone, and one member of each group found goes on to
further rounds while these merge groups. Whatever is still apart then meets in a grid of blocks, in which every pair of sets of different groups shares a cell;
so a task's work and memory stay bounded and no pair is left out. The grid's work grows with the square of what is apart, which dissimilar sets in one
cluster make inevitable; the members of its largest group are not compared with each other.

Shingles are hashed to 32 bits in the exact check.

Edge cases: a text under 5 words has one shingle, all of it; texts without words are one group; a null text is an empty one; repeated rows are one
text; null ids are ids like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, map_texts
from kgspark.llm.simhash import LOWER, SEED, _runs, _signed, fold, links
from kgspark.operators.components import components

SHINGLE, SIMILARITY, REPEATS, BUCKET_CAP, BLOCK_BYTES = 5, 0.8, 3, 512, 32 << 20
CODES = 7 * REPEATS
#: Odd multipliers of the minwise hashes, from a fixed generator.
FACTORS = np.random.default_rng(SEED).integers(1 << 62, (1 << 63) - 1, CODES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which 4 of 7 coordinates each of the 7 tables keeps.
KEPT = [[i for i in range(7) if ((i + 1) & v).bit_count() % 2] for v in range(1, 8)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)] if len(words) >= shingle else [digest(joined, SEED)], np.uint64)


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(CODES, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 2048):
        x = h[lo : lo + 2048, None] * FACTORS
        out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(axis=0))
    return out


def describe(text: str | None, shingle: int = SHINGLE) -> tuple[int, int, list[int], bytes]:
    """(set id, SimHash, table keys, sorted shingle set) of a text."""
    import xxhash

    h = shingle_hashes(text, shingle)
    unique = np.unique(h)
    least = minima(unique)
    keys = [_signed(xxhash.xxh64_intdigest(bytes((r, t)) + least[[7 * r + i for i in kept]].tobytes(), SEED)) for r in range(REPEATS) for t, kept in enumerate(KEPT)]
    return _signed(xxhash.xxh64_intdigest(unique.tobytes(), SEED)), _signed(fold(h)), keys, np.unique(unique.astype(np.uint32)).tobytes()


def _search(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (index, index) that connect exactly what chains of similar sets connect, and one index for each group. Sets of equal labels are connected already."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(ids) and int(ids.max()) + 1, bool)
    left = np.arange(len(sets))
    found, roots = [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        root = front[0]
        roots.append(root)
        while front and len(left):
            f = front.pop()
            same = labels[left] == labels[f]
            front += left[same].tolist()
            left = left[~same]
            fit = left[(sizes[left] >= similarity * sizes[f]) & (sizes[f] >= similarity * sizes[left])]
            if not len(fit):
                continue
            mark[own[f]] = True
            sums = np.concatenate(([0], np.cumsum(mark[np.concatenate([own[i] for i in fit])])))
            mark[own[f]] = False
            ends = np.cumsum(sizes[fit])
            both = sums[ends] - sums[ends - sizes[fit]]
            near = fit[both >= similarity * (sizes[f] + sizes[fit] - both)]
            found += [(i, root) for i in near.tolist()]
            front += near.tolist()
            left = left[~np.isin(left, near)]
    return found, roots


def _searched(dealt: DataFrame, similarity: float, name: str) -> DataFrame:
    """A written table (c, u, v) of the links in each block of (c, block, large, u, label, shingles); where ``large``, v is null for one member of each group."""
    schema = pa.schema([("c", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def work(batches):
        for batch, cuts in _runs(batches, ["c", "block"]):
            at = lambda c, b=batch: b.column(b.schema.names.index(c))
            c, u, label, large = (at(x).to_numpy(zero_copy_only=False) for x in ("c", "u", "label", "large"))
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in at("shingles").slice(a, b - a)]
                found, roots = _search(sets, label[a:b], similarity)
                out += [(c[a], u[a + i], u[a + j]) for i, j in found]
                out += [(c[a], u[a + i], None) for i in roots] if large[a] else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return cut(dealt.repartition("c", "block").sortWithinPartitions("c", "block", "u").mapInArrow(work, "c bigint, u bigint, v bigint"), name)


def _blocks(n: str, size: str, bucket_cap: int):
    """Blocks that hold ``n`` sets of ``size`` bytes in all."""
    return F.ceil(F.greatest(F.col(n) / bucket_cap, F.col(size) / BLOCK_BYTES))


def _decided(members: DataFrame, similarity: float, bucket_cap: int) -> list[DataFrame]:
    """Tables (c, u, v) of links that connect exactly what chains of similar sets of one cluster connect; ``members`` is a written table (c, u, shingles)."""
    tables: list[DataFrame] = []
    rows, before, wide = members, None, None
    while True:
        sizes = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("size"))
        many = cut(sizes.select(F.col("c").alias("of"), _blocks("n", "size", bucket_cap).alias("blocks")).where("blocks > 1"), "blocks")
        wide = many if wide is None else wide
        part = F.coalesce(F.pmod(F.xxhash64("u", F.lit(len(tables))), F.col("blocks")), F.lit(0)).alias("block")
        dealt = rows.join(F.broadcast(many), F.col("c") == F.col("of"), "left").select("c", part, F.col("of").isNotNull().alias("large"), "u", F.col("u").alias("label"), "shingles")
        tables.append(_searched(dealt, similarity, "found"))
        roots = tables[-1].where("v is null").select(F.col("u").alias("root"))
        apart = roots.count()
        if not apart or (before is not None and 2 * apart > before):
            break
        before = apart
        rows = members.join(roots, F.col("u") == F.col("root"), "left_semi")
    if not wide.isEmpty():
        tables.append(_crossed(members, tables, wide, similarity, bucket_cap))
    return tables


def _crossed(members: DataFrame, tables: list[DataFrame], wide: DataFrame, similarity: float, bucket_cap: int) -> DataFrame:
    """Links between the groups of wide clusters: every pair of sets of two groups shares a cell of a grid of blocks."""
    links_ = tables[0]
    for t in tables[1:]:
        links_ = links_.unionByName(t)
    links_ = links_.where("v is not null").join(F.broadcast(wide.select("of")), F.col("c") == F.col("of"), "left_semi").select("u", "v")
    roots = components(links_)
    kept = members.join(F.broadcast(wide.select("of")), F.col("c") == F.col("of"), "left_semi")
    named = cut(kept.join(roots, F.col("u") == F.col("node"), "left").select("c", "u", F.coalesce("root", "u").alias("label"), "shingles"), "named")
    counted = named.groupBy("c", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("size"))
    total = counted.groupBy("c").agg(F.max(F.struct("n", "size", "label")).alias("x"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    total = total.select(F.col("c").alias("of"), F.col("x.label").alias("top"), F.col("x.n").alias("n"), F.col("x.size").alias("size"), (F.col("n") - F.col("x.n")).alias("m"), (F.col("size") - F.col("x.size")).alias("rest")).where("m > 0")
    total = cut(total.select("of", "top", _blocks("n", "size", bucket_cap).alias("a"), _blocks("m", "rest", bucket_cap).alias("b")), "grids")
    # cells: of two blocks of the others (0), or of one of theirs and one of the largest group (1)
    cells = F.expr("""explode(if(label = top, transform(sequence(0L, b - 1), i -> xxhash64(1, i, pmod(xxhash64(u), a))), concat(
        transform(sequence(0L, b - 1), i -> xxhash64(0, least(i, pmod(xxhash64(u), b)), greatest(i, pmod(xxhash64(u), b)))),
        transform(sequence(0L, a - 1), i -> xxhash64(1, pmod(xxhash64(u), b), i)))))""")
    dealt = named.join(F.broadcast(total), F.col("c") == F.col("of")).select("c", cells.alias("block"), F.lit(False).alias("large"), "u", "label", "shingles")
    found = _searched(dealt, similarity, "crossed")
    discard(named)
    return found


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (text hash), ``fp`` (SimHash), ``root`` (what names its group)."""
    fields = {"u": ("bigint", pa.int64()), "fp": ("bigint", pa.int64()), "keys": ("array<bigint>", pa.list_(pa.int64())), "shingles": ("binary", pa.binary())}
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    prints = cut(map_texts(keyed, "text", fields, lambda: lambda texts: list(zip(*(describe(t, shingle) for t in texts), strict=True)) or [[] for _ in fields]), "described")
    units = cut(prints.groupBy("u").agg(*[F.first(c).alias(c) for c in ("fp", "keys")]), "units")
    # SimHash links hold between fingerprints: the least set of each stands for it
    by_print = cut(units.groupBy("fp").agg(F.min("u").alias("m")), "prints")
    near = links(by_print, "fp").withColumnsRenamed({"u": "p", "v": "q"})
    p, q = by_print.select(F.col("fp").alias("p1"), F.col("m").alias("u")), by_print.select(F.col("fp").alias("q1"), F.col("m").alias("v"))
    pairs = near.join(p, F.col("p") == F.col("p1")).join(q, F.col("q") == F.col("q1")).select("u", "v")
    same = units.select("fp", "u").join(p.withColumnRenamed("u", "v"), F.col("fp") == F.col("p1")).where("u <> v").select("u", "v")
    rows = units.select("u", F.explode("keys").alias("k"))
    buckets = cut(rows.groupBy("k").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("k", "key"), "buckets")
    shared = rows.join(buckets, F.col("k") == F.col("key")).where("u <> v").select("u", "v")
    clusters = cut(components(pairs.unionByName(same).unionByName(shared)).withColumnRenamed("root", "c"), "clusters")
    discard(by_print, units, buckets)
    # copies of one text shrink to one row before they are shuffled
    sets = prints.groupBy("u").agg(F.first("shingles").alias("shingles"))
    members = cut(sets.join(clusters, F.col("u") == F.col("node")).select("c", "u", "shingles"), "members")
    tables = _decided(members, similarity, bucket_cap)
    edges = tables[0]
    for t in tables[1:]:
        edges = edges.unionByName(t)
    found = cut(components(edges.where("v is not null").select("u", "v")).withColumnRenamed("root", "r"), "groups")
    discard(clusters, members, *tables)
    return prints.join(found, F.col("u") == F.col("node"), "left").select("doc_id", "th", "fp", F.coalesce("r", "u").alias("root"))
