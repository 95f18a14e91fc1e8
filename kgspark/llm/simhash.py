"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words split on ASCII white space, 4-word shingles with repeats, XXH64 (seed 42); a bit is 1 if set
in over half of the hashes.

Covering LSH (radius r): bit i carries a vector m(i) of r+1 bits. For each of the 2^(r+1)-1 non-zero vectors v there is one table,
which keeps the bits i with <m(i), v> odd. The differing bits of a pair within the radius span at most r dimensions, so
some v is orthogonal to all of them and the pair collides in that table: no pair is lost, by construction.

Only distinct fingerprints are hashed. A bucket of up to ``bucket_cap`` fingerprints is compared in blocks inside one task and gives
links that connect what is within the radius (a spanning set, not all pairs). A larger bucket goes another exact way:
every fingerprint emits the centres within r/2 of it (on the bits that the table drops); two fingerprints share a centre exactly if they are within
r (r is even here, odd radii are refused), so each centre's members are linked to the least of them. Work stays linear in the bucket's size.

Edge cases: null and empty texts have fingerprint zero, linked like any other; repeated rows share their component; a null
doc_id takes part but never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, map_texts
from kgspark.operators.components import components

SHINGLE, SEED, RADIUS, BUCKET_CAP = 4, 42, 4, 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)] if len(words) >= shingle else [digest(joined, SEED)]
    return fold(h)


def fold(h) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        part = np.array(h[lo : lo + 8192], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", keep_text: bool = False) -> DataFrame:
    """Add ``out``: the 64-bit fingerprint as a signed long."""
    return map_texts(docs, text, {out: ("bigint", pa.int64())}, lambda: lambda texts: [[_signed(fingerprint(t)) for t in texts]], keep_text)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering family: one mask of kept bits for each non-zero vector of radius+1 bits."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _runs(batches, key: list[str]):
    """Runs of equal keys over the sorted batches of a partition, as (batch, start, stop); a run that goes on is joined to the next batch."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in key:
            x = batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        last = int(cuts[-1]) if len(cuts) else 0
        held = batch.slice(last)
        if last:
            yield batch.slice(0, last), np.concatenate(([0], cuts[:-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0])


def _link_block(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (larger, smaller) that connect exactly what chains of distances up to ``radius`` connect: a breadth-first search by blocks of XORs."""
    left = np.unique(fps)
    out = []
    while len(left):
        front, left = left[:1], left[1:]
        root = int(front[0])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for lo in range(0, len(front), 256):
                near |= (np.bitwise_count(front[lo : lo + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            out += [(int(x), root) for x in front]
    return out


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(u, v) over distinct fingerprints: a set of links with the same connected components as all pairs within ``radius``."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    family = [_signed(m) for m in masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("m")) for t, m in enumerate(family)]))
    hashed = distinct.select(F.col(fp).alias("fp")).select("fp", tables.alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k"), "fp")
    counted = cut(hashed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = hashed.join(counted.where(F.col("n") <= bucket_cap).drop("n"), ["t", "k"])
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def within(batches):
        for batch, cuts in _runs(batches, ["t", "k"]):
            fps = batch.column(batch.schema.names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
            found = []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if b - a > 1:
                    found += _link_block(fps[a:b], radius)
            if found:
                both = np.unique(np.array(found, dtype=np.uint64), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=edge)

    found = shared.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(within, "u bigint, v bigint")
    large = counted.where(F.col("n") > bucket_cap).drop("n")
    if large.isEmpty():
        return found.distinct()

    kept = masks(radius)

    def centres(batches):
        half = radius // 2
        balls: dict[int, np.ndarray] = {}
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            k = batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(2).to_numpy(zero_copy_only=False)
            for i in np.unique(t).tolist():
                if i not in balls:
                    free = [b for b in range(64) if not kept[i] >> b & 1]
                    balls[i] = np.array([sum(1 << b for b in c) for d in range(half + 1) for c in combinations(free, d)], dtype=np.uint64)
                at = np.flatnonzero(t == i)
                for lo in range(0, len(at), 128):
                    some = at[lo : lo + 128]
                    z = (fps[some].view(np.uint64)[:, None] ^ balls[i][None, :]).view(np.int64)
                    m = balls[i].size
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t[some], m)), pa.array(np.repeat(k[some], m)), pa.array(z.ravel()), pa.array(np.repeat(fps[some], m))], names=["t", "k", "z", "fp"])

    def stars(batches):
        for batch, cuts in _runs(batches, ["t", "z"]):
            fps = batch.column(batch.schema.names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.append(cuts[1:], batch.num_rows)
            root = np.repeat(np.minimum.reduceat(fps, cuts), ends - cuts)
            other = fps != root
            both = np.unique(np.stack([fps[other], root[other]], axis=1), axis=0).view(np.int64)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=edge)

    near = hashed.join(large, ["t", "k"]).select("t", "k", "fp").mapInArrow(centres, "t int, k bigint, z bigint, fp bigint")
    around = near.select("t", "z", "fp").repartition("t", "z").sortWithinPartitions("t", "z").mapInArrow(stars, "u bigint, v bigint")
    return found.unionByName(around).distinct()


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (text hash), ``fp``, ``root`` (the fingerprint that names the group, whatever its ids) and ``component_id`` (the least doc_id that links reach)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    prints = cut(fingerprints(keyed), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(distinct, "fp", radius, bucket_cap)
    roots = components(edges)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_print = cut(rooted.join(named, "root").select(F.col("fp").alias("own"), "root", "component_id"), "by_print")
    for x in (rooted, named, distinct):
        discard(x)
    return prints.join(by_print, prints.fp == by_print.own).select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id`` (the least doc_id that links reach)."""
    return grouped(docs, text, doc_id, radius, bucket_cap).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
