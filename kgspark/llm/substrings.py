"""Substring deduplication with suffix automata of reference shards.

A word goes if a window of ``size`` words of its document covers it whose words also start in a document with a smaller id. All documents are the
reference. An automaton of the whole corpus fits nowhere, so it is sharded so that equal windows always meet:

1. Each window is routed by its minimizer, the least hash of its ``k``-word parts. Minimizers that only one document has are left behind.
2. The windows of one minimizer position are one passage. Equal passages are merged, with their least document, before any shuffle.
3. A reference shard is the passages of a run of minimizers, up to ``shard_words`` words. Its suffix automaton is built once and its
   passages are streamed through it for matching statistics: every match of ``size`` words or more has the least document that holds it.
   A minimizer with very many passages (a common phrase in ever new contexts) is cut into single windows, which are dealt anew by their content.
4. Documents take back the windows whose least document is smaller than themselves; their union is the maximal spans to remove.

The set of repeated minimizers is broadcast if it has at most ``broadcast_keys`` entries; beyond that it is joined to the documents instead.

Edge cases: null and empty texts and texts under ``size`` words lose nothing; rows that share an id never remove each other's words; a null id neither loses
words nor makes others lose any; an empty table gives an empty result; memory is in proportion to one text and one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, sliced
from kgspark.llm.automaton import SuffixAutomaton

SIZE, K, SHARD_WORDS, HOT_PASSAGES, BROADCAST_KEYS, ROWS_OUT = 13, 5, 40_000, 200, 4_000_000, 20_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimizers(words: list[bytes], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the least k-gram of each window; the leftmost where several are equal."""
    import xxhash

    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        grams ^= grams >> np.uint64(29)
    wide = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1)
    first = wide.argmin(axis=1)
    return wide[np.arange(len(first)), first], np.arange(len(first)) + first


def _passages(text: str | None, size: int, k: int, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(minimizers, first windows, numbers of windows, passages) of the passages whose minimizer is ``known``."""
    words = words_of(text)
    g, p = minimizers(words, size, k)
    if not len(g):
        return g, p, p, []
    heads = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    stops = np.append(heads[1:], len(p))
    keep = known(g[heads])
    heads, stops = heads[keep], stops[keep]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return g[heads].view(np.int64), heads, stops - heads, [joined[x:y] for x, y in zip(starts[heads].tolist(), ends[stops + size - 2].tolist(), strict=True)]


def _known(keys: np.ndarray):
    def test(g: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(g), bool)
        at = np.searchsorted(keys, g)
        at[at == len(keys)] = 0
        return keys[at] == g

    return test


def _repeated(rows: DataFrame, size: int, k: int) -> DataFrame:
    """(doc, g): the distinct minimizers of each document."""

    def run(batches):
        docs, found, n = [], [], 0
        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.unique(minimizers(words_of(text), size, k)[0])
                docs.append(np.full(len(g), doc, np.int64))
                found.append(g.view(np.int64))
                n += len(g)
            if n >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(found))], names=["doc", "g"])
                docs, found, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(found))], names=["doc", "g"])

    return rows.select("doc", "text").mapInArrow(run, "doc bigint, g bigint")


def _merged(run, rows: int = 20_000):
    """Join the small batches that ``run`` yields, so that fewer cross to the JVM."""

    def joined(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


PASSAGE = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("g", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("passage", pa.binary())])
PASSAGE_DDL = "doc bigint, th bigint, g bigint, first int, windows int, passage binary"


def _candidates(rows: DataFrame, size: int, k: int, broadcast_keys: int) -> tuple[DataFrame, DataFrame]:
    """The passages of repeated minimizers, and the table of these that they are made from."""
    each = _repeated(rows, size, k)
    several = cut(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "minimizers")

    def emitted(batches, known_of):
        """Passages of many documents at a time, as columns."""
        held: list[list] = [[] for _ in range(5)]
        passages: list[bytes] = []

        def made():
            numbers = [np.concatenate(c) for c in held]
            out = pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32) if f.type == pa.int32() else c) for c, f in zip(numbers, PASSAGE, strict=False)], pa.array(passages, pa.binary())], schema=PASSAGE)
            for c in (*held, passages):
                c.clear()
            return out

        for batch in sliced(batches):
            for doc, text, th, known in zip(*(batch.column(i).to_pylist() for i in range(3)), known_of(batch), strict=True):
                g, first, windows, found = _passages(text, size, k, known)
                if found:
                    for c, x in zip(held, (np.full(len(g), doc, np.int64), np.full(len(g), th, np.int64), g, first, windows), strict=True):
                        c.append(x)
                    passages.extend(found)
            if len(passages) >= ROWS_OUT:
                yield made()
        if passages:
            yield made()

    if several.count() <= broadcast_keys:
        keys = np.sort(several.toArrow().column(0).to_numpy().view(np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast(keys)

        def run(batches):
            known = _known(shared.value)
            yield from emitted(batches, lambda batch: [known] * batch.num_rows)

        return rows.select("doc", "text", "th").mapInArrow(run, PASSAGE_DDL), several

    def run_joined(batches):
        yield from emitted(batches, lambda batch: [_known(np.sort(np.array(mine, np.int64).view(np.uint64))) for mine in batch.column(3).to_pylist()])

    mine = each.join(several, "g").groupBy("doc").agg(F.collect_set("g").alias("mine")).withColumnRenamed("doc", "d")  # bounded by one document
    return rows.join(mine, rows.doc == mine.d).select("doc", "text", "th", "mine").mapInArrow(run_joined, PASSAGE_DDL), several


def _matched(passages: DataFrame, size: int, shard_words: int) -> DataFrame:
    """(key, owners): for each passage the least document of each of its windows, from the automaton of its reference shard."""
    out = pa.schema([("key", pa.binary()), ("owners", pa.list_(pa.int64()))])

    def finish(shard):
        rows = []
        at = 0
        while at < len(shard):
            stop = at + 1
            while stop < len(shard) and shard[stop][0] == shard[at][0]:
                stop += 1
            if stop - at == 1:  # one passage: all of it matches itself, in its least document
                _, key, text, doc = shard[at]
                rows.append((key, [doc] * (text.count(b" ") + 2 - size)))
            at = stop
        many = [r for i, r in enumerate(shard) if (i and shard[i - 1][0] == r[0]) or (i + 1 < len(shard) and shard[i + 1][0] == r[0])]
        if many:
            auto, split = SuffixAutomaton(), [r[2].split(b" ") for r in many]
            for words, r in zip(split, many, strict=True):
                auto.add(words, r[3])
            auto.seal()
            rows += [(r[1], auto.owners(words, size)) for words, r in zip(split, many, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], out.field(1).type)], schema=out)

    def run(batches):
        shard, words = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if words >= shard_words and shard[-1][0] != row[0]:
                    yield finish(shard)
                    shard, words = [], 0
                shard.append(row)
                words += row[2].count(b" ") + 1
        if shard:
            yield finish(shard)

    return passages.select("g", "key", "passage", "least").repartition("g").sortWithinPartitions("g").mapInArrow(_merged(run), "key binary, owners array<bigint>")


def _single_windows(hot: DataFrame, size: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Owners of the passages of very common minimizers: their windows, dealt by content, are reference shards of one window."""
    out = pa.schema([("key", pa.binary()), ("j", pa.int32()), ("w", pa.binary()), ("least", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, passage, least in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = passage.split(b" ")
                rows += [(key, j, hashlib.sha1(b" ".join(words[j : j + size])).digest(), least) for j in range(len(words) - size + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    windows = cut(hot.select("key", "passage", "least").mapInArrow(run, "key binary, j int, w binary, least bigint"), "windows")
    owners = cut(windows.groupBy("w").agg(F.min("least").alias("owner")), "owners")
    least = owners.withColumnRenamed("w", "w2")
    each = windows.join(least, F.col("w") == F.col("w2")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "owner"))).alias("o"))  # bounded by one passage
    return each.select("key", F.transform("o", lambda x: x["owner"]).alias("owners")), (windows, owners)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, k: int = K, shard_words: int = SHARD_WORDS,
    hot_passages: int = HOT_PASSAGES, broadcast_keys: int = BROADCAST_KEYS, with_text: bool = False,
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and, where asked for, the ``kept_text`` (kept words joined by one space)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    candidates, several = _candidates(rows.where("doc is not null and text is not null"), size, k, broadcast_keys)
    found = cut(candidates.withColumn("key", F.unhex(F.md5("passage"))), "passages")
    discard(several)
    distinct = cut(found.groupBy("g", "key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("passage").alias("passage")), "distinct")
    # a minimizer all of whose passages belong to one document removes nothing
    wanted = distinct.groupBy("g").agg(F.count("*").alias("n"), F.min("least").alias("lo"), F.max("most").alias("hi")).where("lo < hi")
    wanted = cut(wanted.select(F.col("g").alias("g2"), "n"), "wanted")
    cold = distinct.join(wanted.where(F.col("n") <= hot_passages), F.col("g") == F.col("g2"))
    hot = distinct.join(wanted.where(F.col("n") > hot_passages), F.col("g") == F.col("g2"))
    single, scratch = _single_windows(hot, size)
    matched = cut(_matched(cold, size, shard_words).unionByName(single), "matched")
    for x in (distinct, wanted, *scratch):
        discard(x)
    owners = matched.withColumnRenamed("key", "key2")
    mask = F.expr("aggregate(transform(owners, (o, j) -> case when o < doc then cast(shiftleft(1, j) as int) else 0 end), 0, (a, x) -> a | x)")
    covered = found.select("doc", "th", "first", "key").join(owners, F.col("key") == F.col("key2")).select("doc", "th", "first", mask.alias("mask")).where("mask <> 0")
    spans = covered.groupBy("doc", "th").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))  # bounded by one document
    spans = cut(spans, "spans").withColumnsRenamed({"doc": "d2", "th": "t2"})
    for x in (found, matched):
        discard(x)
    joined = rows.join(spans, (rows.doc == spans.d2) & (rows.th == spans.t2), "left").select("doc", "spans", "text")
    return _applied(joined, size, with_text).withColumnRenamed("doc", "doc_id")


def _applied(joined: DataFrame, size: int, with_text: bool) -> DataFrame:
    fields = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
    schema = pa.schema([("doc", pa.int64()), *fields.items()])

    bits = np.arange(size, dtype=np.int64)

    def run(batches):
        for batch in sliced(batches):
            out = []
            spans = batch.column(1)
            inside = spans.flatten()
            first, mask = (inside.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)) if len(inside) else (np.empty(0, np.int64),) * 2
            stops = np.cumsum([n or 0 for n in pc.list_value_length(spans).to_pylist()])
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = words_of(text)
                kept = words
                lo, hi = (stops[row - 1] if row else 0), stops[row]
                if hi > lo:
                    at = (first[lo:hi, None] + bits)[(mask[lo:hi, None] >> bits) & 1 == 1]  # windows that go
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                whole = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), *([whole.decode("utf-8", "surrogatepass")] if with_text else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


