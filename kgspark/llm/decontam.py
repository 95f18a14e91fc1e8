"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normal form: A-Z lower-cased, words are runs of ASCII letters and digits and of non-ASCII characters, joined by one
space. Every 13-word window of an item is a pattern (an item of 1 to 12 words is one pattern), with a space at
both ends so that only whole words match. A document is normalised once and scanned once; match ends map to word
indexes, and word indexes to offsets of the original text where spans are asked for.

The automaton works on UTF-8 bytes read as Latin-1, so one table lower-cases and separates in a single pass.
Its patterns are broadcast, and their size is checked first: beyond ``max_pattern_chars`` the items are dealt into
several automata of about that size, and the documents are scanned once for each, one job after the other.

Edge cases: a null or empty text has no words, no hits and is not contaminated; an item without words matches
nothing; repeated items with the same id count once; an item whose id is null hits words like any other but isn't listed or counted; an empty benchmark contaminates nothing; long texts need
memory in proportion to one text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, ddl, discard, free_name, map_texts, sliced

WINDOW = 13
MAX_PATTERN_CHARS = 16_000_000
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(text: str | None, size: int) -> list[str]:
    """The patterns of one item."""
    w = [x.decode("latin-1") for x in words_of(text)]
    return [" " + " ".join(w[i : i + size]) + " " for i in range(max(1, len(w) - size + 1))] if w else []


def original_spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Character spans (end exclusive) in the original text of the words whose indexes are in ``hit``; runs are merged."""
    chosen, spans, last = set(hit), [], -2
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for i, m in enumerate(_WORD.finditer(lowered)):
        if i in chosen:
            if i == last + 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            last = i
    return spans


def _automaton(patterns: dict):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for p, value in patterns.items():
        auto.add_word(p, value)
    if patterns:
        auto.make_automaton()
    return auto


def _hits(auto, words: list[bytes]) -> tuple[list[int], list[str]]:
    """(indexes of hit words, sorted item ids) of one text, scanned once."""
    import numpy as np

    found: set[str] = set()
    ends = None
    for end, (items, n) in auto.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        if ends is None:
            ends = np.cumsum([len(x) + 1 for x in words])  # index of the space after each word
            covered = np.zeros(len(words) + 1, dtype=np.int32)
        found.update(items)
        at = int(np.searchsorted(ends, end)) + 1
        covered[at - n] += 1
        covered[at] -= 1
    return ([] if ends is None else np.flatnonzero(np.cumsum(covered[:-1]) > 0).tolist()), sorted(found)


def _scanner(patterns: dict, with_spans: bool, positions: bool = False):
    auto = _automaton(patterns)

    def scan(texts):
        out = []
        for text in texts:
            words = words_of(text)
            hit, items = _hits(auto, words) if patterns and words else ([], [])
            if positions:
                out.append((hit, items))
            else:
                out.append((len(words), len(hit), items, *([_spans(text, hit)] if with_spans else [])))
        return list(zip(*out, strict=True)) if out else [[] for _ in range(2 if positions else 3 + with_spans)]

    return scan


def _spans(text: str | None, hit: list[int]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in original_spans(text or "", hit)] if hit else []


def _patterns(items: DataFrame, size: int) -> dict[str, tuple[list[str], int]]:
    """Pattern -> (item ids, words). An item without an id still has its windows; it only has no id to list."""
    out: dict[str, tuple[list[str], int]] = {}
    for row in items.toLocalIterator():
        for p in windows_of(row.t, size):
            ids, _ = out.setdefault(p, ([], p.count(" ") - 1))
            if row.i is not None and row.i not in ids:
                ids.append(row.i)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW,
    max_pattern_chars: int = MAX_PATTERN_CHARS, with_spans: bool = False, keep_text: bool = False, prefix: str = "",
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``items`` (sorted array of item ids) and, where asked for, ``spans`` of the original text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    # a byte of an item is in at most ``size`` of its windows, so this bounds the patterns before any of them is made
    chars = items.agg(F.sum((F.octet_length("t") + 2) * size)).first()[0] or 0
    fields = {f"{prefix}n_words": ("bigint", pa.int64()), f"{prefix}n_hit": ("bigint", pa.int64()), f"{prefix}items": ("array<string>", pa.list_(pa.string()))}
    if with_spans:
        fields[f"{prefix}spans"] = ("array<struct<start:bigint,end:bigint>>", SPANS)
    groups = -(-chars // max_pattern_chars)
    if groups <= 1:
        shared = docs.sparkSession.sparkContext.broadcast(_patterns(items, size))
        return map_texts(docs, text, fields, lambda: _scanner(shared.value, with_spans), keep_text)
    return _many(docs, items, text, size, groups, fields, with_spans, keep_text)


def _many(docs: DataFrame, items: DataFrame, text: str, size: int, groups: int, fields: dict, with_spans: bool, keep_text: bool) -> DataFrame:
    """Several automata, one job each, so that driver and workers hold one at a time. Hits are kept by text (its MD5) and united."""
    key, hits, ids, kept = (free_name(docs, x) for x in ("_key", "_hits", "_ids", "_text"))
    texts = docs.select(F.md5(F.col(text)).alias("k"), F.col(text).alias("t")).where("t is not null")
    parts = []
    for g in range(groups):
        shared = docs.sparkSession.sparkContext.broadcast(_patterns(items.where(F.pmod(F.xxhash64("t"), F.lit(groups)) == g), size))
        found = map_texts(texts, "t", {"hit": ("array<int>", pa.list_(pa.int32())), "ids": ("array<string>", pa.list_(pa.string()))}, lambda s=shared: _scanner(s.value, False, positions=True))
        parts.append(cut(found.where("size(hit) > 0"), "hits"))
        shared.unpersist()
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  bounded by one text
    united = cut(united.groupBy("k").agg(flat("hit").alias(hits), flat("ids").alias(ids)).withColumnRenamed("k", key), "united")
    discard(*parts)
    joined = docs.withColumn(kept, F.md5(F.col(text))).join(united, F.col(kept) == F.col(key), "left").drop(kept, key)
    names = [c for c in docs.columns if keep_text or c != text]
    schema = ddl(docs.select(*[F.col(f"`{c}`") for c in names]), ", ".join(f"`{n}` {t[0]}" for n, t in fields.items())).lstrip(", ")

    def run(batches):
        for batch in sliced(batches):
            at = lambda c, b=batch: b.column(b.schema.names.index(c))
            rows = [(len(words_of(t)), len(h or []), i or [], *([_spans(t, h or [])] if with_spans else [])) for t, h, i in zip(at(text).to_pylist(), at(hits).to_pylist(), at(ids).to_pylist(), strict=True)]
            columns = [at(c) for c in names] + [pa.array(v, kind) for v, (_, kind) in zip(zip(*rows, strict=True), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *fields])

    return joined.mapInArrow(run, schema)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest columns of the query, from the operator's real output."""
    return scanned.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str | None, str | None]], size: int = WINDOW) -> tuple[int, int, list[str]]:
    """The contract, word by word: (n_words, n_hit, item ids)."""
    low = lambda t: _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = low(text), set(), set()
    starts: dict[str, list[int]] = {}
    for j, x in enumerate(words):
        starts.setdefault(x, []).append(j)
    for item, body in items:
        w = low(body)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            window = w[i : i + size]
            for j in starts.get(window[0], ()):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found |= {item} - {None}
    return len(words), len(hit), sorted(found)


__all__ = ["decontaminate", "digest", "brute_force", "original_spans", "windows_of", "words_of"]
