"""Lexical layer: documents -> segments -> chunks, with budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T


def segments(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines: ``doc, segment_idx, segment_id, line_number, content, name``. The index counts non-blank lines only.

    Numbering happens inside each row's array, so no window and no shuffle is needed.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), T.LINE_BREAK, -1), lambda x, i: F.struct(i.alias("line_number"), T.strip(x).alias("content")))
    full = F.filter(lines, lambda x: x["content"] != "")
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(full).alias("segment_idx", "x"))
    return rows.select("doc", "segment_idx", F.concat_ws("_S", F.col("doc").cast("string"), F.col("segment_idx").cast("string")).alias("segment_id"), "x.line_number", "x.content", T.short_name(F.col("x.content")).alias("name"))


def _split(text: str, separators: list[str]) -> list[str]:
    """Pieces that keep the separator at their start."""
    sep = next((s for s in separators if s in text or not s), "")
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def pack(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Recursive character chunks: short pieces are packed up to ``size`` with a tail overlap, long ones are split further."""
    if overlap >= size:
        overlap = max(20, size // 10) if size // 10 < size and max(20, size // 10) < size else 0
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        window: list[str] = []
        length = 0
        for piece in small:
            if window and length + len(piece) > size:
                if joined := "".join(window).strip():
                    out.append(joined)
                while window and (length > overlap or length + len(piece) > size):
                    length -= len(window.pop(0))
            window.append(piece)
            length += len(piece)
        if joined := "".join(window).strip():
            out.append(joined)
        small.clear()

    left = list(separators)
    while left and left[0] and left[0] not in text:
        left.pop(0)
    for piece in _split(text, left):
        if len(piece) < size:
            small.append(piece)
        else:
            flush()
            deeper = left[1:]
            out.extend(pack(piece, size, overlap, tuple(deeper)) if deeper else [piece])
    flush()
    return out


def chunks(segs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """``segment_id, chunk_idx, chunk_id, text, length, name`` with the segments' order columns. Segments within ``size`` skip Python."""

    @F.pandas_udf("array<string>")
    def split(content: pd.Series) -> pd.Series:
        return content.map(lambda t: pack(t, size, overlap))

    keep = [c for c in ("doc", "segment_idx", "segment_id") if c in segs.columns]
    short = segs.where(F.length("content") < size).select(*keep, F.lit(0).alias("chunk_idx"), F.trim("content").alias("text"))
    long = segs.where(F.length("content") >= size).select(*keep, F.posexplode(split("content")).alias("chunk_idx", "text"))
    both = short.unionByName(long)
    return both.select(*keep, "chunk_idx", F.concat_ws("_C", "segment_id", F.col("chunk_idx").cast("string")).alias("chunk_id"), "text", F.length("text").alias("length"), T.short_name(F.col("text")).alias("name"))


def sentence_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", per_chunk: int = 8) -> DataFrame:
    """Non-overlapping chunks of ``per_chunk`` sentences, cut inside each row's array.

    The sentences are an array of one element, whose function sees them as a variable: as an expression they would be split again for every chunk.
    """
    grouped = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / per_chunk).cast("int")), lambda k: F.array_join(F.slice(s, k * per_chunk + 1, F.lit(per_chunk)), " "))
    once = F.transform(F.array(T.sentences(F.col(text))), lambda s: F.when(F.size(s) > 0, grouped(s)))
    return docs.select(F.col(doc).alias("doc"), F.posexplode(once[0]).alias("chunk_idx", "text"))


def first_documents(docs: DataFrame, n: int, order: str = "filename") -> DataFrame:
    """The first ``n`` documents by name; ``n`` <= 0 keeps all."""
    return docs.orderBy(order).limit(n) if n > 0 else docs


def chunk_budget(parts: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` chunks in global order. A top-n by sort keys, so each task keeps n rows at most; ``n`` <= 0 keeps all."""
    return parts.orderBy(*order).limit(n) if n > 0 else parts


def documents_read(chunk_counts: DataFrame, n: int, order: str = "doc") -> DataFrame:
    """Documents that are read before the budget is spent, from (doc, n_chunks): those with fewer than ``n`` chunks before them."""
    before = F.coalesce(F.sum("n_chunks").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chunk_counts.withColumn("before", before).where(F.col("before") < n)


def step_counters(segs: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents, segments and chunks, in one row."""
    a = segs.agg(F.count_distinct("doc").alias("documents"), F.count("*").alias("segments"))
    return a.join(F.broadcast(parts.agg(F.count("*").alias("chunks"))))  # one row a side


def sample_lines(lines: DataFrame, n: int, seed: int, iteration: int = 0, key: tuple[str, ...] = ("filename", "line_number")) -> DataFrame:
    """A seeded sample of ``n`` lines without replacement; the same seed and iteration give the same lines."""
    return lines.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed + iteration)), *[F.col(c).cast("string") for c in key])), *key).limit(n)


def hash_split(rows: DataFrame, test_share: float = 0.2, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Adds ``is_test`` by a hash of the key, so the split survives any repartitioning."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(10_000))
    return rows.withColumn("is_test", bucket < int(test_share * 10_000))
