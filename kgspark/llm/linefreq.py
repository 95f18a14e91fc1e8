"""Quality rules by cross-document line frequency, in DataFrame functions only.

Every non-blank line is normalised (A-Z and other letters lower-cased, ASCII white space runs made one space) and hashed. Per host, the documents
that hold a line are counted over the whole corpus; lines in more than ``line_limit`` documents of one host are removed, and a document that
loses more than ``max_removed`` of its words is depleted and rejected. The text without its removed lines is returned where asked for.

Texts are read once: a written table holds each row's figures and its lines' hashes and word counts, and all that follows works on these.

Base rules per document: words, code points in words, symbols, lines equal to an earlier one, words inside 3-word windows that occur twice.
Repeated windows are found by sorting (hash, position) packed into one long, so the cost is n log n in the text; windows that the sort puts side by
side are compared word by word, and where equal hashes have different words (a collision) the text's windows are counted by their words instead.

Edge cases: null and empty texts have no words and fail the base rule; a null host is a host of its own; repeated rows count as documents of
their own; a document that holds a line several times counts once for it; an empty table gives an empty result; extra columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import SPACE, cut, discard

LINE_LIMIT, MAX_REMOVED = 100, 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
_BLANK = "[\\x20\\x09-\\x0D]"
KEYS = ("doc_id", "th", "host")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def lines_of(text: Column) -> Column:
    """array<struct<h, n>>: of each line, the hash of its normal form and its words (none where it is blank)."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " "))
    sized = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("int")
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), flat), lambda x: F.struct(F.xxhash64(x).alias("h"), sized(x).alias("n")))


def _repeats(rows: DataFrame, distrust: bool = False) -> DataFrame:
    """Turn ``w`` (words) into ``n_repeat_words``; ``distrust`` goes the way for collisions everywhere."""
    packed = "case when size(w) < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint))) end"
    sorted_ = rows.withColumn("b", F.expr("cast(ceil(log2(size(w) + 1)) as int)")).withColumn("p", F.expr(packed)).withColumn("low", F.expr("shiftleft(1L, b) - 1"))
    # neighbours in the sorted array whose hashes are equal, as positions (of the later, of the earlier)
    pairs = "filter(transform(p, (x, j) -> case when j > 0 and shiftright(x, b) = shiftright(p[j - 1], b) then named_struct('y', cast(x & low as int), 'x', cast(p[j - 1] & low as int)) end), z -> z is not null)"
    same = "w[z.x] = w[z.y] and w[z.x + 1] = w[z.y + 1] and w[z.x + 2] = w[z.y + 2]"
    found = sorted_.withColumn("pairs", F.expr(pairs)).withColumn("sure", F.expr(f"forall(pairs, z -> {same})") if not distrust else F.expr("size(w) < 4"))
    grams = "transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i))"
    slow = f"aggregate(array_sort({grams}), named_struct('g', cast(null as string), 'i', -1, 'q', cast(array() as array<int>)), (a, z) -> named_struct('g', z.g, 'i', z.i, 'q', case when a.g = z.g then concat(a.q, array(a.i, z.i)) else a.q end), a -> a.q)"
    starts = f"sort_array(array_distinct(case when sure then flatten(transform(pairs, z -> array(z.x, z.y))) else {slow} end))"
    covered = "cast(aggregate(q, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n) as bigint)"
    return found.withColumn("q", F.expr(starts)).withColumn("n_repeat_words", F.expr(covered)).drop("w", "b", "p", "low", "pairs", "sure", "q")


def base_figures(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Per row: KEYS (``th``: a hash of the text), the base figures and ``lines``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(host).alias("host"), F.col(text).alias("text"))
    full = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        *KEYS, words(F.col("text")).alias("w"), full.alias("l"), lines_of(F.col("text")).alias("lines"), (F.length(t) - F.regexp_count(t, F.lit(_BLANK))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    return _repeats(rows.select(*KEYS, "w", F.size("w").cast("bigint").alias("n_words"), "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"), "lines"))


def frequent_lines(figures: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """(host, h) of lines in more than ``line_limit`` documents of a host; a document's repeats are dropped before any shuffle."""
    held = F.array_distinct(F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["h"]))
    each = figures.select("host", F.explode(held).alias("h"))
    return each.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_limit).select("host", "h")


def line_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = LINE_LIMIT, max_removed: float = MAX_REMOVED, with_text: bool = True) -> DataFrame:
    """Per row: ``doc_id``, the base figures, ``n_removed`` (words in frequent lines), ``base_failed``, ``kept`` and, where asked for, ``kept_text`` without those lines."""
    figures = cut(base_figures(docs, doc_id, text, host), "figures")
    often = cut(frequent_lines(figures, line_limit), "frequent")
    often_ = often.select(F.col("host").alias("fh"), F.col("h").alias("fl"))
    lines = figures.select(*KEYS, F.posexplode("lines").alias("pos", "x")).where("x.n > 0").select(*KEYS, "pos", "x.h", "x.n")
    lost = lines.join(often_, (lines.h == often_.fl) & lines.host.eqNullSafe(often_.fh))
    # repeated rows have the same lines: each position counts once; bounded by one document's lines
    lost = lost.groupBy(*KEYS).agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    lost = cut(lost, "lost").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("host").alias("s"), "gone")
    discard(often)
    on = lambda x: x["doc_id"].eqNullSafe(lost.d) & x["th"].eqNullSafe(lost.t) & x["host"].eqNullSafe(lost.s)
    if with_text:
        rows = docs.select(F.col(doc_id).alias("i"), F.xxhash64(F.col(text)).alias("j"), F.col(host).alias("k"), F.col(text).alias("text"))
        # rows with one key have one text: its figures are wanted once, then for each of them
        one = figures.drop("lines").dropDuplicates(list(KEYS))
        figures = one.join(rows.hint("merge"), one.doc_id.eqNullSafe(rows.i) & one.th.eqNullSafe(rows.j) & one.host.eqNullSafe(rows.k)).drop("i", "j", "k")
    joined = figures.join(lost.hint("merge") if with_text else lost, on(figures), "left")
    joined = joined.withColumn("n_removed", F.coalesce(F.aggregate("gone", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", failed.alias("base_failed"), (~failed & (F.col("n_removed") <= max_removed * F.col("n_words"))).alias("kept")]
    if with_text:
        without = F.array_join(F.expr("filter(split(text, '\n', -1), (x, i) -> not array_contains(at, i))"), "\n")
        joined = joined.withColumn("at", F.transform("gone", lambda x: x["pos"]))
        out.append(F.when(F.col("gone").isNull(), F.col("text")).otherwise(without).alias("kept_text"))
    return joined.select(*out)
