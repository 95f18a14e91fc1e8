"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks of Unicode text, and the prefix of translated transcripts.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
EDGE = "^[\\s\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+|[\\s\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+$"
TRANSCRIPT_PREFIX = "(?i)^\\[EN\\]\\s*.*?said from the .*? that\\s*"
SENTENCE_END = "(?<!\\w\\.\\w.)(?<![A-Z][a-z]\\.)(?<=\\.|\\?|\\!)\\s"
WORD = "[a-z][a-z'-]{2,}"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def sentences(x: Column) -> Column:
    # not F.trim itself: it has a second parameter, for which transform would pass the index as the characters to trim
    return F.filter(F.transform(F.split(x, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def clean_segment(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), TRANSCRIPT_PREFIX, ""), "\\s+", " "))


def tokens(x: Column, stop_words: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / 4)


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def escape_angles(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_name(x: Column, most: int = 20) -> Column:
    return F.when(F.length(x) > most, F.concat(strip(F.substring(x, 1, most)), F.lit("..."))).otherwise(x)


def parse_time(x: Column) -> Column:
    """Five formats; a weekday name in front is dropped first, as Spark doesn't parse it."""
    bare = F.regexp_replace(F.trim(x), "^\\p{L}+ (?=\\d{1,2} \\p{L}+ \\d{4},)", "")
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for v, f in ((x, "yyyy-MM-dd HH:mm:ss"), (bare, "d MMMM yyyy, HH:mm"), (x, "yyyy-MM-dd HH:mm"), (x, "dd/MM/yyyy HH:mm:ss"), (x, "dd/MM/yyyy HH:mm"))])


def date_in_name(name: Column) -> Column:
    return F.to_date(F.nullif(F.regexp_extract(name, "(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")))


def interpretation(silhouette: Column, p: Column) -> Column:
    shown = F.format_string("silhouette=%.3f", silhouette)
    said = F.when(silhouette > 0.5, "Strong").when(silhouette > 0.25, "Moderate").when(silhouette > 0, "Weak").otherwise("Poor")
    first = F.when(silhouette.isNotNull(), F.concat(said, F.lit(" cluster separation ("), shown, F.lit(")")))
    second = F.when(p < 0.001, "Highly significant difference (p<0.001)").when(p < 0.01, "Significant difference (p<0.01)").when(p < 0.05, "Marginally significant difference (p<0.05)").when(p.isNotNull(), F.format_string("No significant difference (p=%.4f)", p))
    return F.when(silhouette.isNull() & p.isNull(), "Insufficient data for interpretation").otherwise(F.concat_ws("; ", first, second))


def normal_json_string(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v")))
