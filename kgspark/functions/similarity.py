"""Similarities of texts, token sets and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kgspark.functions.labels import standardize_label


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, argument order kept. No built-in has it; Arrow batches carry the pairs."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    tokens = lambda x: F.array_distinct(F.filter(F.split(x, "\\s+"), lambda t: t != ""))
    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def edge_weight(a: Column, b: Column) -> Column:
    """Cosine, at least 0.001."""
    return F.greatest(F.lit(0.001), cosine(a, b))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector counts as having norm 1."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(F.lit(1.0))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, "_"), lambda t: F.length(t) > 2)


def matches_hint(endpoint: Column, hints: Column) -> Column:
    """Equal, either contains the other, or shared tokens (two, or one where a side has only one)."""
    e = standardize_label(endpoint)
    te = F.array_distinct(_tokens(e))

    def one(h: Column) -> Column:
        h = standardize_label(h)
        th = F.array_distinct(_tokens(h))
        shared = F.size(F.array_intersect(te, th))
        return (h != "") & (h.eqNullSafe(e) | e.contains(h) | h.contains(e) | ((shared > 0) & ((shared >= 2) | (F.size(te) == 1) | (F.size(th) == 1))))

    return (e != "") & F.exists(F.filter(hints, lambda h: h.isNotNull()), one)


def in_evidence(candidate: Column, evidence: Column) -> Column:
    c, e = standardize_label(candidate), standardize_label(evidence)
    return (c != "") & (e != "") & F.concat(F.lit("_"), e, F.lit("_")).contains(F.concat(F.lit("_"), c, F.lit("_")))
