"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Document evidence: naive Bayes over binned figures of the whole text, fitted on at most ``sample_rows`` labelled rows (those with the least
   hashes), smoothed by Laplace. The fitted table has one row for each figure and bin, so its size doesn't depend on the data.
2. Site evidence: over ALL documents, sums of the documents' posteriors by host and by path. A host's mean is shrunk to the global mean, a
   path's to its host's posterior; the prior strengths come from the moments between sites (empirical Bayes), so sparse sites keep the prior.
3. Both are combined as logit(document) + logit(path) - logit(global); a document is kept from ``threshold`` on.

Aggregates are partial before they are shuffled; the site table is joined back by size (one row a path).

Edge cases: a null or empty text has all figures zero; null hosts and paths are sites of their own; several labels of one document are averaged, null labels are
ignored; without labels there is no evidence and everything is kept; repeated rows weigh as often as they occur; an empty table gives an empty result; extra
columns pass through whatever their names, and the struct takes a free one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import SPACE, cut, discard, free_name

SAMPLE_ROWS, BINS = 20_000, 12
#: Below one half, since a good document lost weighs more than a bad one kept. Picked on labels of the 0.1 tables.
THRESHOLD = 0.05
MIN_STRENGTH, MAX_STRENGTH = 5.0, 1e6
FIGURES = ("symbols", "capitals", "shouts", "variety", "repeats", "length", "word_length", "digits")


def figures(text: Column) -> list[Column]:
    """One small integer (its bin) for each of FIGURES, from the whole text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1))
    w = F.array_remove(F.split(t, SPACE, -1), "")
    per_word = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    log = lambda x: F.floor(F.log2(1 + 63 * x))  # noqa: E731  fine near zero
    raw = [
        log(per_word("[#*$%&|<>]")), log(per_word("[A-Z]")), log(per_word("[!]")), F.floor(11 * F.size(F.array_distinct(w)) / n),
        log(per_word("(?<![^\\x20\\x09-\\x0D])([^\\x20\\x09-\\x0D]++)[\\x20\\x09-\\x0D]++\\1(?![^\\x20\\x09-\\x0D])")), F.floor(F.log2(n)), F.floor(F.length(t) / n),
        log(per_word("[0-9]")),
    ]
    return [F.greatest(F.least(x, F.lit(BINS - 1)), F.lit(0)).cast("int").alias(f"_f{k}") for k, x in enumerate(raw)]


def fit(binned: DataFrame, labels: DataFrame, doc_id: str, quality: str = "quality", label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[float, list[list[float]]]:
    """(log prior odds, log likelihood ratios by figure and bin) from a bounded sample of the labels."""
    said = labels.select(F.col(label_id).alias("_l"), F.col(quality).alias("_q")).where("_l is not null and _q is not null")
    said = said.groupBy("_l").agg((F.avg("_q") >= 0.5).cast("int").alias("_q")).orderBy(F.xxhash64("_l"), "_l").limit(sample_rows)
    known = binned.join(F.broadcast(said), F.col(doc_id) == F.col("_l"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"_f{k}").alias("b")) for k in range(len(FIGURES))]))
    rows = known.select("_q", pairs.alias("p")).groupBy("_q", "p.f", "p.b").count().collect()  # at most 2 * figures * bins rows
    counts = [[[1.0] * BINS for _ in range(2)] for _ in FIGURES]
    n = [1.0, 1.0]
    for r in rows:
        counts[r.f][r._q][r.b] += r["count"]
        n[r._q] += r["count"] * (r.f == 0)
    ratios = [[math.log(c[1][b] / sum(c[1])) - math.log(c[0][b] / sum(c[0])) for b in range(BINS)] for c in counts]
    return math.log(n[1] / n[0]), ratios if rows else [[0.0] * BINS for _ in FIGURES]


def document_score(prior: float, ratios: list[list[float]]) -> Column:
    """Posterior that a document is good, from its bins, kept off 0 and 1."""
    s = F.lit(prior)
    for k, r in enumerate(ratios):
        s = s + F.element_at(F.array(*[F.lit(round(x, 9)) for x in r]), F.col(f"_f{k}") + 1)
    return F.greatest(F.least(1 / (1 + F.exp(-s)), F.lit(1 - 1e-9)), F.lit(1e-9))


def _strength(mean: float, between: float) -> float:
    """Prior strength of a Beta whose mean and variance are those found between sites."""
    return min(MAX_STRENGTH, max(MIN_STRENGTH, mean * (1 - mean) / between - 1)) if between > 0 else MAX_STRENGTH


def _between(sites: DataFrame, mean: float) -> float:
    """Variance between the sites' means beyond what sampling within them explains."""
    r = sites.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("b"), F.sum((F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("w"), F.sum("n").alias("n")).first()
    return max(0.0, (r.b or 0.0) - (r.w or 0.0)) / r.n if r.n else 0.0


def site_posteriors(scored: DataFrame, host: str, path: str, p: str) -> tuple[float, DataFrame]:
    """(global mean, (host, path, p_host, p_path)): posterior means shrunk path -> host -> global."""
    paths = cut(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("s2")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    row = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = row[0] / row[1] if row[1] else 0.5
    k_host, k_path = _strength(mean, _between(hosts, mean)), _strength(mean, _between(paths, mean))
    at_host = hosts.select(F.col("host").alias("h"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("p_host"))
    joined = paths.join(at_host, paths.host.eqNullSafe(at_host.h))
    sites = cut(joined.select("host", "path", "p_host", ((F.col("s") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path")), "sites")
    discard(paths)
    return mean, sites


def _logit(x: Column) -> Column:
    return F.log(x) - F.log(1 - x)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with a struct column ``evidence``: p_doc, p_host, p_path, p and kept.

    Where texts are asked for, figures are computed a second time beside them: a copy of all texts costs more disk and memory than that costs time.
    """
    kept = docs.columns if keep is None else keep
    out = free_name(docs, "evidence")
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    site = [F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), *figures(F.col(text))]
    light = text not in kept
    binned = cut(docs.select(own, *site) if light else docs.select(*site), "figures")
    prior, ratios = fit(binned, labels, "id", sample_rows=sample_rows)
    rows = (binned if light else docs.select(own, *site)).select("row", "host", "path", document_score(prior, ratios).alias("p"))
    mean, sites = site_posteriors(binned.select("host", "path", document_score(prior, ratios).alias("p")), "host", "path", "p")
    sites = sites.select(F.col("host").alias("sh"), F.col("path").alias("sp"), "p_host", "p_path")
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")))
    both = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("p_path")) - F.lit(math.log(mean / (1 - mean))))))
    said = F.struct(F.round("p", 6).alias("p_doc"), F.round("p_host", 6).alias("p_host"), F.round("p_path", 6).alias("p_path"), F.round(both, 6).alias("p"), (F.round(both, 6) >= threshold).alias("kept"))
    return joined.select("row.*", said.alias(out))
