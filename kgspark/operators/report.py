"""Separation reports: levels of topics measured and told in words."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.labels import topic_key
from kgspark.operators import stats, vectors
from kgspark.operators.storage import cut


def level_samples(edges: DataFrame, nodes: DataFrame, level: str = "TOPIC") -> DataFrame:
    """(id, label, embedding): members of each topic under synthetic ids, and the topic's centroid; topics without embedded members give their own embedding."""
    known = nodes.where(F.col("embedding").isNotNull()).select("id", "embedding")
    inside = edges.where("label = 'IN_TOPIC'").select(F.col("src").alias("m"), F.col("dst").alias("topic")).where(F.startswith("topic", F.lit(f"{level}_")))
    member = inside.join(known, inside.m == known.id).select(F.concat_ws("__", "topic", "m").alias("id"), F.col("topic").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    mean = vectors.centroids(member, "label").select(F.col("label").alias("id"), "label", F.col("centroid").alias("embedding"))
    own = known.where(F.startswith("id", F.lit(f"{level}_"))).join(mean.select(F.col("label").alias("_l")), F.col("id") == F.col("_l"), "left_anti").select("id", F.col("id").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    both = member.unionByName(mean).unionByName(own)
    return both.withColumn("label", topic_key(F.col("label")))


def analyse_level(samples: DataFrame, components: int = 5) -> dict | None:
    """Silhouette, one-way ANOVA on the first component, ANOVAs on the first five, Welch pairs and a reading; None below 3 rows or 3 labels."""
    samples = cut(samples, "samples")
    row = samples.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if row.n < 3 or row.k < 3:
        return None
    s = [r.asDict() for r in vectors.silhouette_summary(vectors.silhouette(samples)).collect()]  # a row a topic
    overall = next((r["s"] for r in s if r["label"] is None), None)
    projected, variance = vectors.principal_components(samples, 10, keep=("id", "label"))
    projected = cut(projected, "projected")
    groups = stats.group_stats(projected.withColumn("x", F.col("pc")[0]), "label", "x")
    one = stats.anova(groups).first()
    p = stats.anova_p(one)
    pairs = [r.asDict() for r in stats.welch_pairs(groups, "label").collect()]  # at most twenty
    for r in pairs:
        r["p"] = None if r["t"] is None else stats.t_p_value(r["t"], r["df"])
        r["significant"] = r["p"] is not None and r["p"] < 0.05 / r["pairs"]
    return {"n": row.n, "labels": row.k, "silhouette": overall, "per_label": {r["label"]: r["s"] for r in s if r["label"] is not None}, "anova": {"f": one.f, "p": p, "eta2": one.eta2}, "components": stats.anova_components(projected, "label", components=components), "pairwise": pairs, "explained_variance": variance, "reading": reading(overall, p)}


def reading(silhouette: float | None, p: float | None) -> str:
    said = []
    if silhouette is not None:
        word = "Strong" if silhouette > 0.5 else "Moderate" if silhouette > 0.25 else "Weak" if silhouette > 0 else "Poor"
        said.append(f"{word} cluster separation (silhouette={silhouette:.3f})")
    if p is not None:
        for bound, text in ((0.001, "Highly significant difference (p<0.001)"), (0.01, "Significant difference (p<0.01)"), (0.05, "Marginally significant difference (p<0.05)")):
            if p < bound:
                said.append(text)
                break
        else:
            said.append(f"No significant difference (p={p:.4f})")
    return "; ".join(said) or "Insufficient data for interpretation"


def separation_report(nodes: DataFrame, edges: DataFrame, path: str | None = None, levels: tuple[str, ...] = ("TOPIC", "SUBTOPIC")) -> dict:
    """Every level and the global separation of all of them together; written as JSON where a path is given."""
    parts = {level: level_samples(edges, nodes, level) for level in levels}
    whole = None
    for p in parts.values():
        whole = p if whole is None else whole.unionByName(p)
    out = {"levels": {k: analyse_level(v) for k, v in parts.items()}, "global": vectors.separation(whole).first().asDict()}
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=1, default=str)
    return out
