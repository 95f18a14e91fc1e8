"""The tables behind the figures: what a plot of each kind draws, in long form. Drawing is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.operators.graph import ccdf, degrees, top_k
from kgspark.operators.vectors import similarity_matrix


def evolution(iterations: DataFrame, metrics: tuple[str, ...] | None = None, key: str = "iteration") -> DataFrame:
    """(iteration, metric, value, change): every numeric figure of the iterations, with its change since the one before."""
    numeric = metrics or tuple(c for c, kind in iterations.dtypes if c != key and kind in ("int", "bigint", "double", "float"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in numeric]))
    rows = iterations.select(F.col(key), pairs.alias("x")).select(key, "x.metric", "x.value")
    return rows.withColumn("change", F.col("value") - F.lag("value").over(W.partitionBy("metric").orderBy(key)))


def modularity_and_separation(iterations: DataFrame) -> DataFrame:
    return iterations.select("iteration", "modularity", "topic_separation", "topic_overlap")


def growth(iterations: DataFrame) -> DataFrame:
    """(iteration, entities, relations, density, communities) of the growing graph."""
    n = F.col("entities")
    return iterations.select("iteration", "entities", "relations", F.when(n > 1, F.col("relations") / (n * (n - 1))).otherwise(0.0).alias("density"), "communities")


def heatmap(centroids: DataFrame, label: str = "label", vector: str = "centroid") -> DataFrame:
    """(i, j, sim) of every cell: both triangles and the diagonal. One row a pair of topics."""
    half = similarity_matrix(centroids, label, vector)
    flip = half.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")
    return half.unionByName(flip).unionByName(centroids.select(F.col(label).alias("i"), F.col(label).alias("j"), F.lit(1.0).alias("sim")))


def silhouettes_by_group(samples: DataFrame, label: str = "label", value: str = "s") -> DataFrame:
    """(label, n, mean, min, q25, median, q75, max), best groups first: the dashboard's bars."""
    q = lambda p: F.percentile(value, F.lit(p))
    each = samples.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(value).alias("max"))
    return each.orderBy(F.desc("mean"), label)


def silhouette_histogram(samples: DataFrame, bins: int = 20, by: str = "level", value: str = "s") -> DataFrame:
    """(level, bin, low, high, n, share) over [-1, 1]; a value of 1 falls into the last bin."""
    at = F.least(F.floor((F.col(value) + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    counted = samples.where(F.col(value).isNotNull()).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy(by))
    return counted.select(by, "bin", (F.col("bin") * 2.0 / bins - 1).alias("low"), ((F.col("bin") + 1) * 2.0 / bins - 1).alias("high"), "n", (F.col("n") / whole).alias("share"))


def scree(spark: SparkSession, variances: dict[str, list[float]]) -> DataFrame:
    """(level, component, ratio, cumulative) of explained variance, from the levels' lists."""
    rows, total = [], 0.0
    for level, ratios in variances.items():
        total = 0.0
        for k, x in enumerate(ratios, 1):
            total += x
            rows.append((level, k, float(x), total))
    return spark.createDataFrame(rows, "level string, component int, ratio double, cumulative double")


def statistical_summary(spark: SparkSession, reports: dict[int, dict]) -> DataFrame:
    """(iteration, level, n, labels, silhouette, f, p, eta2, significant_pairs, pairs) of separation reports by iteration."""
    rows = []
    for iteration, r in sorted(reports.items()):
        for level, x in (r.get("levels") or {}).items():
            if x:
                a, pairs = x.get("anova") or {}, x.get("pairwise") or []
                rows.append((iteration, level, x.get("n"), x.get("labels"), x.get("silhouette"), a.get("f"), a.get("p"), a.get("eta2"), sum(bool(p.get("significant")) for p in pairs), len(pairs)))
    return spark.createDataFrame(rows, "iteration int, level string, n long, labels long, silhouette double, f double, p double, eta2 double, significant_pairs int, pairs int")


def weighting_impact(baseline: float, weighted: float, spark: SparkSession) -> DataFrame:
    """(kind, modularity, delta) without and with structural weights."""
    return spark.createDataFrame([("baseline", float(baseline), 0.0), ("weighted", float(weighted), float(weighted - baseline))], "kind string, modularity double, delta double")


def centrality_bars(scores: DataFrame, k: int = 10, by: tuple[str, ...] = ("measure",)) -> DataFrame:
    """(by, id, score, rank): the longest bars of each panel, from long-form scores."""
    return top_k(scores, k, list(by)).select(*by, "id", "score", "rank")


def degree_distributions(graphs: dict[str, DataFrame]) -> DataFrame:
    """(graph, k, p): the complementary cumulative degree distribution of each named edge table, to compare them."""
    out = None
    for name, edges in graphs.items():
        one = ccdf(degrees(edges)).select(F.lit(name).alias("graph"), "k", "p")
        out = one if out is None else out.unionByName(one)
    return out


def write_figures(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as Parquet under its name, and a manifest (figure, path, rows)."""
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, f"{folder}/{name}", next(iter(tables.values())).sparkSession.read.parquet(f"{folder}/{name}").count()))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, "figure string, path string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest
