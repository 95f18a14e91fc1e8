"""Group statistics over topics: ANOVA, Welch pairs, permutation test, correlation, paired t."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def f_p_value(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def group_stats(rows: DataFrame, group: str, value: str, also: list[str] | None = None) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.where(F.col(value).isNotNull()).groupBy(*(also or []), group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))


def anova(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., k, n, f, eta2) over groups of more than one member, from ``group_stats``. Null f where there are fewer than 2 groups or 3 rows."""
    used = stats.where(F.col("n") > 1)
    n, k = F.sum("n"), F.count("*")
    sums = used.groupBy(*(by or [])) if by else used.groupBy()
    agg = sums.agg(k.alias("k"), n.alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("s2"), F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    ssb = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    f = F.when((F.col("k") >= 2) & (F.col("n") >= 3) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0), (ssb / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
    return agg.select(*(by or []), "k", "n", f.alias("f"), F.when(ssb + F.col("ssw") > 0, ssb / (ssb + F.col("ssw"))).otherwise(0.0).alias("eta2"))


def anova_p(row) -> float | None:
    return None if row is None or row.f is None else f_p_value(row.f, row.k - 1, row.n - row.k)


def anova_components(rows: DataFrame, label: str, pc: str = "pc", components: int = 5) -> dict | None:
    """Mean F, smallest p times the number of tests and mean effect size over the first principal components."""
    long = rows.select(label, F.posexplode(F.slice(pc, 1, components)).alias("c", "x"))
    found = [r for r in anova(group_stats(long, label, "x", ["c"]), ["c"]).collect() if r.f is not None]  # a row a component
    if not found or found[0].n < 10:
        return None
    ps = [anova_p(r) for r in found]
    return {"tests": len(found), "f": sum(r.f for r in found) / len(found), "p": min(1.0, min(ps) * len(found)), "eta2": sum(r.eta2 for r in found) / len(found)}


def welch_pairs(stats: DataFrame, group: str, most: int = 20) -> DataFrame:
    """(a, b, t, df, g, pairs): Welch's t, its degrees of freedom and Hedges' g of the first ``most`` pairs of groups in order.

    One row a group; each carries the groups behind it, so pairs beyond the cap aren't formed for long.
    """
    s = F.struct(F.col(group).alias("l"), "n", "mean", "var")
    table = stats.where("n > 1").agg(F.array_sort(F.collect_list(s)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), 1, most), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = table.select((F.size("t") * (F.size("t") - 1) / 2).cast("bigint").alias("pairs"), F.explode(F.slice(pairs, 1, most)).alias("p"))
    c = lambda side, name: F.col(f"p.{side}.{name}")
    va, vb = c("x", "var") / c("x", "n"), c("y", "var") / c("y", "n")
    se = F.sqrt(va + vb)
    df = F.pow(va + vb, 2) / (F.pow(va, 2) / (c("x", "n") - 1) + F.pow(vb, 2) / (c("y", "n") - 1))
    dof = c("x", "n") + c("y", "n") - 2
    pooled = F.sqrt(((c("x", "n") - 1) * c("x", "var") + (c("y", "n") - 1) * c("y", "var")) / dof)
    g = F.when(pooled > 0, F.abs(c("x", "mean") - c("y", "mean")) / pooled * (1 - 3 / (4 * dof - 1))).otherwise(0.0)
    return rows.select(c("x", "l").alias("a"), c("y", "l").alias("b"), F.when(se > 0, (c("x", "mean") - c("y", "mean")) / se).alias("t"), F.when(se > 0, df).alias("df"), g.alias("g"), "pairs")


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman); Spearman is the correlation of average ranks. Null below three rows."""
    data = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranked(c: str) -> Column:
        return F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0

    both = data.withColumns({"rx": ranked("x"), "ry": ranked("y")})
    enough = lambda v: F.when(F.count("*") >= 3, v)
    return both.agg(F.count("*").alias("n"), enough(F.corr("x", "y")).alias("pearson"), enough(F.corr("rx", "ry")).alias("spearman"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t) of a - b."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    agg = rows.where(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    return agg.select("n", "mean_difference", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean_difference") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def permutation_test(rows: DataFrame, label: str, a: object, b: object, vector: str = "embedding", shuffles: int = 1000, seed: int = 42) -> DataFrame:
    """(n, distance, p): distance of two groups' centroids against seeded shuffles of the labels.

    Each shuffle gives every row a hash rank; group a's part of it is summed by (shuffle, dimension), so the shuffles share one aggregate.
    """
    data = rows.where(F.col(label).isin(a, b) & F.col(vector).isNotNull()).where(~F.exists(vector, lambda x: F.isnan(x)))
    data = data.select((F.col(label) == F.lit(a)).alias("in_a"), F.col("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    row = data.agg(F.count("*").alias("n"), F.sum(F.col("in_a").cast("int")).alias("na")).first()
    if not row.na or row.na == row.n:
        return data.select(F.lit(row.n).alias("n"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("p")).limit(1)
    trials = data.select("in_a", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(shuffles))).alias("k"))
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.xxhash64("id", "k", F.lit(seed)), "id"))
    picked = trials.withColumn("hit", F.when(F.col("k") == 0, F.col("in_a")).otherwise(rank <= row.na))
    dims = picked.select("k", "hit", F.posexplode("v").alias("d", "x")).groupBy("k", "d").agg(F.avg(F.when(F.col("hit"), F.col("x"))).alias("ma"), F.avg(F.when(~F.col("hit"), F.col("x"))).alias("mb"))
    dist = dims.groupBy("k").agg(F.sqrt(F.sum(F.pow(F.col("ma") - F.col("mb"), 2))).alias("dist"))
    real = F.max(F.when(F.col("k") == 0, F.col("dist"))).over(W.partitionBy())
    return dist.withColumn("real", real).groupBy("real").agg(F.sum(((F.col("k") > 0) & (F.col("dist") >= F.col("real"))).cast("int")).alias("extreme")).select(F.lit(row.n).alias("n"), F.col("real").alias("distance"), ((F.col("extreme") + 1) / (shuffles + 1)).alias("p"))
