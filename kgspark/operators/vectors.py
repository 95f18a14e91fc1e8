"""Embeddings and topic geometry: separation, silhouettes, centroids, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.similarity import edge_weight, unit


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(id, text): what is embedded of each node, by its type."""
    kind = F.upper("node_type")
    entity = F.concat(F.col("name"), F.when(F.col("ontology_class").isNotNull(), F.concat(F.lit(". This is a "), F.col("ontology_class"))).otherwise(F.lit("")))
    topic = F.concat_ws(". ", "title", "summary", F.when(F.size(F.coalesce("members", F.expr("cast(array() as array<string>)"))) > 0, F.concat(F.lit("Entities: "), F.array_join(F.slice("members", 1, 10), ", "))))
    text = F.when(kind.isin("ENTITY_CONCEPT", "ENTITY", "PLACE"), entity).when(kind.isin("TOPIC", "SUBTOPIC"), topic).when(kind == "CHUNK", F.col("text")).when(kind.isin("EPISODE", "DAY"), F.substring("text", 1, 2000)).otherwise(F.col("name"))
    return nodes.select("id", text.alias("text"))


def hashed_embedding(texts: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """Adds ``embedding``: the offline default, hashed and signed token counts with unit norm, in built-in functions only."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter("_h", lambda h: F.pmod(h, F.lit(dim)) == d), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)))
    return texts.withColumn("_h", hashed).withColumn("_v", raw).withColumn("embedding", F.transform(unit(F.col("_v")), lambda x: x.cast("float"))).drop("_h", "_v")


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 32) -> DataFrame:
    """Adds ``embedding`` by a model that each worker loads once and that sees ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            values = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(values), batch):
                out += [np.asarray(v, dtype=np.float32) for v in model(values[i : i + batch])]
            yield pd.Series(out, index=s.index)

    return texts.withColumn("embedding", run(F.col(text)))


def random_embedding(rows: DataFrame, dim: int = 384, seed: int = 42) -> DataFrame:
    """Seeded pseudo-random vectors by id; for tests."""
    return rows.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.pmod(F.xxhash64("id", d, F.lit(seed)), F.lit(20001)) / 10000 - 1).cast("float")))


def _dims(rows: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    return rows.select(*keep, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("d", "x"))


def separation(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(n, separation, overlap): mean pairwise cosine distance and similarity, in closed form from the sum of unit vectors; no pairs are formed."""
    u = rows.where(F.col(vector).isNotNull()).select(unit(F.col(vector)).alias("u"))
    sums = _dims(u, [], "u").groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).agg((F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("off"))
    n = u.agg(F.count("*").alias("n"))
    over = F.when(F.col("n") > 1, F.col("off") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return n.join(F.broadcast(sums)).select("n", F.when(F.col("n") > 1, 1 - over).otherwise(0.0).alias("separation"), over.alias("overlap"))


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): mean vectors; sums by (label, dimension) are partial, so a hot label is many small partial rows."""
    each = _dims(rows.where(F.col(vector).isNotNull()), [label], vector).groupBy(label, "d").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("a")).select(label, F.transform("a", lambda x: x["m"]).alias("centroid"))


def silhouette(rows: DataFrame, label: str = "label", vector: str = "embedding", key: str = "id") -> DataFrame:
    """(key, label, s) by cosine distance. With unit vectors the distance sum to a cluster is n_C - x.S_C, so each point meets cluster sums only.

    Guards: at least 3 points, 2 to max(1, n/2) clusters below n; otherwise no rows. A cluster of one has s = 0.
    Cluster sums are k rows of one vector: they are broadcast by size, or shuffled, as the planner finds.
    """
    u = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), unit(F.col(vector)).alias("u"))
    size = u.groupBy("label").agg(F.count("*").alias("n"))
    row = size.agg(F.sum("n"), F.count("*")).first()
    n, k = row[0] or 0, row[1]
    if n < 3 or not 2 <= k < n or k > max(1, n // 2):
        return u.select("key", "label", F.lit(0.0).alias("s")).limit(0)
    sums = _dims(u, ["label"], "u").groupBy("label", "d").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("a")).join(size, "label")
    table = sums.agg(F.array_sort(F.collect_list(F.struct("label", F.transform("a", lambda x: x["s"]).alias("v"), "n"))).alias("t"))  # one row a cluster
    dotted = F.transform("t", lambda c: F.struct(c["label"].alias("l"), c["n"].alias("n"), F.aggregate(F.zip_with("u", c["v"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("p")))
    own = F.filter("c", lambda x: x["l"] == F.col("label"))[0]
    a = (own["n"] - own["p"] - (1 - F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("c", lambda x: x["l"] != F.col("label")), lambda x: 1 - x["p"] / x["n"]))
    scored = u.join(F.broadcast(table)).withColumn("c", dotted).select("key", "label", own["n"].alias("own"), F.when(own["n"] > 1, a).alias("a"), b.alias("b"))
    return scored.select("key", "label", F.when(F.col("own") == 1, 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def silhouette_summary(samples: DataFrame) -> DataFrame:
    """(label, n, s) by cluster, and overall under a null label."""
    return samples.groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("s")).unionByName(samples.agg(F.lit(None).cast(dict(samples.dtypes)["label"]).alias("label"), F.count("*").alias("n"), F.avg("s").alias("s")))


def similarity_matrix(rows: DataFrame, label: str = "label", vector: str = "centroid") -> DataFrame:
    """(i, j, sim) for i < j. The rows are topics; each row carries the table of those behind it, so no cross join is planned."""
    u = rows.select(F.col(label).alias("l"), unit(F.col(vector)).alias("u"))
    table = u.agg(F.array_sort(F.collect_list(F.struct("l", "u"))).alias("t"))
    pairs = u.join(F.broadcast(table)).select(F.col("l").alias("i"), "u", F.explode(F.filter("t", lambda x: x["l"] > F.col("l"))).alias("o"))
    return pairs.select("i", F.col("o.l").alias("j"), F.aggregate(F.zip_with("u", "o.u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("sim"))


def similarity_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("sim").alias("mean"), F.max("sim").alias("max"), F.min("sim").alias("min"), F.stddev_pop("sim").alias("std"))


def most_distinct(pairs: DataFrame, share: float = 0.1) -> DataFrame:
    """(id, mean): rows whose mean similarity to the others is at most the given percentile."""
    each = pairs.select(F.explode(F.array("i", "j")).alias("id"), "sim").groupBy("id").agg(F.avg("sim").alias("mean"))
    return each.join(F.broadcast(each.agg(F.percentile("mean", F.lit(share)).alias("p")))).where("mean <= p").select("id", "mean")


def principal_components(rows: DataFrame, k: int = 10, standardise: bool = False, vector: str = "embedding", keep: tuple[str, ...] = ("id",)) -> tuple[DataFrame, list[float]]:
    """(rows with ``pc`` array, explained variance ratios). Covariance is summed over the cluster; only the d x d matrix reaches the driver."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.where(F.col(vector).isNotNull()).select(*keep, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    scaled = StandardScaler(withMean=True, withStd=standardise, inputCol="_v", outputCol="_z").fit(data).transform(data)
    first = data.select(F.size(vector_to_array("_v")).alias("n")).first()
    k = min(k, first.n if first else 0)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaled)
    return model.transform(scaled).select(*keep, vector_to_array("_p").alias("pc")), [float(x) for x in model.explainedVariance]


def node2vec(edges: DataFrame, dim: int = 64, walk_length: int = 16, walks: int = 20, window: int = 10, seed: int = 42) -> DataFrame:
    """(id, structural): random walks by iterated joins, then skip-gram. Each step picks one neighbour by weighted reservoir (least -ln(u)/w)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from kgspark.operators.storage import cut, discard

    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    near = cut(both.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("near")), "near")
    if near.limit(5).count() < 5:
        return near.select(F.col("src").cast("string").alias("id"), F.lit(None).cast("array<double>").alias("structural")).limit(0)
    walk = cut(near.select(F.col("src").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w")).select("at", "w", F.array(F.col("at").cast("string")).alias("path")), "walk")
    for step in range(walk_length - 1):
        joined = walk.join(near, walk.at == near.src)
        draw = lambda x: F.struct((-F.log((F.pmod(F.xxhash64("path", F.col("w"), F.lit(seed + step), x["dst"]), F.lit(1_000_003)) + 1) / 1_000_004.0) / x["weight"]).alias("t"), x["dst"].alias("dst"))  # noqa: B023, E731
        new = cut(joined.withColumn("_n", F.array_min(F.transform("near", draw))["dst"]).select(F.col("_n").alias("at"), "w", F.concat("path", F.array(F.col("_n").cast("string"))).alias("path")), "walk")
        discard(walk)
        walk = new
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, maxIter=1, inputCol="path", outputCol="v").fit(walk)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("structural"))


def structural_weights(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, dst, weight): clamped cosine of the ends' structural vectors."""
    s, t = vectors.select(F.col("id").alias("_s"), F.col("structural").alias("_a")), vectors.select(F.col("id").alias("_t"), F.col("structural").alias("_b"))
    rows = edges.join(s, F.col("src").cast("string") == F.col("_s")).join(t, F.col("dst").cast("string") == F.col("_t"))
    return rows.select("src", "dst", edge_weight(F.col("_a"), F.col("_b")).alias("weight"))


def distmult(triples: DataFrame, dim: int = 64, epochs: int = 50, seed: int = 42, group: str | None = None) -> DataFrame:
    """(group, id, vector): DistMult embeddings by stochastic gradient, one group (such as a speech or component) a task."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        ents, rels = sorted({*g["src"], *g["dst"]}), sorted(set(g["label"]))
        ie, ir = {x: i for i, x in enumerate(ents)}, {x: i for i, x in enumerate(rels)}
        rnd = np.random.default_rng(seed)
        e, r = rnd.normal(0, 0.1, (len(ents), dim)), rnd.normal(0, 0.1, (len(rels), dim))
        s, p, o = (np.array([m[x] for x in g[c]]) for m, c in ((ie, "src"), (ir, "label"), (ie, "dst")))
        for _ in range(epochs):
            bad = rnd.integers(0, len(ents), len(s))
            for obj, y in ((o, 1.0), (bad, 0.0)):
                f = 1 / (1 + np.exp(-(e[s] * r[p] * e[obj]).sum(axis=1))) - y
                de, dr, do = f[:, None] * r[p] * e[obj], f[:, None] * e[s] * e[obj], f[:, None] * e[s] * r[p]
                for m, at, d in ((e, s, de), (r, p, dr), (e, obj, do)):
                    np.add.at(m, at, -0.1 * d)
        return pd.DataFrame({"group": [str(g["group"].iloc[0])] * len(ents), "id": [str(x) for x in ents], "vector": [v.astype("float64").tolist() for v in e]})

    rows = triples.select((F.col(group) if group else F.lit("all")).cast("string").alias("group"), "src", "label", "dst")
    return rows.groupBy("group").applyInPandas(work, "group string, id string, vector array<double>")


def rank_rows(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order)))
