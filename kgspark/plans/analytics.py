"""Queries of topic geometry, group statistics, coherence and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import coherence as C
from kgspark.operators import stats, vectors
from kgspark.plans.common import table
from kgspark.registry import query

_UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"WITH {_UNIT}, p AS (SELECT avg(list_inner_product(a.v, b.v)) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT (SELECT count(*) FROM u) AS n, round(1 - s, 6) AS separation, round(s, 6) AS overlap FROM p")
def topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    return vectors.separation(_emb(spark, d)).select("n", F.round("separation", 6).alias("separation"), F.round("overlap", 6).alias("overlap"))


@query("SELECT label, i::INT AS d, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(_emb(spark, d)).select("label", F.posexplode("centroid").alias("d", "m")).select("label", "d", F.round("m", 6).alias("m"))


@query(f"""WITH {_UNIT}, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(1 - list_inner_product(a.v, b.v)) AS s, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
    ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM p GROUP BY ALL)
    SELECT vec_id AS key, la AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM ab""")
def silhouette_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.silhouette(_emb(spark, d)).withColumn("s", F.round("s", 6))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
    SELECT a.label AS i, b.label AS j, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM c a JOIN c b ON a.label < b.label""")
def topic_similarities(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similarity_matrix(vectors.centroids(_emb(spark, d))).withColumn("sim", F.round("sim", 6))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s1, sum(n * m * m) AS s2, sum((n - 1) * v) AS w FROM g) SELECT k, CAST(n AS BIGINT) AS n, round(((s2 - s1 * s1 / n) / (k - 1)) / (w / (n - k)), 6) AS f, round((s2 - s1 * s1 / n) / (s2 - s1 * s1 / n + w), 9) AS eta2 FROM s""")
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    out = stats.anova(stats.group_stats(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"))
    return out.select("k", "n", F.round("f", 6).alias("f"), F.round("eta2", 9).alias("eta2"))


@query("""WITH g AS (SELECT c_mktsegment AS l, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment),
    p AS (SELECT a.l AS a, b.l AS b, a.n AS na, b.n AS nb, a.m - b.m AS d, a.v AS va, b.v AS vb FROM g a JOIN g b ON a.l < b.l ORDER BY 1, 2 LIMIT 20)
    SELECT a, b, round(d / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df,
      round(abs(d) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3 / (4 * (na + nb - 2) - 1)), 6) AS g, (SELECT count(*) * (count(*) - 1) // 2 FROM g) AS pairs FROM p""")
def welch_hedges(spark: SparkSession, d: str) -> DataFrame:
    out = stats.welch_pairs(stats.group_stats(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "c_mktsegment")
    return out.select("a", "b", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("g", 6).alias("g"), "pairs")


@query("""WITH r AS (SELECT c_nationkey, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer GROUP BY c_nationkey), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r)
    SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")
def pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"), F.count("*").alias("y"))
    return stats.correlations(r, "x", "y").select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""WITH r AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1), q AS (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier GROUP BY 1)
    SELECT count(*) AS n, round(avg(a - b), 6) AS mean_difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM r JOIN q USING (k)""")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("b"))
    return stats.paired_t(a.join(b, "k"), "a", "b").select("n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 6).alias("t"))


_TOK = "docs AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS w FROM documents)"
_TOP = f"""{_TOK}, f AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(w) AS w FROM docs) GROUP BY ALL),
    top AS (SELECT lang AS topic, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM f QUALIFY r <= 10)"""


def _topics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as token lists and, for each language, its most common words as a topic."""
    from kgspark.functions.text import tokens
    from kgspark.operators.graph import top_k

    docs = table(spark, d, "documents").select("doc_id", "lang", tokens(F.col("text")).alias("tokens"))
    freq = docs.select("lang", F.explode(F.array_distinct("tokens")).alias("id")).groupBy("lang", "id").agg(F.count("*").alias("score"))
    best = top_k(freq, 10, ["lang"])
    topics = best.groupBy(F.col("lang").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("words"))
    return docs, topics


@query(f"""WITH {_TOP}, df AS (SELECT w, count(*)::DOUBLE AS n FROM (SELECT unnest(w) AS w FROM docs) GROUP BY w), s AS (SELECT doc_id, unnest(w) AS w FROM docs), need AS (SELECT DISTINCT w FROM top), c AS (SELECT doc_id, w FROM s WHERE w IN (FROM need)),
    co AS (SELECT a.w AS a, b.w AS b, count(*)::DOUBLE AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY ALL), total AS (SELECT count(*)::DOUBLE AS n FROM docs),
    p AS (SELECT i.topic, coalesce(co.n, 0) AS co, di.n AS di, dj.n AS dj, total.n AS n FROM top i JOIN top j ON i.topic = j.topic AND j.r < i.r JOIN df di ON di.w = i.w JOIN df dj ON dj.w = j.w CROSS JOIN total LEFT JOIN co ON co.a = least(i.w, j.w) AND co.b = greatest(i.w, j.w))
    SELECT topic, round(sum(ln((co + 1) / dj)), 6) AS umass_sum, round(avg(ln((co + 1) / dj)), 6) AS umass_mean, round(coalesce(avg(CASE WHEN co > 0 AND co < n THEN ln((co / n) / ((di / n) * (dj / n))) / -ln(co / n) WHEN co = n THEN 1 END), 0), 6) AS npmi FROM p GROUP BY topic""")
def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    out = C.coherence(*_topics(spark, d))
    return out.select("topic", *[F.round(c, 6).alias(c) for c in ("umass_sum", "umass_mean", "npmi")])


@query(f"WITH {_TOP} SELECT round(count(DISTINCT w) / count(*), 9) AS diversity FROM top")
def topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    return C.diversity(_topics(spark, d)[1]).select(F.round("diversity", 9).alias("diversity"))


_MODELS = [(0, 6, 0.137, -1.784, 0.717, 6975.6), (1, 8, 0.145, -1.754, 0.613, 10615.7), (2, 12, 0.148, -1.551, 0.517, 19685.3), (3, 24, 0.160, -1.685, 0.492, 64094.0), (4, 36, 0.167, -1.677, 0.469, 156665.9)]


@query(f"""WITH m(ord, k, npmi, umass, diversity, perplexity) AS (VALUES {', '.join(map(str, _MODELS))}), r AS (SELECT k, npmi, diversity, perplexity, ord, row_number() OVER (ORDER BY npmi DESC, ord) + row_number() OVER (ORDER BY umass DESC, ord) + row_number() OVER (ORDER BY diversity DESC, ord) + row_number() OVER (ORDER BY perplexity, ord) AS s FROM m)
    SELECT k, s::INT AS rank_sum FROM r ORDER BY s, npmi DESC, diversity DESC, perplexity, ord LIMIT 1""")
def lda_select(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame(_MODELS, "ord int, k int, npmi double, umass double, diversity double, perplexity double")
    return C.select_model(m).select("k", "rank_sum")


@query()
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hashed_embedding(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), 32).select("id", "embedding")


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    return vectors.principal_components(_emb(spark, d), 5, keep=("id", "label"))[0]


@query()
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    a, b = (r.label for r in e.select("label").distinct().orderBy("label").limit(2).collect())
    return stats.permutation_test(e, "label", a, b, shuffles=100)


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.functions.text import tokens

    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return C.lda(docs, 4, max_iter=5)[0]
