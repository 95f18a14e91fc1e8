"""Topic-model baselines: document frequencies, coherence, diversity, LDA and the selection between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def document_frequency(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def topic_pairs(topics: DataFrame, topic: str = "topic", words: str = "words", top: int = 10) -> DataFrame:
    """(topic, i, j, wi, wj) for the ordered pairs j < i of a topic's first words."""
    listed = topics.select(F.col(topic).alias("topic"), F.slice(words, 1, top).alias("w"))
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice(F.col("w"), F.lit(1), i), lambda b, j: F.struct(i.alias("i"), j.alias("j"), a.alias("wi"), b.alias("wj")))))
    return listed.select("topic", F.explode(pairs).alias("p")).select("topic", "p.*")


def pair_counts(docs: DataFrame, pairs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(a, b, co) for the sorted pairs asked for. Documents are cut to the topics' words first, so a document emits pairs of those only."""
    wanted = pairs.select(F.least("wi", "wj").alias("a"), F.greatest("wi", "wj").alias("b")).where("a <> b").distinct()
    words = wanted.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    left = docs.select(F.col(key).alias("d"), F.explode(F.array_distinct(tokens)).alias("w")).join(words, "w", "left_semi")
    lists = left.groupBy("d").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    emitted = F.flatten(F.transform("ws", lambda a, i: F.transform(F.slice(F.col("ws"), i + 2, F.greatest(F.size("ws") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = lists.select(F.explode(emitted).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("co"))
    return counts.join(wanted, ["a", "b"], "left_semi")


def coherence(docs: DataFrame, topics: DataFrame, tokens: str = "tokens", key: str = "doc_id", top: int = 10) -> DataFrame:
    """(topic, umass_sum, umass_mean, npmi): UMass skips words no document has, NPMI skips pairs no document has; a pair in every document counts as 1."""
    n = docs.count()
    pairs = topic_pairs(topics, top=top)
    df = document_frequency(docs, tokens, key)
    co = pair_counts(docs, pairs, tokens, key)
    rows = pairs.join(df.select(F.col("w").alias("wi"), F.col("df").alias("di")), "wi", "left").join(df.select(F.col("w").alias("wj"), F.col("df").alias("dj")), "wj", "left")
    rows = rows.withColumns({"a": F.least("wi", "wj"), "b": F.greatest("wi", "wj")}).join(co, ["a", "b"], "left").withColumn("co", F.coalesce("co", F.lit(0)))
    umass = F.when(F.col("dj") > 0, F.log((F.col("co") + 1) / F.col("dj")))
    p = F.col("co") / F.lit(float(n))
    npmi = F.when((F.col("co") > 0) & (F.col("co") < n), F.log(p / ((F.col("di") / n) * (F.col("dj") / n))) / -F.log(p)).when((F.col("co") > 0) & (F.col("co") == n), F.lit(1.0))
    return rows.groupBy("topic").agg(F.coalesce(F.sum(umass), F.lit(0.0)).alias("umass_sum"), F.avg(umass).alias("umass_mean"), F.coalesce(F.avg(npmi), F.lit(0.0)).alias("npmi"))


def diversity(topics: DataFrame, words: str = "words", top: int = 10) -> DataFrame:
    w = topics.select(F.explode(F.slice(words, 1, top)).alias("w"))
    return w.agg((F.count_distinct("w") / F.count("*")).alias("diversity"))


def select_model(models: DataFrame) -> DataFrame:
    """The model of least rank sum over npmi, umass, diversity (high is good) and perplexity (low is good); ties by npmi, diversity, perplexity, then input order."""
    pos = lambda c: F.row_number().over(W.orderBy(*c, "ord"))
    ranks = pos([F.desc("npmi")]) + pos([F.desc("umass")]) + pos([F.desc("diversity")]) + pos([F.col("perplexity")])
    return models.withColumn("rank_sum", ranks).orderBy("rank_sum", F.desc("npmi"), F.desc("diversity"), "perplexity", "ord").limit(1)


def _counted(docs: DataFrame, fit_on: DataFrame, tokens: str, min_df: float, max_df: float, vocabulary: int):
    """(documents with uni- and bigram counts, vocabulary); the vocabulary is that of ``fit_on``."""
    from pyspark.ml.feature import CountVectorizer, NGram

    pairs = NGram(n=2, inputCol=tokens, outputCol="_bi")
    grams = lambda x: pairs.transform(x).withColumn("_grams", F.concat(tokens, "_bi"))
    counter = CountVectorizer(minDF=min_df, maxDF=max_df, vocabSize=vocabulary, inputCol="_grams", outputCol="features").fit(grams(fit_on))
    return counter.transform(grams(docs)), counter.vocabulary


def _fitted(train: DataFrame, test: DataFrame, names: list[str], k: int, max_iter: int, seed: int, words: int):
    """(topics, model, metrics) of one model; perplexity is exp of MLlib's bound on the log perplexity per token of ``test``."""
    import math

    from pyspark.ml.clustering import LDA

    model = LDA(k=k, maxIter=max_iter, seed=seed).fit(train)
    listed = F.array(*[F.lit(v) for v in names]) if names else F.expr("cast(array() as array<string>)")
    topics = model.describeTopics(words).select("topic", F.transform("termIndices", lambda i: F.element_at(listed, i + 1)).alias("words"))
    return topics, model, {"k": k, "log_likelihood": model.logLikelihood(test), "perplexity": math.exp(model.logPerplexity(test))}


def lda(docs: DataFrame, k: int, tokens: str = "tokens", max_iter: int = 50, seed: int = 42, min_df: float = 3, max_df: float = 0.7, vocabulary: int = 3000, words: int = 15, test_share: float = 0.0, key: str = "doc_id"):
    """(topics, doc_topics, metrics) by MLlib on uni- and bigram counts. With a ``test_share`` the model is fitted on the other documents and judged on these."""
    from pyspark.ml.functions import vector_to_array

    from kgspark.operators.lexical import hash_split

    split = hash_split(docs, test_share, seed, key)
    train = split.where("not is_test")
    data, names = _counted(split, train, tokens, min_df, max_df, vocabulary)
    seen = data.where("not is_test")
    topics, model, metrics = _fitted(seen, data.where("is_test") if test_share else seen, names, k, max_iter, seed, words)
    doc_topics = model.transform(data.drop("is_test")).withColumn("weights", vector_to_array("topicDistribution"))
    share = doc_topics.select(F.array_max("weights").alias("m"), (F.array_position("weights", F.array_max("weights"))).alias("t")).agg(F.avg("m").alias("mean_dominant"), F.count_distinct("t").alias("active_topics")).first()
    return topics, doc_topics, metrics | {"mean_dominant": share.mean_dominant, "active_topics": share.active_topics}


def lda_sweep(docs: DataFrame, ks: tuple[int, ...] = (6, 8, 12, 24, 36), tokens: str = "tokens", max_iter: int = 50, seed: int = 42, min_df: float = 3, max_df: float = 0.7, vocabulary: int = 3000, words: int = 15, test_share: float = 0.2, key: str = "doc_id"):
    """(candidates, selected, topics): one model for each k, fitted on the training documents, with its coherence and diversity, and its perplexity on the others; the model of least rank sum."""
    from kgspark.operators.lexical import hash_split
    from kgspark.operators.storage import cut

    split = hash_split(docs, test_share, seed, key)
    data, names = _counted(split, split.where("not is_test"), tokens, min_df, max_df, vocabulary)
    data = cut(data, "counts")
    train, test = data.where("not is_test"), data.where("is_test")
    rows, found = [], {}
    for i, k in enumerate(ks):
        topics, _, metrics = _fitted(train, test, names, k, max_iter, seed, words)
        found[k] = topics
        scores = coherence(data, topics, "_grams", key).agg(F.avg("npmi").alias("npmi"), F.avg("umass_mean").alias("umass")).first()
        rows.append((i, k, scores.npmi, scores.umass, diversity(topics).first()[0], metrics["perplexity"]))
    candidates = docs.sparkSession.createDataFrame(rows, "ord int, k int, npmi double, umass double, diversity double, perplexity double")
    selected = select_model(candidates)
    return candidates, selected, found[selected.first().k]


def tokens_of(text: Column, stop_words: list[str]) -> Column:
    from kgspark.functions.text import tokens

    return tokens(text, stop_words)
