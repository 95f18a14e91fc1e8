"""Topic contexts, token budgets and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T

MAX_TOKENS, CHUNK_CHARS, TOP_ENTITIES, TOP_RELATIONS, MIN_LEFT = 8000, 2000, 50, 50, 500


def topic_chunks(assignments: DataFrame, has_entity: DataFrame, chunks: DataFrame) -> DataFrame:
    """(community, chunk_id, ord, text): the chunks that mention a topic's members, each once."""
    hits = assignments.join(has_entity, assignments.id == has_entity.entity).select("community", "chunk_id").distinct()
    return hits.join(chunks.select("chunk_id", "ord", "text"), "chunk_id")


def prefix_within(rows: DataFrame, group: str, order: list[str], tokens: str, budget: int, used: str | None = None) -> DataFrame:
    """The rows of each group whose running token sum, on top of ``used``, stays below ``budget``. Sums only grow, so this is the prefix."""
    running = F.sum(tokens).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", running + (F.col(used) if used else F.lit(0))).where(F.col("running") < budget)


def contexts(assignments: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(community, entities, relationships, sub_summaries, chunk_texts): what a summariser reads of each topic.

    Entities: the first 50 by degree. Relations: the first 50. Sub-summaries: all or none, by budget. Chunks: 2000 characters each, in order,
    while 8000 estimated tokens last and only if 500 are left. Window limits keep 50 rows a topic in each task before any shuffle.
    """
    ents = assignments.join(entities.select("id", "name", "degree"), "id")
    top = ents.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("degree"), "id"))).where(F.col("r") <= TOP_ENTITIES)
    e = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("entities"))
    rel = relations.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("src", "dst"))).where(F.col("r") <= TOP_RELATIONS)
    r = rel.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "src", "label", "dst"))), lambda x: F.concat_ws(" ", x["src"], x["label"], x["dst"])).alias("relationships"))
    empty = F.expr("cast(array() as array<string>)")
    base = e.join(r, "community", "left").withColumn("relationships", F.coalesce("relationships", empty))
    if summaries is not None:
        base = base.join(summaries.groupBy("community").agg(F.array_sort(F.collect_list("summary")).alias("subs")), "community", "left")
    else:
        base = base.withColumn("subs", empty)
    size = lambda c: T.token_estimate(F.array_join(c, "\n"))
    base = base.withColumn("subs", F.coalesce("subs", empty)).withColumn("used", size("entities") + size("relationships"))
    base = base.withColumn("sub_summaries", F.when(F.col("used") + size("subs") < MAX_TOKENS, F.col("subs")).otherwise(empty))
    base = base.withColumn("used", F.col("used") + size("sub_summaries"))
    cut = chunks.withColumn("part", F.concat(F.lit("<chunk>"), T.escape_angles(T.truncate(F.col("text"), CHUNK_CHARS)), F.lit("</chunk>")))
    fit = cut.join(base.where(MAX_TOKENS - F.col("used") > MIN_LEFT).select("community", "used"), "community").withColumn("tok", T.token_estimate(F.col("part")))
    fit = prefix_within(fit, "community", ["ord", "chunk_id"], "tok", MAX_TOKENS, "used")
    c = fit.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "part"))), lambda x: x["part"]).alias("chunk_texts"))
    return base.join(c, "community", "left").select("community", "entities", "relationships", "sub_summaries", F.coalesce("chunk_texts", empty).alias("chunk_texts"))


def template_summary(context: DataFrame) -> DataFrame:
    """The offline summariser: title, summary and findings from the context itself, in Column expressions."""
    title = F.concat_ws(" / ", F.slice("entities", 1, 3))
    first = F.substring(F.regexp_replace(F.coalesce(F.get("chunk_texts", F.lit(0)), F.lit("")), "</?chunk>", ""), 1, 200)
    summary = F.concat_ws(" ", F.concat(F.size("entities"), F.lit(" entities and "), F.size("relationships"), F.lit(" relationships.")), F.nullif(first, F.lit("")))
    findings = F.transform(F.slice("relationships", 1, 5), lambda x: F.struct(x.alias("summary"), F.lit("stated in the corpus").alias("explanation")))
    return context.select("community", title.alias("title"), summary.alias("summary"), findings.alias("findings"), F.size("entities").alias("entity_count"), F.size("relationships").alias("relationship_count"), F.size("chunk_texts").alias("chunk_count"))


def summarise(context: DataFrame, make: Callable[[], Callable[[dict], str]], tries: int = 4, wait: float = 1.5) -> DataFrame:
    """Summaries by a model that returns JSON text; a call that fails is tried again with growing waits, inside the worker. Output is repaired and parsed."""
    from kgspark.functions.jsonrepair import report

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = make()
        for b in batches:
            said = []
            for row in b.to_dict("records"):
                for k in range(tries):
                    try:
                        said.append(model(row))
                        break
                    except Exception as e:
                        if k == tries - 1 or not ("429" in str(e) or "rate" in str(e).lower()):
                            said.append(None)
                            break
                        time.sleep(wait * 2**k)
            yield pd.DataFrame({"community": b["community"], "said": said})

    kind = dict(context.dtypes)["community"]
    raw = context.mapInPandas(work, f"community {kind}, said string")
    return raw.withColumn("r", report(F.col("said"))).select("community", "r.title", "r.summary", "r.findings")


def write_back(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Topic nodes with title, summary, findings_json, counts and has_summary; nodes without a summary keep theirs."""
    s = summaries.select(F.concat(F.lit("TOPIC_"), F.col("community").cast("string")).alias("_t"), F.col("title").alias("_title"), F.col("summary").alias("_summary"), F.to_json("findings").alias("findings_json"), "entity_count", "relationship_count", "chunk_count")
    return nodes.join(s, nodes.id == s._t, "left").withColumns({"title": F.coalesce("_title", "title"), "summary": F.coalesce("_summary", "summary"), "has_summary": F.col("_t").isNotNull()}).drop("_t", "_title", "_summary")


def topic_text(chunks: DataFrame) -> DataFrame:
    """(community, text): a community's chunks in order. A topic's whole text is one row, as the reader of it needs."""
    return chunks.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text"))), lambda x: x["text"]), " ").alias("text"))


def claims(assignments: DataFrame, has_entity: DataFrame, claims_: DataFrame, sub_summaries: DataFrame) -> DataFrame:
    """(community, source, parts): sub-summaries where a topic has any, else the claims of its members' chunks."""
    found = assignments.join(has_entity, assignments.id == has_entity.entity).select("community", "chunk_id").distinct().join(claims_, "chunk_id")
    c = found.groupBy("community").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    s = sub_summaries.groupBy("community").agg(F.array_sort(F.collect_list("summary")).alias("subs"))
    both = c.join(s, "community", "full")
    return both.select("community", F.when(F.col("subs").isNotNull(), "sub_summaries").otherwise("claims").alias("source"), F.coalesce("subs", "claims").alias("parts"))


def frequent_entities(mentions: DataFrame, relations: DataFrame, least: int = 2) -> DataFrame:
    """(speech_id, name, n): entities of a speech with ``least`` mentions or more, or in a relation of it."""
    n = mentions.groupBy("speech_id", "name").agg(F.count("*").alias("n"))
    used = relations.select("speech_id", F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("used", F.lit(True))
    return n.join(used, ["speech_id", "name"], "left").where((F.col("n") >= least) | F.col("used")).select("speech_id", "name", "n")
