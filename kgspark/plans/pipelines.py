"""Queries that run whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import resolve as R
from kgspark.operators import topics as T
from kgspark.operators.graph import degrees
from kgspark.operators.storage import cut
from kgspark.pipeline import build_graph, lexical_graph
from kgspark.plans.common import table
from kgspark.registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query()
def entity_degree_topk(spark: SparkSession, d: str) -> DataFrame:
    """Which entities are most connected: lines, chunks, extraction, coreference, upserts, degrees."""
    state = build_graph(_docs(spark, d))
    return degrees(state.relations).orderBy(F.desc("degree"), "id").limit(20)


@query()
def coreference_groups(spark: SparkSession, d: str) -> DataFrame:
    return build_graph(_docs(spark, d)).mapping


@query()
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    nodes = cut(p.select(F.col("name").alias("id"), "name", F.lit("Part").alias("ontology_class"), F.expr("cast(null as array<string>)").alias("aliases")), "nodes")
    edges = nodes.select(F.col("id").alias("src"), F.lit("hub").alias("dst"), F.lit("OF").alias("label"), F.lit(1.0).alias("weight"))
    return R.resolve(nodes, edges, 0.93)[2]


@query()
def topic_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Topics by document language, with entities, relations and chunk texts within the token budget."""
    state = build_graph(_docs(spark, d))
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("community"))
    chunks = state.chunks.join(lang, "doc").select("community", "chunk_id", "ord", "text")
    member = state.has_entity.join(chunks.select("chunk_id", "community"), "chunk_id").groupBy(F.col("entity").alias("id")).agg(F.min("community").alias("community"))
    ents = state.nodes.join(degrees(state.relations), "id").select("id", F.col("id").alias("name"), "degree")
    rel = state.relations.join(member.select(F.col("id").alias("_s"), "community"), F.col("src") == F.col("_s")).select("community", "src", "label", "dst")
    return T.template_summary(T.contexts(member, ents, rel, chunks))


@query()
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.graph import graph_stats

    state = build_graph(_docs(spark, d))
    nodes, edges = lexical_graph(state)
    return graph_stats(nodes, edges)


