"""The speech layer: speakers, per-speech entities and overlays, global orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.graph import undirected


def speech_graph(speeches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents, speakers and speeches: DOCUMENT -HAS_SPEECH-> SPEECH, SPEAKER -HAS_SPEECH-> SPEECH."""
    sid = F.concat_ws("_SPEECH_", "doc_id", F.col("speech_order").cast("string"))
    who = F.concat(F.lit("SPEAKER_"), F.upper(F.regexp_replace("speaker", "\\s+", "_")))
    rows = speeches.select("doc_id", "speaker", "party", sid.alias("speech_id"), who.alias("speaker_id"))
    node = lambda key, kind, name: rows.select(F.col(key).alias("id"), F.lit(kind).alias("node_type"), F.col(name).alias("name")).distinct()
    edge = lambda a: rows.select(F.col(a).alias("src"), F.col("speech_id").alias("dst"), F.lit("HAS_SPEECH").alias("label"), F.lit("lexical_graph").alias("graph_type")).distinct()
    return node("doc_id", "DOCUMENT", "doc_id").unionByName(node("speaker_id", "SPEAKER", "speaker")).unionByName(node("speech_id", "SPEECH", "speech_id")), edge("doc_id").unionByName(edge("speaker_id"))


def chunk_order(rows: DataFrame, speech: str = "speech_order", chunk: str = "chunk_idx") -> DataFrame:
    return rows.withColumn("ord", F.col(speech).cast("bigint") * 1000 + F.col(chunk))


def speaker_mentions(mentions: DataFrame, speech_speaker: DataFrame) -> DataFrame:
    """(src, dst, label, weight): a speaker and the entities of their speeches."""
    rows = mentions.join(speech_speaker, "speech_id").groupBy(F.col("speaker_id").alias("src"), F.col("name").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return rows.withColumn("label", F.lit("SPEAKER_MENTIONS"))


def speech_triples(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations both ends of which are entities of one speech, with it."""
    m = mentions.select("speech_id", "name").distinct()
    a, b = m.select("speech_id", F.col("name").alias("src")), m.select("speech_id", F.col("name").alias("dst"))
    return relations.join(a, "src").join(b, ["speech_id", "dst"])


def speech_stats(triples: DataFrame, mentions: DataFrame) -> DataFrame:
    """(speech_id, entities, relations, density) of each speech's overlay."""
    n = mentions.groupBy("speech_id").agg(F.count_distinct("name").alias("entities"))
    e = triples.groupBy("speech_id").agg(F.count("*").alias("relations"))
    rows = n.join(e, "speech_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    return rows.withColumn("density", F.when(F.col("entities") > 1, F.col("relations") / (F.col("entities") * (F.col("entities") - 1))).otherwise(0.0))


def entity_speaker_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The undirected graph of entities and speakers; speakers without an edge stay as isolated nodes."""
    kept = nodes.where(F.col("node_type").isin("ENTITY_CONCEPT", "ENTITY", "SPEAKER"))
    ids = kept.select("id")
    return kept, undirected(edges.where("graph_type = 'entity_relation'").join(ids, F.col("src") == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi"))


def community_nodes(assignments: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COMMUNITY and SUBCOMMUNITY nodes with IN_COMMUNITY and PARENT_COMMUNITY edges."""
    from kgspark.operators.graph import hierarchy

    nodes, edges = hierarchy(assignments.select("id"), assignments, subs)
    swap = lambda c: F.regexp_replace(F.regexp_replace(c, "^SUBTOPIC_", "SUBCOMMUNITY_"), "^TOPIC_", "COMMUNITY_")
    nodes = nodes.withColumns({"id": swap(F.col("id")), "node_type": F.when(F.col("node_type") == "TOPIC", "COMMUNITY").otherwise("SUBCOMMUNITY")})
    return nodes, edges.withColumns({"dst": swap(F.col("dst")), "src": F.when(F.col("label") == "PARENT_TOPIC", swap(F.col("src"))).otherwise(F.col("src")), "label": F.replace("label", F.lit("TOPIC"), F.lit("COMMUNITY"))})


def split_by_type(nodes: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities, concepts): by type, with names of ``least`` letters or more."""
    named = nodes.where(F.length("name") >= least)
    concept = F.upper(F.coalesce("ontology_class", F.lit(""))).isin("CONCEPT", "")
    return named.where(~concept), named.where(concept)


def centrality_by_community(scores: DataFrame, assignments: DataFrame, k: int = 5) -> DataFrame:
    """(community, measure, id, score, rank): the best of each community and measure, from long-form scores."""
    from kgspark.operators.graph import top_k

    return top_k(scores.join(assignments, "id"), k, ["community", "measure"])
