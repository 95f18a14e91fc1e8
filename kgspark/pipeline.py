"""The pipeline: documents -> lexical graph -> entity graph -> topics, as stages over the typed tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.labels import DEFAULT_LABELS
from kgspark.operators import communities, enrich, extract, graph, lexical, topics
from kgspark.operators.storage import cut


@dataclass
class KGState:
    """The tables of a run. Every stage returns new ones; nothing is changed in place."""

    segments: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    triplets: DataFrame
    mapping: DataFrame
    nodes: DataFrame
    relations: DataFrame
    has_entity: DataFrame
    errors: list[str] = field(default_factory=list)


def build_graph(docs: DataFrame, size: int = 256, overlap: int = 32, max_chunks: int = 0, coreference: float = 0.85, doc: str = "doc_id", text: str = "text", extractor=None, labels: tuple[str, ...] = DEFAULT_LABELS) -> KGState:
    """From (doc, text) to entity nodes and relations.

    ``extractor`` makes a model; the default needs none. A model gets each chunk's eligible mentions as hints and the labels found in it, and only what is grounded in these stays.
    """
    segs = lexical.segments(docs, doc, text)
    parts = lexical.chunk_budget(lexical.chunks(segs, size, overlap), max_chunks, ["doc", "segment_idx", "chunk_idx"])
    found = extract.default_extraction(parts)
    # one written table holds chunks and their mentions: all later stages start from it
    found = cut(found.withColumn("ord", F.struct("doc", "segment_idx", "chunk_idx")), "chunks")
    mentions = extract.mention_rows(found, ["segment_id", "chunk_id", "ord"]).select("segment_id", "chunk_id", "pos", "name", "label", F.struct("ord", "pos").alias("ord"), F.lit(1.0).alias("confidence"))
    if extractor is None:
        trip = extract.pair_relations(found, ["segment_id", "chunk_id", "ord"]).withColumn("ord", F.struct("ord", "pos"))
    else:
        known = mentions.select("chunk_id", "pos", F.col("name").alias("text"), "label", F.col("label").alias("ontology_label"), "confidence")
        raw = extract.guided_triplets(found.select("chunk_id", "text"), known, extractor, list(labels)).where("kept").drop("kept", "drop_reason")
        at = found.select(F.col("chunk_id").alias("_c"), "segment_id", F.col("ord").alias("_o"))
        trip = raw.join(at, raw.chunk_id == F.col("_c")).withColumn("ord", F.struct(F.col("_o").alias("ord"), "pos")).drop("_c", "_o")
    names = mentions.select("segment_id", "name").unionByName(trip.select("segment_id", F.explode(F.array("source", "target")).alias("name")))
    mapping = cut(enrich.coreference(names, coreference), "mapping")
    mapped = enrich.apply_mapping(trip, mapping)
    ends = F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("llm_type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("llm_type"))))
    typed = mapped.select(ends.alias("x"), "ord").select("x.name", "x.llm_type", F.lit(None).cast("string").alias("ner_label"), "ord")
    m = mapping.select(F.col("segment_id").alias("_s"), F.col("name").alias("_n"), "canonical")
    seen = mentions.join(m, (F.col("segment_id") == F.col("_s")) & (F.col("name") == F.col("_n")), "left").select(F.coalesce("canonical", "name").alias("name"), F.lit(None).cast("string").alias("llm_type"), F.col("label").alias("ner_label"), "ord")
    nodes = cut(enrich.entity_nodes(typed.unionByName(seen)), "nodes")
    rel = mapped.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("relation").alias("label"), "segment_id", "confidence", "evidence", F.lit(1.0).alias("weight"), "ord")
    relations = cut(enrich.upsert_edges(rel, ["label", "segment_id", "confidence", "evidence", "weight"]).withColumn("graph_type", F.lit("entity_relation")), "relations")
    return KGState(segs, found, mentions, trip, mapping, nodes, relations, enrich.has_entity(mentions, mapping))


def lexical_graph(state: KGState) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole graph: documents, segments, chunks, entities, and the edges between them."""
    s, c = state.segments, state.chunks
    doc = F.concat(F.lit("DOC_"), F.col("doc").cast("string"))
    nodes = s.select(doc.alias("id"), F.lit("DOC").alias("node_type")).distinct()
    nodes = nodes.unionByName(s.select(F.col("segment_id").alias("id"), F.lit("SEGMENT").alias("node_type"))).unionByName(c.select(F.col("chunk_id").alias("id"), F.lit("CHUNK").alias("node_type"))).unionByName(state.nodes.select("id", F.lit("ENTITY_CONCEPT").alias("node_type")))
    edge = lambda df, a, b, label: df.select(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"), F.lit("lexical_graph").alias("graph_type"))
    edges = edge(s, doc, F.col("segment_id"), "HAS_SEGMENT").unionByName(edge(c, F.col("segment_id"), F.col("chunk_id"), "HAS_CHUNK")).unionByName(edge(state.has_entity, F.col("chunk_id"), F.col("entity"), "HAS_ENTITY"))
    return nodes, edges.unionByName(state.relations.select("src", "dst", "label", "graph_type"))


def prune(nodes: DataFrame, edges: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    kept = graph.prune_low_confidence(edges, least)
    return graph.prune_isolated(nodes, kept), kept


def topic_layer(state: KGState, parts: DataFrame, seed: int = 42, summariser=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(topic nodes, topic edges, summaries of topics, of sub-topics) of a partition. Sub-topics are summarised first, and topics read their summaries."""
    parts = parts.withColumn("community", F.col("community").cast("bigint"))
    subs = cut(communities.subcommunities(state.relations, parts, 2, seed), "subs")
    nodes, edges = graph.hierarchy(state.nodes, parts, subs)
    ents = state.nodes.join(graph.degrees(state.relations), "id").select("id", F.col("id").alias("name"), "degree")
    say = topics.template_summary if summariser is None else lambda c: topics.summarise(c, summariser)

    def told(members: DataFrame, below: DataFrame | None = None) -> DataFrame:
        chunks = topics.topic_chunks(members, state.has_entity, state.chunks)
        rel = graph.induced(state.relations, members).select("community", "src", "label", "dst")
        return cut(say(topics.contexts(members, ents, rel, chunks, below)), "summaries")

    of_subs = told(subs.select("id", F.concat_ws("_", F.col("community").cast("string"), F.col("sub_id").cast("string")).alias("community")))
    below = of_subs.where("summary is not null").select(F.split("community", "_")[0].cast("bigint").alias("community"), "summary")
    return nodes, edges, told(parts, below), of_subs


def summarised_topics(state: KGState, gamma: float = 1.0, seed: int = 42, summariser=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topic nodes, topic edges, summaries): communities, sub-communities, hierarchy, contexts, and a summary of each topic."""
    parts = cut(communities.partition(state.nodes.select("id"), state.relations, gamma, seed), "parts")
    return topic_layer(state, parts, seed, summariser)[:3]


def iterate(pool: DataFrame, rounds: int = 5, batch: int = 100, seed: int = 42) -> list[dict]:
    """The growing graph: each round draws a seeded batch of lines, adds it, and measures communities of the whole so far. One row of figures a round."""
    rows, sofar = [], None
    for k in range(rounds):
        drawn = cut(lexical.sample_lines(pool, batch, seed, k), "batch")
        sofar = drawn if sofar is None else cut(sofar.unionByName(drawn).distinct(), "sofar")
        state = build_graph(sofar.select(F.concat_ws(":", "filename", F.col("line_number").cast("string")).alias("doc_id"), F.col("content").alias("text")))
        parts = cut(communities.partition(state.nodes.select("id"), state.relations, 1.0, seed), "parts")
        size = graph.community_sizes(parts).first()
        q = graph.modularity(state.relations, parts).first()[0]
        rows.append({"iteration": k, "lines": sofar.count(), "entities": state.nodes.count(), "relations": state.relations.count(), "communities": size.communities, "modularity": q})
    return rows
