"""One run from documents to artifacts, by settings: lexical graph, extraction, resolution, communities, topics, embeddings, separation, pruning, saving."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import pipeline
from kgspark.config import Settings
from kgspark.operators import communities, extract, graph, lexical, report, resolve, topics, vectors
from kgspark.operators.storage import cut
from kgspark.sinks.artifacts import SCHEMA
from kgspark.sinks.graph import graphml_lines, redact, write_store


@dataclass
class Run:
    """What a run made. ``stats`` has the figures of each step, ``errors`` the steps that failed: later steps go on with what there is."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    state: pipeline.KGState | None = None
    stats: dict = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)


def save_json(spark: SparkSession, value: object, folder: str) -> None:
    """A JSON document as a one-line text table, in any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(value, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def resolved(state: pipeline.KGState, threshold: float, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[pipeline.KGState, dict]:
    """The state with duplicate entities merged, and figures of the effect. ``embed`` adds ``embedding`` to (id, text); without one names and neighbours decide."""
    nodes = state.nodes.select("id", F.col("id").alias("name"), "ontology_class", "llm_type", F.expr("cast(null as array<string>)").alias("aliases"))
    with_vectors = nodes
    if embed is not None:
        vectors_of = embed(nodes.select("id", F.concat_ws(". This is a ", "name", "ontology_class").alias("text"))).select(F.col("id").alias("_v"), "embedding")
        with_vectors = nodes.join(vectors_of, nodes.id == F.col("_v"), "left").drop("_v")
    kept, relations, merges = resolve.resolve(with_vectors, state.relations, threshold)
    kept, relations, merges = cut(kept.drop("embedding"), "nodes"), cut(relations, "relations"), cut(merges, "merges")
    aliases = graph.alias_union(nodes, merges).withColumnRenamed("id", "_a").withColumnRenamed("aliases", "_aliases")
    kept = cut(kept.join(aliases, kept.id == F.col("_a"), "left").withColumn("aliases", F.coalesce("_aliases", "aliases")).drop("_a", "_aliases"), "nodes")
    to = merges.select(F.col("source").alias("_s"), "target")
    holds = cut(state.has_entity.join(to, F.col("entity") == F.col("_s"), "left").select("chunk_id", F.coalesce("target", "entity").alias("entity")).distinct(), "has_entity")
    figures = [r.asDict() for r in resolve.effect(nodes, kept, relations).collect()]  # a handful of rows
    return replace(state, nodes=kept, relations=relations, has_entity=holds), {"merged": merges.count(), "effect": figures}


def weighted(state: pipeline.KGState, settings: Settings) -> tuple[pipeline.KGState, int]:
    """Relations weighed by how alike their ends' walks are, and how many of them got a weight."""
    c = settings.community
    found = vectors.node2vec(state.relations, c.node2vec_dim, c.walk_length, c.num_walks, seed=c.seed)
    weights = cut(vectors.structural_weights(state.relations, found), "weights")
    return replace(state, relations=cut(graph.apply_weights(state.relations, weights), "relations")), weights.count()


def whole_graph(state: pipeline.KGState, topic_nodes: DataFrame, topic_edges: DataFrame, summaries: DataFrame, of_subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all layers, nodes with what their kind has: name, class, title and summary, and a text to embed."""
    said = summaries.select(F.concat(F.lit("TOPIC_"), F.col("community").cast("string")).alias("_t"), "title", "summary").unionByName(of_subs.select(F.concat(F.lit("SUBTOPIC_"), F.col("community")).alias("_t"), "title", "summary"))
    lexical_nodes, edges = pipeline.lexical_graph(state)
    ents = state.nodes.select(F.col("id").alias("_e"), "ontology_class")
    texts = state.chunks.select(F.col("chunk_id").alias("_c"), F.col("text"))
    base = lexical_nodes.unionByName(topic_nodes.select("id", "node_type"))
    nodes = base.join(ents, F.col("id") == F.col("_e"), "left").join(texts, F.col("id") == F.col("_c"), "left").join(said, F.col("id") == F.col("_t"), "left").drop("_e", "_c", "_t")
    nodes = nodes.withColumn("name", F.coalesce("title", "id"))
    return nodes, edges.unionByName(topic_edges.select("src", "dst", "label", F.lit("topic").alias("graph_type")))


def run(docs: DataFrame, settings: Settings | None = None, folder: str | None = None, extractor=None, summariser=None, embed=None, node2vec: bool = False, doc: str = "doc_id", text: str = "text") -> Run:
    """Run all steps over (doc, text). Models are injected; every one of them has a deterministic default. Artifacts go to ``folder``, where one is given."""
    settings, out, spark = settings or Settings(), Run(), docs.sparkSession
    embed = embed or (lambda df: vectors.hashed_embedding(df))
    topic_parts: tuple = ()

    def step(name: str, work: Callable[[], dict]) -> bool:
        try:
            out.stats[name] = work()
            return True
        except Exception as e:
            out.errors.append((name, str(e)))
            return False

    def extraction() -> dict:
        x = settings.extraction
        taken = lexical.first_documents(docs, settings.document_limit, doc)
        out.state = pipeline.build_graph(taken, x.chunk_size, x.chunk_overlap, settings.chunk_budget, settings.processing.coreference_threshold, doc, text, extract.extractor(extractor), *([tuple(x.labels)] if x.labels else []))
        return lexical.step_counters(out.state.segments, out.state.chunks).first().asDict() | {"entities": out.state.nodes.count(), "relations": out.state.relations.count()}

    def resolution() -> dict:
        out.state, figures = resolved(out.state, settings.processing.similarity_threshold, None)
        return figures

    def detection() -> dict:
        nonlocal topic_parts
        c, found = settings.community, {}
        grid = dict(resolutions=c.resolutions, runs=c.n_iterations, least=c.min_size, seed=c.seed)
        if node2vec:
            _, before = communities.search(out.state.nodes.select("id"), out.state.relations.withColumn("weight", F.lit(1.0)), **grid)
            found["modularity_baseline"] = max(r["modularity"] for r in before)
            out.state, found["weighted"] = weighted(out.state, settings)
        parts, cells = communities.search(out.state.nodes.select("id"), out.state.relations, **grid)
        found |= {"modularity": max(r["modularity"] for r in cells), "communities": parts.select("community").distinct().count()}
        topic_parts = pipeline.topic_layer(out.state, parts, c.seed, summariser)
        return found | {"topics": topic_parts[2].count(), "subtopics": topic_parts[3].count()}

    def assembly() -> dict:
        nodes, edges = whole_graph(out.state, *topic_parts)
        members = topic_parts[1].where("label = 'IN_TOPIC'").groupBy("dst").agg(F.slice(F.array_sort(F.collect_set("src")), 1, 10).alias("members"))  # names of one topic
        texts = vectors.embedding_text(nodes.join(members, nodes.id == members.dst, "left"))
        out.nodes = cut(nodes.join(embed(texts).select(F.col("id").alias("_v"), "embedding"), nodes.id == F.col("_v"), "left").drop("_v"), "nodes")
        out.edges = cut(edges, "edges")
        return {"nodes": out.nodes.count(), "edges": out.edges.count()}

    def separation() -> dict:
        return report.separation_report(out.nodes, out.edges)

    def pruning() -> dict:
        rel = out.state.relations.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "confidence")
        known = out.edges.join(rel, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")) & (F.col("graph_type") == "entity_relation"), "left").drop("_s", "_d")
        nodes, edges = pipeline.prune(out.nodes, known, settings.processing.min_edge_confidence)
        out.nodes, out.edges = cut(nodes, "nodes"), cut(edges, "edges")
        return {"nodes": out.nodes.count(), "edges": out.edges.count()}

    def saving() -> dict:
        import dataclasses

        done = write_store(out.nodes, out.edges, f"{folder}/store", clean=True)
        graphml_lines(out.nodes.drop("embedding"), out.edges).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/graph.graphml")
        for name, value in (("schema", SCHEMA), ("resolution", out.stats.get("resolution")), ("separation", out.stats.get("separation")), ("settings", redact(dataclasses.asdict(settings)))):
            save_json(spark, value, f"{folder}/{name}.json")
        return done

    if step("extraction", extraction):
        step("resolution", resolution)
        if step("communities", detection) and step("assembly", assembly):
            step("separation", separation)
            if settings.processing.enable_pruning:
                step("pruning", pruning)
            if folder:
                step("saving", saving)
    if folder:
        save_json(spark, {"stats": out.stats, "errors": out.errors}, f"{folder}/run.json")
    return out
