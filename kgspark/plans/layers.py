"""Queries of the enrichment, topic, speech, ontology and sink layers, each on inputs made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions import text as T
from kgspark.operators import enrich, extract, graph, lexical, report, speech, topics, vectors
from kgspark.operators import resolve as R
from kgspark.plans.common import SQL_LINES, SQL_TRADE, lines, table, trade_edges, trade_nodes
from kgspark.plans.texts import _CLASS, _NORM, _STD
from kgspark.registry import query
from kgspark.sinks import graph as sinks
from kgspark.sources import files, rdf

#: Capitals of the sharp s differ between the two engines.
_PLAIN_TEXT = "replace(text, 'ß', 'ss')"
_FIRST = _STD.format(f"regexp_extract({_PLAIN_TEXT}, '[^ ]+')")
#: A mention a turn: the first word of its text, in the segment of its conversation.
SQL_MENTIONS = f"""m AS (SELECT CAST(conv_id AS VARCHAR) AS segment_id, conv_id || ':' || turn AS chunk_id, turn, role, {_FIRST} AS name, role AS label, (length(text) % 10) / 10.0::DOUBLE AS confidence, conv_id * 1000 + turn AS ord, text FROM conversations),
    mapping AS (SELECT DISTINCT segment_id, name, name[1:2] AS canonical FROM m WHERE length(name) % 2 = 0)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    name = L.standardize_label(F.regexp_extract(F.expr(_PLAIN_TEXT), "[^ ]+", 0))
    return c.select(
        F.col("conv_id").cast("string").alias("segment_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "turn", "role", name.alias("name"), F.col("role").alias("label"),
        ((F.length("text") % 10) / 10.0).alias("confidence"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text",
    )


def _mapping(m: DataFrame) -> DataFrame:
    return m.where(F.length("name") % 2 == 0).select("segment_id", "name", F.substring("name", 1, 2).alias("canonical")).distinct()


@query(f"WITH {SQL_MENTIONS} SELECT segment_id, name, label FROM m QUALIFY row_number() OVER (PARTITION BY segment_id, name ORDER BY confidence DESC, ord DESC) = 1")
def best_labels(spark: SparkSession, d: str) -> DataFrame:
    return enrich.best_labels(_mentions(spark, d))


@query(f"""WITH {SQL_MENTIONS}, t AS (SELECT name, ord, CASE WHEN turn % 3 = 0 AND ord % 7 = 0 THEN upper(role) END AS llm, CASE WHEN turn % 2 = 0 THEN 'Concept' ELSE role END AS ner FROM m)
    SELECT name AS id, coalesce(arg_max(llm, ord), arg_min(ner, ord) FILTER (WHERE ner <> 'Concept'), 'Concept') AS ontology_class, arg_max(llm, ord) AS llm_type FROM t GROUP BY name""")
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    llm = F.when((F.col("turn") % 3 == 0) & (F.col("ord") % 7 == 0), F.upper("role"))
    return enrich.entity_nodes(_mentions(spark, d).select("name", llm.alias("llm_type"), F.when(F.col("turn") % 2 == 0, "Concept").otherwise(F.col("role")).alias("ner_label"), "ord"))


@query(f"WITH {SQL_MENTIONS} SELECT name AS src, role AS dst, arg_min(chunk_id, ord) AS label, array_to_string(list_sort(list_distinct(list(segment_id))), ',') AS extracted_from FROM m GROUP BY name, role")
def upsert_first(spark: SparkSession, d: str) -> DataFrame:
    e = _mentions(spark, d).select(F.col("name").alias("src"), F.col("role").alias("dst"), F.col("chunk_id").alias("label"), "ord", "segment_id")
    return enrich.upsert_first(e, ["label"], "segment_id").withColumn("extracted_from", F.array_join("extracted_from", ","))


@query(f"""WITH {SQL_MENTIONS} SELECT * FROM (SELECT m.segment_id, chunk_id, coalesce(a.canonical, m.name) AS source, coalesce(b.canonical, m.name[1:2]) AS target FROM m
    LEFT JOIN mapping a ON a.segment_id = m.segment_id AND a.name = m.name LEFT JOIN mapping b ON b.segment_id = m.segment_id AND b.name = m.name[1:2]) WHERE source <> target""")
def mapped_relations(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return enrich.apply_mapping(m.select("segment_id", "chunk_id", F.col("name").alias("source"), F.substring("name", 1, 2).alias("target")), _mapping(m))


@query(f"WITH {SQL_MENTIONS} SELECT DISTINCT chunk_id, coalesce(canonical, m.name) AS entity FROM m LEFT JOIN mapping USING (segment_id, name)")
def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return enrich.has_entity(m, _mapping(m))


@query(f"WITH {SQL_TRADE}, n AS (SELECT id FROM nodes WHERE community < 12) SELECT src, dst, weight FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)")
def edges_between_nodes(spark: SparkSession, d: str) -> DataFrame:
    return enrich.with_nodes_only(trade_edges(spark, d), trade_nodes(spark, d).where("community < 12")).select("src", "dst", "weight")


@query(f"WITH {SQL_MENTIONS} SELECT DISTINCT segment_id AS segment, chunk_id AS chunk FROM m UNION SELECT segment_id, 'D' || segment_id FROM m")
def segment_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of even turns hang on their segment, those of odd turns on its conversation, and each segment has a context with one description."""
    m = _mentions(spark, d)
    edge = lambda rows, a, b, label: rows.select(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"))
    s, c = F.col("segment_id"), F.col("chunk_id")
    conv, ctx = F.concat(F.lit("V"), s), F.concat(F.lit("X"), s)
    e = edge(m.where("turn % 2 = 0"), s, c, "HAS_CHUNK").unionByName(edge(m, s, conv, "HAS_CONVERSATION")).unionByName(edge(m.where("turn % 2 = 1"), conv, c, "HAS_CHUNK"))
    return enrich.segment_chunks(e.unionByName(edge(m, s, ctx, "HAS_CONTEXT")).unionByName(edge(m, ctx, F.concat(F.lit("D"), s), "HAS_DESCRIPTION_CHUNK")))


@query(f"WITH {SQL_TRADE}, n AS (SELECT id FROM nodes WHERE community < 15 OR node_type = 'SUPPLIER') SELECT src, dst FROM edges WHERE weight > 1 AND src IN (FROM n) AND dst IN (FROM n)")
def entity_subgraph(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("node_type") == "SUPPLIER", "place").when(F.col("community") < 15, "ENTITY_CONCEPT").otherwise("CHUNK")
    e = trade_edges(spark, d).withColumn("graph_type", F.when(F.col("weight") > 1, "entity_relation").otherwise("lexical_graph"))
    return graph.entity_view(trade_nodes(spark, d).withColumn("node_type", kind), e)[1].select("src", "dst")


_KIND = "CASE role WHEN 'user' THEN 'PERSON' WHEN 'assistant' THEN 'EVENT' ELSE 'ORGANIZATION' END"
_MORE = _STD.format(f"CASE WHEN turn % 2 = 1 THEN regexp_extract({_PLAIN_TEXT}, '[^ ]+( [^ ]+)?') ELSE regexp_extract({_PLAIN_TEXT}, '[^ ]+') END")
_ELIGIBLE = f"""e AS (SELECT conv_id, turn, {_MORE} AS name, {_KIND} AS kind, (length(text) % 10) / 10.0::DOUBLE AS sure FROM conversations),
    ok AS (SELECT conv_id, turn, name, NOT ((NOT contains(name, '_') AND length(name) <= 3 AND kind IN ('PERSON', 'ORGANIZATION', 'LOCATION')) OR (NOT contains(name, '_') AND kind = 'PERSON') OR (kind = 'EVENT' AND sure < 0.5) OR (kind IN ('ORGANIZATION', 'LOCATION') AND sure < 0.6)) AS ok FROM e WHERE name <> '')"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "PERSON").when(F.col("role") == "assistant", "EVENT").otherwise("ORGANIZATION")
    plain = F.expr(_PLAIN_TEXT)
    words = F.when(F.col("turn") % 2 == 1, F.regexp_extract(plain, "[^ ]+( [^ ]+)?", 0)).otherwise(F.regexp_extract(plain, "[^ ]+", 0))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("pos"), words.alias("text"), kind.alias("label"), kind.alias("ontology_label"), ((F.length("text") % 10) / 10.0).alias("confidence"))


@query(f"""WITH {_ELIGIBLE}, kept AS (SELECT conv_id, name, min(turn) AS first FROM ok WHERE ok OR conv_id NOT IN (SELECT conv_id FROM ok WHERE ok) GROUP BY conv_id, name)
    SELECT conv_id AS chunk_id, string_agg(name, ',' ORDER BY first, name) AS names FROM kept GROUP BY conv_id""")
def eligible_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.eligible(_typed(spark, d)).withColumn("names", F.array_join("names", ","))


@query(f"SELECT conv_id AS chunk_id, string_agg(DISTINCT {_KIND}, ',' ORDER BY {_KIND}) AS labels FROM conversations GROUP BY conv_id")
def allowed_labels(spark: SparkSession, d: str) -> DataFrame:
    return extract.labels_found(_typed(spark, d), ["PERSON", "EVENT"]).withColumn("labels", F.array_join("labels", ","))


@query(f"WITH n AS (SELECT p_partkey, p_name, {_NORM.format('p_name')} AS n FROM part) SELECT p_partkey AS id, n AS canonical_form, {_CLASS} AS surface_class, {_CLASS} = 'named_entity' AS merge_candidate FROM n")
def mention_metadata(spark: SparkSession, d: str) -> DataFrame:
    return extract.surface_metadata(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))).drop("text")


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE role END AS relation, regexp_extract(text, '^[A-Za-z]+') AS s, regexp_extract(text, '[A-Za-z]+$') AS t, upper(role) AS h, {_STD.format('text')} AS ev, upper(regexp_extract(text, '^[A-Za-z]+')) AS f FROM conversations),
    u AS (SELECT conv_id, turn, s = '' OR t = '' OR relation = '' AS missing, upper(t) AS e, h, f, ev FROM t),
    v AS (SELECT *, (f <> '' AND (contains(e, f) OR contains(f, e))) OR contains(e, h) OR contains(h, e) AS hit FROM u)
    SELECT conv_id, turn, CASE WHEN missing THEN 'missing_triplet_field' WHEN NOT hit THEN 'endpoint_not_grounded_in_hints' END AS drop_reason, NOT missing AND hit AS kept FROM v""")
def grounded_triplets(spark: SparkSession, d: str) -> DataFrame:
    """The first word of a turn is said to relate to its last word; hints are the first word and the role."""
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    t = table(spark, d, "conversations").select("conv_id", "turn", first.alias("source"), F.regexp_extract("text", "[A-Za-z]+$", 0).alias("target"), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("role")).alias("relation"), F.col("text").alias("evidence"), F.array(first, "role").alias("hints"))
    return extract.ground(t).select("conv_id", "turn", "drop_reason", "kept")


@query(f"WITH {SQL_TRADE} SELECT src, dst, CASE WHEN weight > 1 THEN weight * 10 ELSE weight END AS weight FROM edges")
def applied_weights(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return graph.apply_weights(e, e.where("weight > 1").withColumn("weight", F.col("weight") * 10))


_MERGES = f"{SQL_TRADE}, merges AS (SELECT id AS source, 'S' || community AS target FROM nodes WHERE node_type = 'SUPPLIER' AND id <> 'S' || community AND 'S' || community IN (SELECT id FROM nodes))"


def _merges(n: DataFrame) -> DataFrame:
    target = F.concat(F.lit("S"), F.col("community").cast("string"))
    ids = n.select(F.col("id").alias("t"))
    return n.where("node_type = 'SUPPLIER'").select(F.col("id").alias("source"), target.alias("target")).where("source <> target").join(ids, F.col("target") == F.col("t"), "left_semi")


@query(f"""WITH {_MERGES}, a AS (SELECT id AS t, upper(name) AS a FROM nodes WHERE id NOT IN (SELECT source FROM merges) UNION SELECT target, unnest([upper(name), name, id]) FROM nodes JOIN merges ON id = source)
    SELECT t AS id, string_agg(a, ',' ORDER BY a) AS aliases FROM a GROUP BY t""")
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    n = trade_nodes(spark, d).withColumn("aliases", F.array(F.upper("name")))
    return graph.alias_union(n, _merges(n)).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""WITH {SQL_TRADE}, g AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), r AS (SELECT nodes.id, community, row_number() OVER (PARTITION BY community ORDER BY coalesce(k, 0) DESC, length(name) DESC, nodes.id) AS r FROM nodes LEFT JOIN g USING (id))
    SELECT a.id AS source, b.id AS target FROM r a JOIN r b ON a.community = b.community AND a.r > 1 AND b.r = 1""")
def canonical_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = trade_nodes(spark, d)
    return R.canonical_nodes(n.select("id", F.concat(F.lit("N"), F.col("community").cast("string")).alias("canonical_text")), n.select("id", "name"), trade_edges(spark, d))


@query(f"""WITH {_MERGES}, after AS (SELECT id, name FROM nodes WHERE id NOT IN (SELECT source FROM merges)), e AS (SELECT DISTINCT src, coalesce(target, dst) AS dst FROM edges LEFT JOIN merges ON dst = source),
    g AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) WHERE id IN (SELECT id FROM after) GROUP BY id), norm AS (SELECT {_NORM.format('name')} AS n FROM after)
    SELECT 'before' AS metric, NULL AS key, count(*) AS value FROM nodes UNION ALL SELECT 'after', NULL, count(*) FROM after UNION ALL SELECT 'merged', NULL, count(*) FROM merges
    UNION ALL (SELECT 'top_degree', id, k FROM g ORDER BY k DESC, id LIMIT 5) UNION ALL SELECT 'surface_class', {_CLASS}, count(*) FROM norm GROUP BY 2""")
def resolution_effect(spark: SparkSession, d: str) -> DataFrame:
    n = trade_nodes(spark, d)
    kept, edges = graph.merge_nodes(n, trade_edges(spark, d), _merges(n))
    return R.effect(n, kept, edges)


@query(f"WITH {SQL_MENTIONS} SELECT DISTINCT CAST(length(name) AS INT) AS community, chunk_id, ord, text FROM m")
def topic_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    parts = m.select(F.col("name").alias("id"), F.length("name").alias("community")).distinct()
    return topics.topic_chunks(parts, m.select("chunk_id", F.col("name").alias("entity")), m.select("chunk_id", "ord", "text")).select("community", "chunk_id", "ord", "text")


@query(f"WITH {SQL_MENTIONS} SELECT role AS community, string_agg(name, ' ' ORDER BY ord, chunk_id) AS text FROM m GROUP BY role")
def topic_text(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_text(_mentions(spark, d).select(F.col("role").alias("community"), "ord", "chunk_id", F.col("name").alias("text")))


@query(f"""WITH {SQL_MENTIONS}, c AS (SELECT length(name) AS community, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS p FROM m GROUP BY 1)
    SELECT CAST(community AS INT) AS community, CASE WHEN community % 2 = 0 THEN 'sub_summaries' ELSE 'claims' END AS source, CASE WHEN community % 2 = 0 THEN 'of ' || community ELSE p END AS parts FROM c""")
def topic_claims(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    parts = m.select(F.col("name").alias("id"), F.length("name").alias("community")).distinct()
    subs = parts.select("community").distinct().where("community % 2 = 0").select("community", F.concat(F.lit("of "), F.col("community").cast("string")).alias("summary"))
    return topics.claims(parts, m.select("chunk_id", F.col("name").alias("entity")), m.select("chunk_id", F.col("chunk_id").alias("claim")), subs).withColumn("parts", F.array_join("parts", ","))


@query(f"""WITH {SQL_MENTIONS}, n AS (SELECT segment_id, name, count(*) AS n FROM m GROUP BY ALL), used AS (SELECT DISTINCT segment_id, unnest([name, role]) AS name FROM m WHERE ord % 9 = 0)
    SELECT segment_id AS speech_id, name, n FROM n WHERE n >= 2 OR (segment_id, name) IN (SELECT (segment_id, name) FROM used)""")
def frequent_entities(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).withColumnRenamed("segment_id", "speech_id")
    return topics.frequent_entities(m.select("speech_id", "name"), m.where("ord % 9 = 0").select("speech_id", F.col("name").alias("source"), F.col("role").alias("target")))


@query("""SELECT 'TOPIC_' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'About ' || n_name ELSE n_name END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS summary,
    CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END AS entity_count, n_nationkey % 3 = 0 AS has_summary FROM nation""")
def summary_write_back(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("TOPIC_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit("old").alias("summary"))
    s = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("community"), F.concat(F.lit("About "), F.col("n_name")).alias("title"), F.lit("new").alias("summary"), F.array(F.struct(F.lit("a").alias("summary"))).alias("findings"), F.col("n_regionkey").alias("entity_count"), F.lit(0).alias("relationship_count"), F.lit(0).alias("chunk_count"))
    return topics.write_back(nodes, s).select("id", "title", "summary", "entity_count", "has_summary")


@query("SELECT conv_id AS speech_order, CAST(turn AS BIGINT) AS chunk_idx, conv_id * 1000 + turn AS ord FROM conversations")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    return speech.chunk_order(table(spark, d, "conversations").select(F.col("conv_id").alias("speech_order"), F.col("turn").cast("bigint").alias("chunk_idx")))


@query(f"WITH {SQL_MENTIONS} SELECT 'SPEAKER_' || role AS src, name AS dst, CAST(count(*) AS DOUBLE) AS weight, 'SPEAKER_MENTIONS' AS label FROM m JOIN (SELECT segment_id, min(role) AS role FROM m GROUP BY segment_id) s USING (segment_id) GROUP BY s.role, name".replace("'SPEAKER_' || role", "'SPEAKER_' || s.role"))
def speaker_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    who = m.groupBy(F.col("segment_id").alias("speech_id")).agg(F.concat(F.lit("SPEAKER_"), F.min("role")).alias("speaker_id"))
    return speech.speaker_mentions(m.select(F.col("segment_id").alias("speech_id"), "name"), who)


_OVERLAY = f"{SQL_MENTIONS}, rel AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM m a JOIN m b ON a.segment_id = b.segment_id AND b.turn = a.turn + 1), p AS (SELECT DISTINCT segment_id, name FROM m), t AS (SELECT a.segment_id AS speech_id, src, dst FROM rel JOIN p a ON a.name = src JOIN p b ON b.name = dst AND a.segment_id = b.segment_id)"


def _overlay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = _mentions(spark, d).select(F.col("segment_id").alias("speech_id"), "turn", "name")
    nxt = m.select(F.col("speech_id").alias("s"), (F.col("turn") - 1).alias("t"), F.col("name").alias("dst"))
    rel = m.join(nxt, (m.speech_id == nxt.s) & (m.turn == nxt.t)).select(F.col("name").alias("src"), "dst").distinct()
    return speech.speech_triples(rel, m), m


@query(f"WITH {_OVERLAY} SELECT speech_id, src, dst FROM t")
def speech_triples(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d)[0].select("speech_id", "src", "dst")


@query(f"WITH {_OVERLAY}, n AS (SELECT segment_id, count(*) AS n FROM p GROUP BY segment_id), e AS (SELECT speech_id, count(*) AS k FROM t GROUP BY speech_id) SELECT segment_id AS speech_id, n AS entities, coalesce(k, 0) AS relations, round(CASE WHEN n > 1 THEN coalesce(k, 0) / (n * (n - 1)) ELSE 0 END, 9) AS density FROM n LEFT JOIN e ON segment_id = speech_id")
def speech_stats(spark: SparkSession, d: str) -> DataFrame:
    return speech.speech_stats(*_overlay(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {SQL_TRADE} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE weight > 1 AND (a.community < 20) AND (b.community < 20) GROUP BY ALL")
def entity_speaker_graph(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("community") >= 20, "CHUNK").when(F.col("node_type") == "SUPPLIER", "SPEAKER").otherwise("ENTITY_CONCEPT")
    e = trade_edges(spark, d).withColumn("graph_type", F.when(F.col("weight") > 1, "entity_relation").otherwise("lexical_graph"))
    return speech.entity_speaker_graph(trade_nodes(spark, d).withColumn("node_type", kind), e)[1]


@query("SELECT n_nationkey AS id, n_name AS name, 'concept' AS kind FROM nation WHERE n_nationkey % 3 = 0 AND length(n_name) >= 5 UNION ALL SELECT n_nationkey, n_name, 'entity' FROM nation WHERE n_nationkey % 3 > 0 AND length(n_name) >= 5")
def split_by_type(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 1, "Country").when(F.col("n_nationkey") % 3 == 2, "Place").when(F.col("n_nationkey") % 2 == 0, "Concept").alias("ontology_class"))
    entities, concepts = speech.split_by_type(n, 5)
    return entities.select("id", "name", F.lit("entity").alias("kind")).unionByName(concepts.select("id", "name", F.lit("concept").alias("kind")))


@query(f"""WITH {SQL_TRADE} SELECT id AS src, CASE WHEN node_type = 'SUPPLIER' THEN 'SUBCOMMUNITY_' || community || '_0' ELSE 'COMMUNITY_' || community END AS dst, 'IN_COMMUNITY' AS label FROM nodes
    UNION ALL SELECT DISTINCT 'SUBCOMMUNITY_' || community || '_0', 'COMMUNITY_' || community, 'PARENT_COMMUNITY' FROM nodes WHERE node_type = 'SUPPLIER'""")
def community_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = trade_nodes(spark, d)
    return speech.community_nodes(n.select("id", "community"), n.where("node_type = 'SUPPLIER'").select("id", "community", F.lit(0).alias("sub_id")))[1].select("src", "dst", "label")


@query(f"""WITH {SQL_TRADE}, s AS (SELECT 'out' AS measure, src AS id, count(*) AS score FROM edges GROUP BY src UNION ALL SELECT 'in', dst, count(*) FROM edges GROUP BY dst)
    SELECT community, measure, id, score, row_number() OVER (PARTITION BY community, measure ORDER BY score DESC, id)::INT AS rank FROM s JOIN nodes USING (id) QUALIFY rank <= 5""")
def centrality_by_community(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    one = lambda c, name: e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("score")).withColumn("measure", F.lit(name))
    return speech.centrality_by_community(one("src", "out").unionByName(one("dst", "in")), trade_nodes(spark, d).select("id", "community")).select("community", "measure", "id", "score", "rank")


@query("""WITH s AS (SELECT conv_id, turn, 'Ann ' || role AS who FROM conversations), k AS (SELECT 'D' || conv_id AS doc, 'D' || conv_id || '_SPEECH_' || turn AS sp, 'SPEAKER_' || upper(replace(who, ' ', '_')) AS sk FROM s)
    SELECT DISTINCT doc AS src, sp AS dst, 'HAS_SPEECH' AS label FROM k UNION SELECT sk, sp, 'HAS_SPEECH' FROM k""")
def speech_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").select(F.concat(F.lit("D"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("speech_order"), F.concat(F.lit("Ann "), F.col("role")).alias("speaker"), F.col("role").alias("party"))
    return speech.speech_graph(s)[1].select("src", "dst", "label")


@query(r"""WITH k AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS x FROM conversations)
    SELECT 'CRE-20240115-ITM-' || conv_id || '_EN' AS doc_id, DATE '2024-01-15' AS date, CAST(conv_id AS VARCHAR) AS item, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, x) - 1 AS INT) AS speech_order, 'Ann ' || role AS speaker, 'Ann' AS first_name, role AS last_name, 'the ' || role AS party, x AS text FROM k""")
def parsed_speeches(spark: SparkSession, d: str) -> DataFrame:
    said = F.trim(F.regexp_replace("text", "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+", " "))
    line = F.concat(F.lit("[EN] Ann "), F.col("role"), F.lit(" said from the the "), F.col("role"), F.lit(" that "), said)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("x"), line.alias("line")))), lambda s: s["line"]), "\n")
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(text.alias("text")).select(F.concat(F.lit("CRE-20240115-ITM-"), F.col("conv_id").cast("string"), F.lit("_EN.txt")).alias("filename"), "text")
    return files.speeches(docs)


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name || '. This is a Country' WHEN 1 THEN n_name || '. big. Entities: a, b' WHEN 2 THEN 'chunk ' || n_name ELSE n_name END AS text FROM nation""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.when(k == 0, "ENTITY_CONCEPT").when(k == 1, "TOPIC").when(k == 2, "CHUNK").otherwise("DOC").alias("node_type"), F.col("n_name").alias("name"), F.lit("Country").alias("ontology_class"),
        F.col("n_name").alias("title"), F.lit("big").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("members"), F.concat(F.lit("chunk "), F.col("n_name")).alias("text"),
    )
    return vectors.embedding_text(n)


@query("SELECT p_partkey AS id, regexp_replace(trim(lower(p_name || '! (' || p_type || ') ')), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS key FROM part")
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.entity_key(F.concat("p_name", F.lit("! ("), "p_type", F.lit(") "))).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS time FROM events")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Times written in each of the five formats and read back."""
    shown = ("yyyy-MM-dd HH:mm:ss", "EEEE d MMMM yyyy, HH:mm", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")
    text = F.coalesce(*[F.when(F.col("event_id") % 5 == k, F.date_format("ts", f)) for k, f in enumerate(shown)])
    return table(spark, d, "events").select("event_id", T.parse_time(text).alias("time"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) END AS day FROM events")
def dates_in_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("log_"), F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyyMMdd")), F.lit(".csv"))
    return table(spark, d, "events").select("event_id", T.date_in_name(name).alias("day"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN n_nationkey || '::' || n_regionkey ELSE n_name END AS key FROM nation")
def topic_keys(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    node = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("TOPIC_"), n)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("SUBTOPIC_"), n, F.lit("_"), r)).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), L.topic_key(node).alias("key"))


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal / 10000, 3) + 0.0::DOUBLE END AS s, CASE WHEN c_custkey % 5 > 0 THEN round((c_custkey % 100) / 1000.0::DOUBLE, 4) END AS p FROM customer)
    SELECT c_custkey AS id, CASE WHEN s IS NULL AND p IS NULL THEN 'Insufficient data for interpretation' ELSE concat_ws('; ', CASE WHEN s > 0.5 THEN 'Strong' WHEN s > 0.25 THEN 'Moderate' WHEN s > 0 THEN 'Weak' WHEN s IS NOT NULL THEN 'Poor' END || printf(' cluster separation (silhouette=%.3f)', s),
      CASE WHEN p < 0.001 THEN 'Highly significant difference (p<0.001)' WHEN p < 0.01 THEN 'Significant difference (p<0.01)' WHEN p < 0.05 THEN 'Marginally significant difference (p<0.05)' WHEN p IS NOT NULL THEN printf('No significant difference (p=%.4f)', p) END) END AS said FROM x""")
def interpretations(spark: SparkSession, d: str) -> DataFrame:
    # as DuckDB rounds: the scaled double, and not the shortest decimal that stands for the value, as Spark does (0.5075 is 507.49999999999994 thousandths)
    s = F.when(F.col("c_custkey") % 7 > 0, F.round(F.col("c_acctbal") / 10000 * 1000, 0) / 1000)
    p = F.when(F.col("c_custkey") % 5 > 0, F.round((F.col("c_custkey") % 100) / 1000.0, 4))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), s.alias("s"), p.alias("p")).select("id", T.interpretation(F.col("s"), F.col("p")).alias("said"))


@query(f"WITH {SQL_LINES} SELECT doc AS filename, line_number, content FROM lines")
def line_pool(spark: SparkSession, d: str) -> DataFrame:
    return files.line_pool(table(spark, d, "documents").select(F.col("doc_id").alias("filename"), "text"))


@query(f"WITH {SQL_LINES} SELECT doc AS filename, line_number, sha256(content) AS sha256 FROM lines")
def sampling_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sampling_manifest(lines(spark, d).select(F.col("doc").alias("filename"), "line_number", "content"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS tags, to_json({'k': n_nationkey, 'name': n_name}) AS info, '2024-01-0' || (1 + n_regionkey) AS day FROM nation")
def clean_properties(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    tags = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")).otherwise(F.expr("cast(array() as array<string>)"))
    rows = n.select(F.col("n_nationkey").alias("id"), tags.alias("tags"), F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).alias("info"), F.make_date(F.lit(2024), F.lit(1), F.col("n_regionkey") + 1).alias("day"))
    return sinks.clean_properties(rows).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {SQL_TRADE} SELECT 'MERGE (n:`' || node_type || '` {{id: ''' || id || '''}}) SET n.name = ''' || name || ''';' AS line FROM nodes
    UNION ALL SELECT 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[:`TRADES WITH`]->(b);' FROM edges""")
def cypher_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.cypher_lines(trade_nodes(spark, d), trade_edges(spark, d).withColumn("label", F.lit("TRADES WITH")))


@query(f"""WITH {SQL_TRADE} SELECT '<node id="' || id || '"><data key="n_name">' || name || ' &amp; co</data><data key="n_community">' || community || '</data></node>' AS line FROM nodes
    UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="e_label">a&lt;b</data></edge>' FROM edges""")
def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    n = trade_nodes(spark, d).select("id", F.concat("name", F.lit(" & co")).alias("name"), "community", F.lit(None).cast("string").alias("nothing"))
    return sinks.graphml_lines(n, trade_edges(spark, d).select("src", "dst", F.lit("a<b").alias("label"))).where("ord >= '1' and ord < '9'").select("line")


@query(f"""WITH {SQL_TRADE} SELECT 'node' AS kind, to_json({{'id': id, 'name': name, 'node_type': node_type, 'community': community}}) AS json FROM nodes UNION ALL SELECT 'link', to_json({{'src': src, 'dst': dst}}) FROM edges""")
def node_link_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.node_link_json(trade_nodes(spark, d).withColumn("embedding", F.array(F.lit(1.0))), trade_edges(spark, d).drop("weight"))


@query("SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return sinks.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


#: An ontology of the tables: regions are classes, nations and the market segments of their customers are subclasses.
SQL_RDF = """sub AS (SELECT 'http://x/geo#N' || n_nationkey AS s, 'http://x/geo#R' || n_regionkey AS o FROM nation UNION SELECT 'http://x/geo#M' || c_nationkey || c_mktsegment, 'http://x/geo#N' || c_nationkey FROM customer),
    cls AS (SELECT s FROM sub UNION SELECT o FROM sub), named AS (SELECT 'http://x/geo#R' || r_regionkey AS s, r_name AS label FROM region UNION ALL SELECT 'http://x/geo#N' || n_nationkey, n_name FROM nation)"""


def _rdf(spark: SparkSession, d: str) -> DataFrame:
    x = lambda letter, c: F.concat(F.lit(f"http://x/geo#{letter}"), c.cast("string"))
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    region, nation = x("R", F.col("r_regionkey")), x("N", F.col("n_nationkey"))
    segment = F.concat(x("M", F.col("c_nationkey")), "c_mktsegment")
    one = lambda df, s, p, o, uri, lang=None: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(uri).alias("o_is_uri"), F.lit(lang).cast("string").alias("lang"), F.lit("f.rdf").alias("file"))
    owl = F.lit(rdf.OWL + "Class")
    out = one(r, region, rdf.RDF + "type", owl, True).unionByName(one(n, nation, rdf.RDF + "type", owl, True)).unionByName(one(c, segment, rdf.RDF + "type", owl, True))
    out = out.unionByName(one(r, region, rdf.RDFS + "label", F.col("r_name"), False, "en")).unionByName(one(r, region, rdf.RDFS + "label", F.concat(F.lit("a"), "r_name"), False, "fr")).unionByName(one(n, nation, rdf.RDFS + "label", F.col("n_name"), False))
    return out.unionByName(one(n, nation, rdf.RDFS + "subClassOf", x("R", F.col("n_regionkey")), True)).unionByName(one(c, segment, rdf.RDFS + "subClassOf", x("N", F.col("c_nationkey")), True))


@query(f"WITH {SQL_RDF} SELECT s FROM cls")
def ontology_classes(spark: SparkSession, d: str) -> DataFrame:
    return rdf.classes(_rdf(spark, d))


@query(f"WITH {SQL_RDF} SELECT cls.s, count(k.s) AS n_children FROM cls LEFT JOIN sub k ON k.o = cls.s WHERE cls.s NOT IN (SELECT s FROM sub) GROUP BY cls.s HAVING count(k.s) >= 2")
def top_classes(spark: SparkSession, d: str) -> DataFrame:
    return rdf.top_classes(_rdf(spark, d), "http://x/geo#", 2)


@query(f"WITH {SQL_RDF} SELECT s, label FROM named")
def class_labels(spark: SparkSession, d: str) -> DataFrame:
    return rdf.labels(_rdf(spark, d)).where(~F.col("s").contains("#M"))


@query(f"""WITH {SQL_RDF} SELECT (SELECT count(*) FROM cls) + (SELECT count(*) FROM named) + (SELECT count(*) FROM region) + (SELECT count(*) FROM sub) AS triples, (SELECT count(*) FROM cls) AS subjects, 3 AS predicates,
    1 + (SELECT count(DISTINCT o) FROM (SELECT label AS o FROM named UNION SELECT 'a' || r_name FROM region UNION SELECT o FROM sub)) AS objects, 1 AS files""")
def ontology_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rdf.statistics(_rdf(spark, d))


@query(f"WITH {SQL_RDF} SELECT 'class' AS component, count(*) AS n, '' AS frbr FROM cls")
def component_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rdf.component_statistics(rdf.entities(_rdf(spark, d))).withColumn("frbr", F.array_join("frbr", ","))


@query(f"""WITH RECURSIVE {SQL_RDF}, tree(s, root, depth, path) AS (SELECT s, s, 0, s FROM cls WHERE s NOT IN (SELECT s FROM sub) UNION ALL SELECT sub.s, root, depth + 1, path || '>' || sub.s FROM tree JOIN sub ON sub.o = tree.s)
    SELECT s, root, CAST(depth AS INT) AS depth, path FROM tree""")
def class_tree(spark: SparkSession, d: str) -> DataFrame:
    return rdf.class_tree(_rdf(spark, d)).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {SQL_RDF}, step AS (SELECT s AS x, o AS y FROM sub UNION SELECT o, s FROM sub), d1 AS (SELECT x AS start, y AS s FROM step WHERE x LIKE '%#N%'), d2 AS (SELECT start, y AS s FROM d1 JOIN step ON d1.s = x), a AS (SELECT x AS start, x AS s, 0 AS depth FROM step WHERE x LIKE '%#N%' UNION ALL SELECT start, s, 1 FROM d1 UNION ALL SELECT start, s, 2 FROM d2)
    SELECT start, s, CAST(min(depth) AS INT) AS depth FROM a GROUP BY ALL""")
def related_classes(spark: SparkSession, d: str) -> DataFrame:
    g = _rdf(spark, d)
    sub = g.where(F.col("p") == rdf.RDFS + "subClassOf").select("s", "o")
    return rdf.related_classes(sub, rdf.classes(g).where(F.col("s").contains("#N")))


@query(f"""WITH {SQL_RDF} SELECT 'C' || n_nationkey AS src, 'http://x/geo#N' || n_nationkey AS dst, 'EXAMPLE_OF' AS label, 'ontology_mapping' AS graph_type FROM nation UNION ALL SELECT s, o, 'rdfs:subClassOf', 'ontology_graph' FROM sub""")
def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    described = rdf.entities(_rdf(spark, d))
    names = table(spark, d, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return rdf.ontology_edges(described, rdf.map_entities(names, described))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) SELECT 'TOPIC_' || label || '__V' || vec_id AS id, CAST(label AS VARCHAR) AS label, round(x, 6) AS x FROM e
    UNION ALL SELECT 'TOPIC_' || label, CAST(label AS VARCHAR), round(avg(x), 6) FROM e GROUP BY label""")
def topic_member_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("id"), "embedding", F.concat(F.lit("TOPIC_"), F.col("label").cast("string")).alias("topic"))
    samples = report.level_samples(v.select(F.col("id").alias("src"), F.col("topic").alias("dst"), F.lit("IN_TOPIC").alias("label")), v.select("id", "embedding"))
    return samples.select("id", "label", F.round(F.col("embedding")[0], 6).alias("x"))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), p AS (SELECT list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.label < b.label)
    SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(min(s), 6) AS min, round(stddev_pop(s), 6) AS std FROM p""")
def similarity_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    out = vectors.similarity_stats(vectors.similarity_matrix(vectors.centroids(e)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "max", "min", "std")])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 7")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    return lexical.first_documents(table(spark, d, "documents").select("doc_id", "lang"), 7, "doc_id")


@query(f"WITH {SQL_LINES} SELECT doc, segment_idx, content FROM lines ORDER BY doc, segment_idx LIMIT 250")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    return lexical.chunk_budget(lines(spark, d).select("doc", "segment_idx", "content"), 250, ["doc", "segment_idx"])


@query(f"WITH {SQL_LINES}, c AS (SELECT doc, count(*) AS n_chunks FROM lines GROUP BY doc), b AS (SELECT doc, n_chunks, CAST(coalesce(sum(n_chunks) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c) SELECT doc, n_chunks, before FROM b WHERE before < 250")
def documents_read(spark: SparkSession, d: str) -> DataFrame:
    return lexical.documents_read(lines(spark, d).groupBy("doc").agg(F.count("*").alias("n_chunks")), 250)
