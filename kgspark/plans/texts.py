"""Queries of the lexical layer, scalar functions and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions import text as T
from kgspark.functions.jsonrepair import repair_json
from kgspark.functions.similarity import matches_hint, token_jaccard
from kgspark.operators import extract, lexical
from kgspark.operators.coherence import document_frequency
from kgspark.plans.common import SQL_LINES, lines, table
from kgspark.registry import query
from kgspark.sources.files import gap_episodes
from kgspark.streaming.episodes import episodes, windows


@query(f"WITH {SQL_LINES} SELECT doc, segment_idx, line_number, content FROM lines")
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc", "segment_idx", "line_number", "content")


@query(f"""WITH {SQL_LINES} SELECT doc || '_S' || segment_idx AS segment_id,
    CASE WHEN length(content) > 20 THEN regexp_replace(content[1:20], '\\s+$', '') || '...' ELSE content END AS name FROM lines""")
def segment_names(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("segment_id", "name")


@query(f"WITH {SQL_LINES} SELECT count(DISTINCT doc) AS documents, count(*) AS segments, sum(CASE WHEN length(content) >= 20 THEN 1 ELSE 0 END)::BIGINT AS long_segments FROM lines")
def step_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    return lexical.step_counters(rows, rows.where(F.length("content") >= 20)).withColumnRenamed("chunks", "long_segments")


@query("SELECT event_id, upper(regexp_replace(regexp_replace(props, '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS label, upper(regexp_replace(regexp_replace(event_type, '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS kind FROM events")
def standard_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", L.standardize_label(F.col("props")).alias("label"), L.standardize_label(F.col("event_type")).alias("kind"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(upper(trim({0})), '[^A-Z0-9\\s_]', ' ', 'g'), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g')"
_NAMES = """names AS (SELECT p_name AS x FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer
   UNION SELECT unnest(['Prime Minister', 'European Parliament', 'EU', 'Europe', 'Italy', 'Italian', 'Ukraine', 'health', 'Energy dependence', 'Energy independence', '', 'Rob-erta  Metsola', 'European Commission', 'European Commissions']))"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    extra = ["Prime Minister", "European Parliament", "EU", "Europe", "Italy", "Italian", "Ukraine", "health", "Energy dependence", "Energy independence", "", "Rob-erta  Metsola", "European Commission", "European Commissions"]
    out = spark.createDataFrame([(x,) for x in extra], "x string")
    for t, c in (("part", "p_name"), ("nation", "n_name"), ("region", "r_name"), ("part", "p_type"), ("customer", "c_mktsegment")):
        out = out.unionByName(table(spark, d, t).select(F.col(c).alias("x")))
    return out.distinct()


_CLASS = f"""CASE WHEN n = '' THEN 'unknown' WHEN n IN {L.ROLE_TERMS} THEN 'role_artifact' WHEN n IN {L.CONCEPT_LIKE_TERMS} THEN 'concept_like' WHEN n IN {L.NAMED_ENTITY_HINTS} THEN 'named_entity'
    WHEN length(n) <= 3 THEN 'unknown' WHEN contains(n, '_') AND NOT regexp_matches(n, '(^|_)[^A-Z_]') THEN 'named_entity' ELSE 'concept_like' END"""


@query(f"WITH {_NAMES}, norm AS (SELECT x, {_NORM.format('x')} AS n FROM names) SELECT x AS name, n AS normal, {_CLASS} AS surface_class FROM norm")
def surface_classes(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select(F.col("x").alias("name"), L.normalize_surface_form(F.col("x")).alias("normal"), L.classify_surface_form(F.col("x")).alias("surface_class"))


@query(f"""WITH {_NAMES}, k AS (SELECT x, lower(trim(x)) AS t FROM names),
    keys AS (SELECT x, 'ALPHA:' || t[1:1] AS key FROM k WHERE t <> '' UNION SELECT x, 'TOKEN:' || w FROM (SELECT x, unnest(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM k) WHERE length(w) > 2 AND w NOT IN {L.BLOCK_STOP_WORDS})
    SELECT DISTINCT a.x AS a, b.x AS b FROM keys a JOIN keys b ON a.key = b.key AND a.x < b.x""")
def block_pairs(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.resolve import block_pairs as pairs

    return pairs(_names(spark, d).select(F.col("x").alias("id"), F.col("x").alias("text")))


@query(f"""WITH {_NAMES}, k AS (SELECT x, lower(trim(x)) AS t FROM names), w AS (SELECT x, list_distinct(list_filter(string_split_regex(lower(x), '\\s+'), lambda y: y <> '')) AS w FROM names),
    keys AS (SELECT x, 'ALPHA:' || t[1:1] AS key FROM k WHERE t <> '' UNION SELECT x, 'TOKEN:' || w FROM (SELECT x, unnest(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM k) WHERE length(w) > 2 AND w NOT IN {L.BLOCK_STOP_WORDS}),
    p AS (SELECT DISTINCT a.x AS a, b.x AS b FROM keys a JOIN keys b ON a.key = b.key AND a.x < b.x)
    SELECT a, b, round(len(list_intersect(v.w, u.w)) / len(list_distinct(list_concat(v.w, u.w))), 6) AS jaccard FROM p JOIN w v ON v.x = a JOIN w u ON u.x = b""")
def token_jaccards(spark: SparkSession, d: str) -> DataFrame:
    """Of all names that share a blocking key: how alike their words are."""
    return block_pairs(spark, d).select("a", "b", F.round(token_jaccard(F.lower("a"), F.lower("b")), 6).alias("jaccard"))


# Java's \b and RE2's differ on letters beyond ASCII; the engine's patterns use look-arounds over all letters, and the SQL
# below turns such letters into underscores first, which are word characters to RE2 and in no pattern.
_STD = "upper(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_PLAIN = "regexp_replace(content, '[^\\P{L}A-Za-z]|[^\\P{N}0-9]', '_', 'g')"
_FOUND = f"""WITH {SQL_LINES}, plain AS (SELECT doc, segment_idx, {_PLAIN} AS p, regexp_replace(lower(content), '[^\\P{{L}}a-z]|[^\\P{{N}}0-9]', '_', 'g') AS low FROM lines),
    hits AS (SELECT doc, segment_idx, 0 AS r, 'PERSON' AS label, regexp_extract_all(p, '\\b([A-Z][a-z]+(?:\\s+(?:von|van|de|der|del|la|le|da|di|du))*(?:\\s+[A-Z][a-z]+)+)\\b', 1) AS m FROM plain
      UNION ALL SELECT doc, segment_idx, 1, 'ORGANIZATION', regexp_extract_all(p, '\\b(European Union|European Commission|European Parliament|Council of Europe)\\b', 1) FROM plain
      UNION ALL SELECT doc, segment_idx, 2, 'LOCATION', regexp_extract_all(p, '\\b(Brussels|Europe|France|Germany|Hungary|Ukraine|Russia)\\b', 1) FROM plain),
    one AS (SELECT doc, segment_idx, r, label, {_STD.format('unnest(m)')} AS name, unnest(range(len(m))) AS i FROM hits),
    named AS (SELECT doc, segment_idx, name, label, row_number() OVER (PARTITION BY doc, segment_idx ORDER BY r, i) AS pos FROM one WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY doc, segment_idx, name ORDER BY r, i) = 1),
    n AS (SELECT doc, segment_idx, count(*) AS k FROM named GROUP BY ALL),
    words AS (SELECT doc, segment_idx, {_STD.format('unnest(m)')} AS name, unnest(range(len(m))) AS i FROM (SELECT doc, segment_idx, regexp_extract_all(low, '\\b([a-z]{{4,}}(?:\\s+[a-z]{{4,}})?)\\b', 1) AS m FROM plain)),
    fresh AS (SELECT w.doc, w.segment_idx, w.name, coalesce(k, 0) AS k, row_number() OVER (PARTITION BY w.doc, w.segment_idx ORDER BY min(i)) AS f FROM words w LEFT JOIN n USING (doc, segment_idx)
      WHERE lower(w.name) NOT IN {extract.STOP} AND NOT EXISTS (SELECT 1 FROM named d WHERE d.doc = w.doc AND d.segment_idx = w.segment_idx AND d.name = w.name) GROUP BY w.doc, w.segment_idx, w.name, k),
    mentions AS (SELECT doc, segment_idx, name, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc, segment_idx ORDER BY pos) - 1 AS q FROM named) t(doc, segment_idx, name, label, p0, pos)
      UNION ALL SELECT doc, segment_idx, name, 'CONCEPT', k + f - 1 FROM fresh WHERE k < 2 AND f <= 3 - k)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.default_extraction(lines(spark, d), "content")


@query(f"{_FOUND} SELECT doc, segment_idx, pos, name, label FROM mentions")
def smoke_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.mention_rows(_mentions(spark, d), ["doc", "segment_idx"])


@query(f"{_FOUND} SELECT a.name AS source, b.name AS target, 'CO_OCCURS_' || a.label || '_TO_' || b.label AS relation, count(*) AS n FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.segment_idx = b.segment_idx AND a.pos < b.pos GROUP BY ALL")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.typed_pairs(_mentions(spark, d), ["segment_id"]).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@query(f"""{_FOUND}, e AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.segment_idx = b.segment_idx AND a.pos < b.pos WHERE a.name <> b.name)
    SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 20""")
def line_entity_degrees(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.graph import degrees

    pairs = extract.typed_pairs(_mentions(spark, d), ["segment_id"]).where("source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return degrees(pairs).orderBy(F.desc("degree"), "id").limit(20)


@query(f"""{_FOUND}, r AS (SELECT a.name AS src, b.name AS dst, a.label AS st, b.label AS dt, a.doc * 1000000000 + a.segment_idx * 1000 + a.pos * 30 + b.pos AS ord FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.segment_idx = b.segment_idx AND a.pos < b.pos)
    SELECT src, dst, arg_max(st, ord) AS source_type, arg_max(dt, ord) AS target_type, max(ord) AS last_ord FROM r GROUP BY ALL""")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.enrich import upsert_edges

    m = F.col("mentions")
    pairs = F.flatten(F.transform(m, lambda a, i: F.transform(F.slice(m, i + 2, F.greatest(F.size(m) - i - 1, F.lit(0))), lambda b, j: F.struct(a["name"].alias("src"), b["name"].alias("dst"), a["label"].alias("source_type"), b["label"].alias("target_type"), i.alias("pa"), (i + j + 1).alias("pb")))))
    rows = _mentions(spark, d).select("doc", "segment_idx", F.explode(pairs).alias("p")).select("p.*", (F.col("doc") * 1_000_000_000 + F.col("segment_idx") * 1000 + F.col("p.pa") * 30 + F.col("p.pb")).alias("ord"))
    return upsert_edges(rows.withColumn("last_ord", F.col("ord")), ["source_type", "target_type", "last_ord"])


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc, line_number, trim(regexp_replace(trim(content), '\\s+', ' ', 'g')) AS segment FROM lines)
    SELECT doc, line_number, segment FROM c WHERE len(list_filter(string_split_regex(segment, '\\s+'), lambda x: x <> '')) >= 8""")
def segment_corpus(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources import files

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("filename"), "text")
    return files.segment_corpus(docs).select(F.col("filename").alias("doc"), "line_number", "segment")


@query("SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS w FROM documents) GROUP BY w")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens")))


@query("""SELECT conv_id, turn, length(text) // 4 AS tokens, CASE WHEN length(text) > 40 THEN text[1:40] || '...' ELSE text END AS short,
    replace(replace(text, '<', '&lt;'), '>', '&gt;') AS escaped FROM conversations""")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(t).alias("tokens"), T.truncate(t, 40).alias("short"), T.escape_angles(t).alias("escaped"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) // 4 AS tok, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS running FROM conversations)
    SELECT conv_id, turn, role, tok, CAST(running AS BIGINT) AS running FROM t WHERE running < 120""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.topics import prefix_within

    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", T.token_estimate(F.col("text")).alias("tok"))
    return prefix_within(rows, "conv_id", ["turn", "role", "text"], "tok", 120).select("conv_id", "turn", "role", "tok", "running")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS episode FROM g)
    SELECT user_id, CAST(episode AS BIGINT) AS episode, min(ts) AS start_time, max(ts) AS end_time, count(*) AS events FROM e GROUP BY user_id, episode""")
def episodes_by_gap(spark: SparkSession, d: str) -> DataFrame:
    told = gap_episodes(table(spark, d, "events"), "ts", ["user_id"])
    return told.groupBy("user_id", "episode").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS episode FROM g)
    SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS events FROM e GROUP BY user_id, episode""")
def episodes_by_session(spark: SparkSession, d: str) -> DataFrame:
    return episodes(table(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "events"), "ts", "1 hour", by=["event_type"])


@query(f"WITH {SQL_LINES} SELECT doc AS filename, line_number, content FROM lines ORDER BY md5('43:' || doc || ':' || line_number), doc, line_number LIMIT 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return lexical.sample_lines(lines(spark, d).select(F.col("doc").alias("filename"), "line_number", "content"), 100, 42, 1)


@query("SELECT doc_id, ('0x' || md5('42:' || doc_id)[1:8])::BIGINT % 10000 < 2000 AS is_test FROM documents")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return lexical.hash_split(table(spark, d, "documents").select("doc_id"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_STD.format("regexp_extract(text, '[^ ]+')")} AS e, {_STD.format('text')} AS ev, {_STD.format('role')} AS h FROM conversations)
    SELECT conv_id, turn, e <> '' AND ev <> '' AND contains('_' || ev || '_', '_' || e || '_') AS grounded, e <> '' AND h <> '' AND (contains(e, h) OR contains(h, e)) AS matched FROM t""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.functions.similarity import in_evidence

    first = F.regexp_extract("text", "[^ ]+", 0)
    return table(spark, d, "conversations").select("conv_id", "turn", in_evidence(first, F.col("text")).alias("grounded"), matches_hint(first, F.array("role")).alias("matched"))


# RE2 has no look-behinds: every sentence end is marked, the marks that the rules forbid are taken back, and the text is split at what is left.
_S = "[\\t\\n\\x0B\\f\\r ]"
SQL_SENTENCES = f"""marked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.?!])({_S})', '\\1\x01\\2', 'g'), '(\\w\\.\\w[.?!])\x01', '\\1', 'g'), '([A-Z][a-z]\\.)\x01', '\\1', 'g') AS t FROM documents),
    parts AS (SELECT doc_id, unnest(string_split_regex(t, '\x01{_S}')) AS x, unnest(range(len(string_split_regex(t, '\x01{_S}')))) AS i FROM marked),
    sentences AS (SELECT doc_id, trim(x, ' ') AS sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos FROM parts WHERE trim(x, ' ') <> '')"""


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, pos, sentence FROM sentences")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH {SQL_SENTENCES} SELECT doc_id AS doc, CAST(pos // 8 AS INT) AS chunk_idx, string_agg(sentence, ' ' ORDER BY pos) AS text FROM sentences GROUP BY doc_id, pos // 8")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lexical.sentence_chunks(table(spark, d, "documents"))


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return lexical.chunks(lines(spark, d), 256, 32).select("segment_id", "chunk_idx", "text", "length")


@query("""SELECT conv_id, turn, '{"title": ' || to_json(regexp_replace(text, '["\\\\\\x00-\\x1F]', ' ', 'g')) || ', "summary": "a \\"quoted\\" part", "findings": [{"summary": "s", "explanation": "e"}, {"summary": "t", "explanation": "u"}]}' AS json FROM conversations""")
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('Sure: ```json\n{"title": "'), F.regexp_replace("text", '[\\\\"\\x00-\\x1F]', " "), F.lit('", "summary": "a "quoted" part", "findings": [{"summary": "s", "explanation": "e"} {"summary": "t", "explanation": "u"}\n```'))
    return table(spark, d, "conversations").select("conv_id", "turn", repair_json(said).alias("json"))


@query()
def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    space = extract.label_space(spark, ["Person", "Political party", "European Commission", "Country", "Regulation", "Summit", "City"])
    return extract.candidate_labels(table(spark, d, "documents"), "doc_id", "text", space)
