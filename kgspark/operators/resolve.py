"""Entity resolution: blocking, pair scores, clusters, canonical nodes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions.similarity import cosine, sequence_ratio, set_jaccard, token_jaccard
from kgspark.operators.components import components
from kgspark.operators.graph import degrees, merge_nodes, neighbour_signature
from kgspark.operators.storage import cut


def block_pairs(entities: DataFrame, text: str = "text", gate: Column | None = None) -> DataFrame:
    """(a, b): pairs of ids, smaller first, that share a blocking key, each once.

    ``gate`` is a condition over columns a_* and b_*; it runs inside the join, so that pairs it rules out are never formed.
    Keys are salted on both sides by entity type and class where there are such columns: pairs across them would score zero.
    """
    cheap = [c for c in ("type", "surface_class") if c in entities.columns]
    rows = entities.select("id", *cheap, F.col(text).alias("text"), F.explode(L.blocking_keys(F.col(text))).alias("key"))
    a = rows.select("key", *[F.col(c).alias(f"a_{c}") for c in ("id", "text", *cheap)])
    b = rows.select("key", *[F.col(c).alias(f"b_{c}") for c in ("id", "text", *cheap)])
    on = F.col("a_id") < F.col("b_id")
    joined = a.join(b, "key").where(on if gate is None else on & gate)
    return joined.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def class_gate(a: Column, b: Column) -> Column:
    """Surface classes under which a pair can score at all."""
    role = lambda x: x == "role_artifact"
    mixed = ((a == "concept_like") & (b == "named_entity")) | ((a == "named_entity") & (b == "concept_like"))
    return ~((role(a) | role(b)) & (a != b)) & ~mixed


def types_compatible(a: Column, b: Column) -> Column:
    na, nb = L.normalize_surface_form(a), L.normalize_surface_form(b)
    return (na == "") | (nb == "") | (na == nb)


def score_pairs(pairs: DataFrame, entities: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """(a, b, score). Entities have ``id, text, type`` and, where there are such, ``embedding`` and ``structural``."""
    has = {c: c in entities.columns for c in ("embedding", "structural")}
    extra = [c for c, there in has.items() if there]
    side = lambda p: entities.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("text", "type", *extra)])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    if signatures is not None:
        rows = rows.join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("a_sig")), "a", "left").join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("b_sig")), "b", "left")
        empty = F.expr("cast(array() as array<string>)")
        near = set_jaccard(F.coalesce("a_sig", empty), F.coalesce("b_sig", empty))
    else:
        near = F.lit(0.0)
    ta, tb = F.lower("a_text"), F.lower("b_text")
    ca, cb = L.classify_surface_form(F.col("a_text")), L.classify_surface_form(F.col("b_text"))
    open_ = types_compatible(F.col("a_type"), F.col("b_type")) & ~L.surface_forms_conflict(F.col("a_text"), F.col("b_text")) & class_gate(ca, cb)
    # pairs that the gates rule out never reach Python
    rows = rows.where(open_)
    spaced = lambda x: F.replace(L.normalize_surface_form(x), F.lit("_"), F.lit(" "))
    rows = rows.withColumns({"_near": near, "_alias": sequence_ratio(spaced(F.col("a_text")), spaced(F.col("b_text"))), "_seq": sequence_ratio(ta, tb)})
    bonus = F.when(L.potential_aliases(F.col("a_text"), F.col("b_text"), F.col("_alias")), 0.97).otherwise(0.0)
    string = F.greatest("_seq", token_jaccard(ta, tb))
    string = F.greatest(string, F.least(F.lit(0.99), string + 0.15 * F.col("_near")))
    string = F.when(F.startswith(ta, tb) | F.startswith(tb, ta), F.greatest(string, F.lit(0.85))).otherwise(string)
    norm = lambda v: F.exists(v, lambda x: x != 0)
    pair_cos = lambda c: F.when(norm(F.col(f"a_{c}")) & norm(F.col(f"b_{c}")), cosine(F.col(f"a_{c}"), F.col(f"b_{c}"))) if has[c] else F.lit(None).cast("double")
    s, t = pair_cos("embedding"), pair_cos("structural")
    value = F.when(s.isNotNull() & t.isNotNull(), 0.6 * s + 0.2 * t + 0.2 * F.col("_near")).when(s.isNotNull(), 0.85 * s + 0.15 * F.col("_near")).when(t.isNotNull(), 0.8 * (0.7 * t + 0.3 * F.col("_near"))).otherwise(string)
    return rows.select("a", "b", F.greatest(value, bonus).alias("score"))


def clusters(accepted: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, cluster, canonical_text): components of accepted pairs; the canonical text is the longest, the first id's on ties."""
    roots = components(accepted.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = roots.join(entities.select("id", "text"), roots.node == F.col("id")).select("id", "root", "text")
    best = rows.groupBy("root").agg(F.min(F.struct((-F.length("text")).alias("n"), "id", "text")).alias("b")).select(F.col("root").alias("_r"), F.col("b.text").alias("canonical_text"))
    return rows.join(best, rows.root == best._r).select("id", F.col("root").alias("cluster"), "canonical_text")


def canonical_nodes(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): within each canonical text, the node of highest degree, then longest name, then least id, absorbs the others.

    Degrees are those before any merge, so the result doesn't depend on the order of merging.
    """
    deg = degrees(edges)
    rows = found.join(nodes.select(F.col("id").alias("_n"), F.col("name")), found.id == F.col("_n")).join(deg.withColumnRenamed("id", "_d"), F.col("id") == F.col("_d"), "left")
    rows = rows.select("id", "canonical_text", "name", F.coalesce("degree", F.lit(0)).alias("degree"))
    best = rows.groupBy("canonical_text").agg(F.min(F.struct((-F.col("degree")).alias("d"), (-F.length("name")).alias("n"), "id")).alias("b")).select(F.col("canonical_text").alias("_t"), F.col("b.id").alias("target"))
    return rows.join(best, rows.canonical_text == best._t).where("id <> target").select(F.col("id").alias("source"), "target")


def resolve(nodes: DataFrame, edges: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merges). ``nodes`` have id, name, ontology_class and, where there is one, embedding (only nodes with one take part then)."""
    extra = ["embedding"] if "embedding" in nodes.columns else []
    ents = nodes.select("id", F.col("name").alias("text"), F.coalesce("ontology_class", F.lit("Entity")).alias("type"), *extra)
    if extra:
        ents = ents.where("embedding is not null")
    ents = cut(ents.withColumn("surface_class", L.classify_surface_form(F.col("text"))), "entities")
    gate = class_gate(F.col("a_surface_class"), F.col("b_surface_class")) & types_compatible(F.col("a_type"), F.col("b_type"))
    pairs = cut(block_pairs(ents, "text", gate), "pairs")
    sig = neighbour_signature(edges, nodes) if "label" in edges.columns else None
    accepted = cut(score_pairs(pairs, ents, sig).where(F.col("score") >= threshold).select("a", "b"), "accepted")
    merges = cut(canonical_nodes(clusters(accepted, ents), nodes, edges), "merges")
    kept, redirected = merge_nodes(nodes, edges, merges)
    return kept, redirected, merges


def effect(before: DataFrame, after: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(metric, key, value): entity counts before and after, merged, the five highest degrees and the histogram of surface classes."""
    count = lambda d, name: d.agg(F.lit(name).alias("metric"), F.lit(None).cast("string").alias("key"), F.count("*").alias("value"))
    merged = before.select(F.lit(1).alias("x")).unionByName(after.select(F.lit(-1).alias("x"))).agg(F.lit("merged").alias("metric"), F.lit(None).cast("string").alias("key"), F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("value"))
    top = degrees(edges_after).join(after.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(5).select(F.lit("top_degree").alias("metric"), F.col("id").cast("string").alias("key"), F.col("degree").alias("value"))
    classes = after.groupBy(L.classify_surface_form(F.col("name")).alias("key")).agg(F.count("*").alias("value")).select(F.lit("surface_class").alias("metric"), "key", "value")
    return count(before, "before").unionByName(count(after, "after")).unionByName(merged).unionByName(top).unionByName(classes)


def composite_name_score(a: Column, b: Column, ratio: Column) -> Column:
    """The older string score: the best of edit similarity, sequence ratio, acronym and containment."""
    la, lb = F.lower(a), F.lower(b)
    from kgspark.functions.similarity import levenshtein_similarity

    inside = F.when(la.contains(lb) | lb.contains(la), 0.9 * F.least(F.length(la), F.length(lb)) / F.greatest(F.length(la), F.length(lb), F.lit(1))).otherwise(0.0)
    return F.greatest(levenshtein_similarity(a, b), ratio, L.acronym_score(a, b), inside)


def title_pairs(titles: DataFrame, title: str = "title", most: float = 0.7, vector: str | None = None) -> DataFrame:
    """(a, b, similarity, duplicate) of titles that are more alike than ``most``: by the cosine of their vectors where there are such and it says so, else by edit distance. Titles are one row a topic.

    A pair over the bound shares a length band, so the join is by neighbouring bands of log length instead of all pairs.
    """
    from kgspark.functions.similarity import levenshtein_similarity

    rows = titles.select("id", F.col(title).alias("t"), F.length(title).alias("n"))
    # similarity > s needs min/max length > s: bands of ratio s put such lengths into the same or the next band
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / -F.log(F.lit(most)))
    a = rows.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.explode(F.array(band, band + 1)).alias("band"))
    b = rows.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.explode(F.array(band, band + 1)).alias("band"))
    s = F.round(levenshtein_similarity(F.col("ta"), F.col("tb")), 6)
    found = a.join(b, "band").where("a < b").select("a", "b", s.alias("similarity")).where(F.col("similarity") > most).distinct()
    if vector is not None:
        from kgspark.operators.vectors import similarity_matrix

        near = similarity_matrix(titles.where(F.col(vector).isNotNull()), "id", vector).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round("sim", 6).alias("similarity")).where(F.col("similarity") > most)
        found = near.unionByName(found.join(near.select("a", "b"), ["a", "b"], "left_anti"))
    return found.withColumn("duplicate", F.col("similarity") > 0.9)
