"""Entity and relation extraction: pluggable extractors, a deterministic default, label spaces and grounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.labels import classify_surface_form, default_aliases, normalize_surface_form, standardize_label
from kgspark.functions.similarity import in_evidence, matches_hint

# The patterns and stop words of the default extractor. Word edges look at letters of all scripts.
_L, _R = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
PERSON = _L + "([A-Z][a-z]+(?:\\s+(?:von|van|de|der|del|la|le|da|di|du))*(?:\\s+[A-Z][a-z]+)+)" + _R
ORGANIZATION = _L + "(European Union|European Commission|European Parliament|Council of Europe)" + _R
PLACE = _L + "(Brussels|Europe|France|Germany|Hungary|Ukraine|Russia)" + _R
KEYWORD = _L + "([a-z]{4,}(?:\\s+[a-z]{4,})?)" + _R
STOP = ("with", "that", "this", "from", "have", "will", "into", "their", "there", "about", "after", "before", "under", "discuss", "discussed", "policy", "europe")
# Top labels, the words that belong under them, their aliases and hints, and overriding types.
GROUP_RULES = {
    "PERSON": ["PERSON", "POLITICIAN", "COMMISSIONER", "PRESIDENT", "CHAIRPERSON"],
    "ORGANIZATION": ["ORGANIZATION", "POLITICAL_PARTY", "INSTITUTION", "AGENCY", "COMMISSION", "PARLIAMENT", "COUNCIL", "BANK"],
    "LOCATION": ["LOCATION", "COUNTRY", "CITY", "REGION", "PLACE", "CAPITAL"],
    "POLICY": ["POLICY", "REGULATION", "LAW", "DIRECTIVE", "TREATY", "FRAMEWORK"],
    "EVENT": ["EVENT", "SUMMIT", "MEETING", "ELECTION", "CRISIS", "WAR", "DEBATE"],
}
TOP_ALIASES = {
    "PERSON": ["person", "president", "commissioner", "leader", "prime minister", "speaker"],
    "ORGANIZATION": ["organization", "commission", "parliament", "council", "party", "agency", "bank", "kremlin", "army", "military", "union"],
    "LOCATION": ["location", "country", "city", "region", "brussels", "france", "germany", "ukraine", "mediterranean", "europe"],
    "POLICY": ["policy", "regulation", "law", "directive", "framework", "migration", "climate", "sanctions", "aid", "health", "security", "energy", "defence", "defense"],
    "EVENT": ["event", "summit", "meeting", "election", "crisis", "war", "debate", "conference"],
}
HINT_WORDS = {
    "PERSON": ["prime minister", "president", "speaker", "leader", "mario draghi", "roberta metsola"],
    "ORGANIZATION": ["kremlin", "army", "military", "parliament", "commission", "bank", "union"],
    "LOCATION": ["ukraine", "italy", "mediterranean", "europe", "eurozone"],
    "POLICY": ["sanctions", "aid", "migration", "climate", "health", "security", "energy", "policy"],
    "EVENT": ["invasion", "conference", "debate", "crisis", "war"],
}
TYPE_OVERRIDES = {
    "KREMLIN": "ORGANIZATION", "RUSSIAN_ARMY": "ORGANIZATION", "SANCTIONS": "POLICY_INSTRUMENT", "AID": "POLICY_INSTRUMENT", "ENERGY_DEPENDENCE": "POLICY_INSTRUMENT",
    "SECURITY_AND_DEFENCE_UNION": "POLICY_INSTRUMENT", "MIGRATION": "POLICY_INSTRUMENT", "CLIMATE": "POLICY_INSTRUMENT", "HEALTH": "POLICY_INSTRUMENT",
    "SECURITY": "POLICY_INSTRUMENT", "POLICY_CHANGES": "POLICY_INSTRUMENT",
}
DESCRIPTIONS = {
    "PERSON": "A named person, political leader, office-holder, or individual speaker.",
    "ORGANIZATION": "An institution, parliament, commission, party, bank, or agency.",
    "LOCATION": "A named place, city, region, country, or geopolitical location.",
    "POLICY": "A named policy, directive, regulation, treaty, or governance framework.",
    "EVENT": "A summit, election, crisis, war, debate, or named political event.",
}


class Extractor(Protocol):
    """A model: gets a batch with ``chunk_id, text`` (and hints, if any) and returns rows of the triplet schema."""

    def extract(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def close(self) -> None: ...


TRIPLETS = "chunk_id string, pos int, source string, source_type string, relation string, target string, target_type string, confidence double, evidence string"
MENTIONS = "chunk_id string, pos int, text string, label string, confidence double, start int, end int, backend string"


class Adapted:
    """An extractor out of a plain function: text and hints in, (relations, nodes) or (relations, nodes, diagnostics) out.

    Relations are (source, relation, target, properties), nodes are mappings with ``id`` and ``type``. Any other result, or an error, counts as nothing found.
    """

    def __init__(self, call: Callable[..., tuple]):
        self.call = call

    def one(self, text: str, hints: list[str], labels: list[str]) -> tuple[list, list, dict]:
        try:
            said = self.call(text, hints, labels)
        except Exception:
            return [], [], {}
        if not isinstance(said, tuple) or len(said) not in (2, 3):
            return [], [], {}
        relations, nodes, *more = said
        return list(relations or []), list(nodes or []), dict(more[0] or {}) if more else {}

    def extract(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        empty = [[]] * len(batch)
        for chunk, text, hints, labels in zip(batch["chunk_id"], batch["text"], batch.get("hints", empty), batch.get("labels", empty), strict=True):
            relations, nodes, _ = self.one(text, list(hints), list(labels)) if text else ([], [], {})
            kinds = {n.get("id"): n.get("type") for n in nodes}
            for k, (source, relation, target, *props) in enumerate(relations):
                p = props[0] if props and props[0] else {}
                rows.append((chunk, k, source, kinds.get(source), relation, target, kinds.get(target), float(p.get("confidence", 1.0)), p.get("evidence", text)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRIPLETS.split(", ")])

    def close(self) -> None:
        pass


#: Extractors by name; the values make one. Register more with ``register``.
EXTRACTORS: dict[str, Callable[[], Extractor]] = {}


def register(name: str, make: Callable[[], Extractor]) -> None:
    EXTRACTORS[name] = make


def extractor(backend: str | Callable[[], Extractor] | None) -> Callable[[], Extractor] | None:
    """What makes the model of a configured name; a callable is taken as it is, and no name (or ``default``) means the one that needs no model."""
    if backend is None or callable(backend):
        return backend
    if backend in ("", "default", "smoke"):
        return None
    if backend not in EXTRACTORS:
        raise ValueError(f"no extractor is named {backend}; there are {sorted(EXTRACTORS) or 'none'}")
    return EXTRACTORS[backend]


def guided_triplets(chunks: DataFrame, mentions: DataFrame, make: Callable[[], Extractor], all_labels: list[str], key: str = "chunk_id") -> DataFrame:
    """Triplets of a model with ``kept`` and ``drop_reason``: it sees a chunk's eligible mentions as hints and the labels found in it, and what it says is grounded in these.

    ``chunks`` have the key, ``text`` and, where there are such, their own ``entities``; ``mentions`` have the key, pos, text, label, ontology_label and confidence.
    """
    names = eligible(mentions, key).select(F.col(key).alias("_n"), "names")
    found = labels_found(mentions, all_labels, key).select(F.col(key).alias("_l"), "labels")
    own = F.col("entities") if "entities" in chunks.columns else F.expr("cast(null as array<string>)")
    joined = chunks.join(names, F.col(key) == F.col("_n"), "left").join(found, F.col(key) == F.col("_l"), "left")
    whole = F.array(*[F.lit(x) for x in sorted(all_labels)]).cast("array<string>")
    told = joined.select(F.col(key), "text", hints(own, F.col("names")).alias("hints"), F.coalesce("labels", whole).alias("labels"))
    said = run_model(told, make).join(told.select(F.col(key).alias("_k"), "hints"), F.col(key) == F.col("_k")).drop("_k")
    return ground(said).drop("hints")


def run_model(chunks: DataFrame, make: Callable[[], Extractor], schema: str = TRIPLETS) -> DataFrame:
    """Run a model over chunks. It is built once in each task, sees Arrow batches and is closed at the end; retries belong inside it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        try:
            for b in batches:
                yield model.extract(b)
        finally:
            model.close()

    return chunks.mapInPandas(work, schema)


def found_names(text: Column) -> Column:
    """array<struct<name, label>>: people, organisations and places in the order of the three patterns, repeats included."""
    found = lambda pattern, label: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.struct(standardize_label(m).alias("name"), F.lit(label).alias("label")))
    return F.filter(F.concat(found(PERSON, "PERSON"), found(ORGANIZATION, "ORGANIZATION"), found(PLACE, "LOCATION")), lambda m: m["name"] != "")


def first_seen(mentions: Column) -> Column:
    """One mention a name, the first."""
    return F.filter(mentions, lambda m, i: F.array_position(mentions["name"], m["name"]) == i + 1)


def with_keywords(mentions: Column, text: Column) -> Column:
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(1)), standardize_label), lambda w: (w != "") & ~F.lower(w).isin(*STOP)))
    fresh = F.filter(words, lambda w: ~F.exists(mentions, lambda m: m["name"] == w))
    extra = F.transform(F.slice(fresh, F.lit(1), F.greatest(F.lit(3) - F.size(mentions), F.lit(0))), lambda w: F.struct(w.alias("name"), F.lit("CONCEPT").alias("label")))
    return F.when(F.size(mentions) < 2, F.concat(mentions, extra)).otherwise(mentions)


def default_extraction(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with ``mentions``: the deterministic extractor, wholly in Column expressions.

    Each step is a column of its own: names that are read more than once are not computed more than once, least of all for every element of a lambda. Keywords come
    up to three candidates where there are fewer than two names.
    """
    staged = chunks.withColumn("_all", found_names(F.col(text))).withColumn("_named", first_seen(F.col("_all")))
    return staged.withColumn("mentions", with_keywords(F.col("_named"), F.col(text))).drop("_all", "_named")


def mention_rows(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """One row a mention: ``keep, pos, name, label``.

    The outer generator keeps the optimiser from guarding it by a filter on the array's size, for which the whole extraction would run again before the rows are exploded.
    """
    return extracted.select(*keep, F.posexplode_outer("mentions").alias("pos", "m")).where("pos is not null").select(*keep, "pos", "m.name", "m.label")


def pair_relations(extracted: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """All ordered pairs i<j of a chunk's mentions (three to a few of them) as CO_OCCURS_WITH triplets with ``pos``."""
    pairs = F.flatten(F.transform("mentions", lambda a, i: F.transform(F.slice(F.col("mentions"), i + 2, F.greatest(F.size("mentions") - i - 1, F.lit(0))), lambda b: F.struct(a["name"].alias("source"), a["label"].alias("source_type"), b["name"].alias("target"), b["label"].alias("target_type")))))
    rows = extracted.select(*keep, F.substring(text, 1, 200).alias("evidence"), F.posexplode_outer(pairs).alias("pos", "p")).where("pos is not null")
    return rows.select(*keep, "pos", "p.source", "p.source_type", F.lit("CO_OCCURS_WITH").alias("relation"), "p.target", "p.target_type", F.lit(1.0).alias("confidence"), "evidence")


def typed_pairs(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs with relations CO_OCCURS_<A>_TO_<B>."""
    rows = pair_relations(extracted.withColumn("_text", F.lit("")), keep, "_text")
    return rows.select(*keep, "pos", "source", F.concat(F.lit("CO_OCCURS_"), "source_type", F.lit("_TO_"), "target_type").alias("relation"), "target")


def label_space(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(top, child, aliases, child_aliases) of an ontology's labels, by substring rules."""
    rules = spark.createDataFrame([(t, r) for t, rs in GROUP_RULES.items() for r in rs], "top string, rule string")
    tops = spark.createDataFrame([(t, a) for t, a in TOP_ALIASES.items()], "top string, aliases array<string>")
    given = spark.createDataFrame([(x,) for x in labels], "raw string").select(standardize_label(F.col("raw")).alias("child")).distinct()
    # a fixed handful of rules against a configured list of labels
    hit = given.join(F.broadcast(rules), F.col("child").contains(F.col("rule"))).select("top", "child").distinct()
    return hit.join(F.broadcast(tops), "top").select("top", "child", "aliases", default_aliases(F.col("child")).alias("child_aliases"))


def candidate_labels(texts: DataFrame, key: str, text: str, space: DataFrame, top_k: int = 5) -> DataFrame:
    """(key, labels): the labels whose aliases, children and hint words a text holds, best first; the first ``top_k`` where none scores.

    The label space is a configured list: it becomes literals, so scoring is a projection without a join.
    """
    tops: dict[str, tuple[list[str], list[str]]] = {}
    for r in space.orderBy("top", "child").collect():
        tops.setdefault(r.top, (r.aliases, []))[1].append(r.child)
    low = F.lower(F.col(text))
    scored = []
    for top, (aliases, children) in sorted(tops.items()):
        score = F.lit(0)
        for a in aliases:
            score = score + F.when(low.contains(a), max(3, 2 * len(a.split()))).otherwise(0)
        for c in children:
            long = [t for t in c.lower().split("_") if len(t) > 3]
            if long:
                score = score + F.greatest(*[F.when(low.contains(t), 1).otherwise(0) for t in long], F.lit(0))
        for h in HINT_WORDS.get(top, []):
            score = score + F.when(low.contains(h), 4).otherwise(0)
        scored.append(F.struct((-score).alias("s"), F.lit(top).alias("top")))
    ranked = F.array_sort(F.array(*scored))
    hits = F.filter("_r", lambda x: x["s"] < 0)
    return texts.select(key, ranked.alias("_r")).select(key, F.transform(F.slice(F.when(F.size(hits) > 0, hits).otherwise(F.col("_r")), 1, top_k), lambda x: x["top"]).alias("labels"))


def refine_labels(mentions: DataFrame, space: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``ontology_label``: an overriding type, else the child of the label with most alias hits (ties: first by name)."""
    rows = space.orderBy("top", "child").collect()
    norm, low, top = standardize_label(F.col(text)), F.lower(F.col(text)), standardize_label(F.col(label))
    best = top
    for t in {r.top for r in rows}:
        options = [F.struct((-sum((F.when(low.contains(a), 1).otherwise(0) for a in r.child_aliases), F.lit(0))).alias("s"), F.lit(r.child).alias("c")) for r in rows if r.top == t]
        best = F.when(top == t, F.array_min(F.array(*options))["c"]).otherwise(best)
    override = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_OVERRIDES.items() for x in kv]), norm)
    return mentions.withColumn("ontology_label", F.coalesce(override, best))


def schema_text(labels: list[str], overrides: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    told = DESCRIPTIONS | (overrides or {})
    return {"entities": {x.lower(): told.get(x, x.lower()) for x in labels}}


def eligible(mentions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, names): mentions good enough for the relation step, in first-seen order; all of them where none is."""
    name, kind, sure = standardize_label(F.col("text")), standardize_label(F.coalesce("ontology_label", "label")), F.coalesce("confidence", F.lit(0.0))
    bare = ~name.contains("_")
    weak = (bare & (F.length(name) <= 3) & kind.isin("PERSON", "ORGANIZATION", "LOCATION")) | (bare & (kind == "PERSON")) | ((kind == "EVENT") & (sure < 0.5)) | (kind.isin("ORGANIZATION", "LOCATION") & (sure < 0.6))
    rows = mentions.select(key, "pos", name.alias("name"), F.coalesce(~weak, F.lit(True)).alias("ok")).where("name <> ''")
    each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "ok"))).alias("m"))  # bounded by one chunk
    pick = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["name"]))
    good = F.filter("m", lambda x: x["ok"])
    return each.select(key, F.when(F.size(good) > 0, pick(good)).otherwise(pick(F.col("m"))).alias("names"))


def labels_found(mentions: DataFrame, all_labels: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, labels): the labels a chunk's mentions have, sorted; the whole ontology where it has none."""
    found = mentions.groupBy(key).agg(F.array_sort(F.collect_set("ontology_label")).alias("f"))
    return found.select(key, F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(*[F.lit(x) for x in sorted(all_labels)])).alias("labels"))


def surface_metadata(mentions: DataFrame, text: str = "text") -> DataFrame:
    kind = classify_surface_form(F.col(text))
    return mentions.withColumns({"canonical_form": normalize_surface_form(F.col(text)), "surface_class": kind, "merge_candidate": kind == "named_entity"})


def hints(task: Column, names: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(task, F.expr("cast(array() as array<string>)")), F.coalesce(names, F.expr("cast(array() as array<string>)"))))


def ground(triplets: DataFrame, hint: str = "hints") -> DataFrame:
    """Adds ``kept`` and ``drop_reason`` to triplets that carry their chunk's hints."""
    missing = F.coalesce(F.trim("source"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("target"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("relation"), F.lit("")).eqNullSafe("")
    matched = matches_hint(F.col("source"), F.col(hint)) & matches_hint(F.col("target"), F.col(hint))
    grounded = (matches_hint(F.col("source"), F.col(hint)) | in_evidence(F.col("source"), F.col("evidence"))) & (matches_hint(F.col("target"), F.col(hint)) | in_evidence(F.col("target"), F.col("evidence")))
    reason = F.when(missing, "missing_triplet_field").when(~matched, "endpoint_not_grounded_in_hints").when(~grounded, "endpoint_not_grounded_after_evidence_check")
    return triplets.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason").isNull())
