"""Surface forms and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary that decides the class of a surface form.
ROLE_TERMS = ("PRIME_MINISTER", "PRESIDENT", "CHANCELLOR", "COMMISSIONER", "MINISTER", "SPEAKER", "CHAIR", "LEADER")
CONCEPT_LIKE_TERMS = ("MIGRATION", "HEALTH", "CLIMATE", "SECURITY", "SANCTIONS", "AID", "POLICY_CHANGES", "WHATEVER_IT_TAKES", "ENERGY_INDEPENDENCE", "ENERGY_DEPENDENCE")
NAMED_ENTITY_HINTS = ("EUROPEAN_CENTRAL_BANK", "EUROPEAN_PARLIAMENT", "MARIO_DRAGHI", "ROBERTA_METSOLA", "UKRAINE", "ITALY", "EU", "EUROPE")
OPPOSING = ("DEPENDENCE", "INDEPENDENCE")
DEMONYM_SUFFIXES = ("AN", "IAN", "EAN", "ESE", "ISH", "IC")
BLOCK_STOP_WORDS = ("the", "a", "an", "inc", "ltd", "corp", "company", "and", "of")
DEFAULT_LABELS = ("Person", "Organization", "Location", "Policy", "Political Party", "Concept", "Event")


def standardize_label(x: Column) -> Column:
    """Runs of non-word characters become one underscore; outer underscores go; upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(x, "[^\\p{L}\\p{N}_]+", "_"), "^_+|_+$", ""))


def normalize_surface_form(x: Column) -> Column:
    spaced = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), "[^A-Z0-9\\s_]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, "[\\s_]+", "_"), "^_+|_+$", "")


def classify_surface_form(x: Column) -> Column:
    n = normalize_surface_form(x)
    multi = n.contains("_") & F.forall(F.filter(F.split(n, "_"), lambda t: t != ""), lambda t: t.rlike("^[A-Z]"))
    return (
        F.when(n == "", "unknown").when(n.isin(*ROLE_TERMS), "role_artifact").when(n.isin(*CONCEPT_LIKE_TERMS), "concept_like").when(n.isin(*NAMED_ENTITY_HINTS), "named_entity")
        .when(F.length(n) <= 3, "unknown").when(multi, "named_entity").otherwise("concept_like")
    )


def _singular(t: Column) -> Column:
    return F.when(t.endswith("S") & (F.length(t) > 3), F.regexp_replace(t, "S$", "")).otherwise(t)


def demonym_conflict(a: Column, b: Column) -> Column:
    """One token is the other's stem (four letters or more) with a demonym ending."""
    a, b = _singular(a), _singular(b)

    def grown(short: Column, long: Column) -> Column:
        stem = F.regexp_replace(short, "[AEY]$", "")
        return long.rlike(f"({'|'.join(DEMONYM_SUFFIXES)})$") & (F.length(stem) >= 4) & F.startswith(long, stem)

    return (a != b) & (grown(a, b) | grown(b, a))


def surface_forms_conflict(a: Column, b: Column) -> Column:
    """Opposites, or a country and its demonym, alone or as the last of otherwise equal tokens."""
    a, b = normalize_surface_form(a), normalize_surface_form(b)
    ta, tb = F.split(a, "_"), F.split(b, "_")
    has = F.array_contains
    opposed = (has(ta, OPPOSING[0]) & has(tb, OPPOSING[1])) | (has(ta, OPPOSING[1]) & has(tb, OPPOSING[0]))
    same_head = (F.size(ta) == F.size(tb)) & (F.slice(ta, F.lit(1), F.size(ta) - 1) == F.slice(tb, F.lit(1), F.size(tb) - 1))
    return (a != "") & (b != "") & (a != b) & (opposed | (same_head & demonym_conflict(F.element_at(ta, -1), F.element_at(tb, -1))))


def potential_aliases(a: Column, b: Column, ratio: Column) -> Column:
    """``ratio`` is the Ratcliff-Obershelp ratio of the normal forms with spaces."""
    na, nb = normalize_surface_form(a), normalize_surface_form(b)
    ca, cb = classify_surface_form(na), classify_surface_form(nb)
    role_mismatch = ((ca == "role_artifact") | (cb == "role_artifact")) & (ca != cb)
    eu = ((na == "EU") & (nb == "EUROPE")) | ((na == "EUROPE") & (nb == "EU"))
    same_tokens = F.array_sort(F.array_distinct(F.split(na, "_"))) == F.array_sort(F.array_distinct(F.split(nb, "_")))
    return F.when((na == "") | (nb == ""), False).when(na == nb, True).when(role_mismatch | eu | surface_forms_conflict(na, nb), False).otherwise((ratio >= 0.92) | same_tokens)


def entity_key(x: Column) -> Column:
    """Lower case without punctuation, the key by which mentions of one segment are compared."""
    return F.regexp_replace(F.trim(F.lower(x)), "[^\\p{L}\\p{N}_\\s]", "")


def blocking_keys(x: Column) -> Column:
    t = F.trim(F.lower(x))
    tokens = F.filter(F.split(t, "[^\\p{L}\\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*BLOCK_STOP_WORDS))
    alpha = F.when(t != "", F.array(F.concat(F.lit("ALPHA:"), F.substring(t, 1, 1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_union(alpha, F.transform(tokens, lambda w: F.concat(F.lit("TOKEN:"), w)))


def local_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "[#/]"), -1)


def title_case(name: Column) -> Column:
    """camelCase and snake_case to Title Case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.initcap(F.trim(F.regexp_replace(spaced, "\\s+", " ")))


def default_aliases(label: Column) -> Column:
    pretty = F.regexp_replace(F.lower(label), "_", " ")
    return F.array_sort(F.array_distinct(F.concat(F.array(pretty), F.filter(F.split(pretty, " "), lambda t: F.length(t) > 3))))


def topic_key(node_id: Column) -> Column:
    """TOPIC_c -> c; SUBTOPIC_c_s -> c::s."""
    sub = F.regexp_extract(node_id, "^SUBTOPIC_(.+)_([^_]+)$", 1)
    return F.when(node_id.rlike("^SUBTOPIC_.+_[^_]+$"), F.concat(sub, F.lit("::"), F.regexp_extract(node_id, "^SUBTOPIC_(.+)_([^_]+)$", 2))).when(node_id.startswith("TOPIC_"), F.regexp_replace(node_id, "^TOPIC_", "")).otherwise(node_id)


def acronym_score(a: Column, b: Column) -> Column:
    """0.98 where one is the initials of the other's words, else 0."""
    initials = lambda x: F.array_join(F.transform(F.filter(F.split(F.upper(x), "[\\s_]+"), lambda t: t != ""), lambda t: F.substring(t, 1, 1)), "")
    hit = lambda s, long: (F.size(F.split(F.trim(long), "[\\s_]+")) > 1) & (F.upper(s) == initials(long))
    return F.when(hit(a, b) | hit(b, a), F.lit(0.98)).otherwise(F.lit(0.0))


def cypher_identifier(x: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(x, F.lit("`"), F.lit("``")), F.lit("`"))


def file_safe(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")
