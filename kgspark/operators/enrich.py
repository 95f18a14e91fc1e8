"""From triplets and mentions to entity nodes and edges: coreference within a segment, upserts with last-writer rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["segment_id", "chunk_idx", "pos"]


def _same(a: str, b: str, threshold: float) -> bool:
    from difflib import SequenceMatcher

    m = SequenceMatcher(None, a, b)
    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:  # the first two are upper bounds
        return True
    ta, tb = set(a.split()), set(b.split())
    return bool(ta | tb) and len(ta & tb) / len(ta | tb) >= 0.9


def leaders(names: list[str], threshold: float) -> dict[str, str]:
    """Greedy leader clustering over sorted keys; a longer newcomer leads its group from then on. Name -> display name."""
    import re

    key = {n: re.sub(r"[^\w\s]", "", n.lower().strip()) for n in names}
    groups: list[list[str]] = []  # the first key is the leader's
    for k in sorted({*key.values()}):
        for g in groups:
            if _same(k, g[0], threshold):
                g.insert(0, k) if len(k) > len(g[0]) else g.append(k)
                break
        else:
            groups.append([k])
    shown = {}
    for g in groups:
        members = [n for n in names if key[n] in set(g)]
        best = max(members, key=lambda n: (len(n), sum(c.isupper() for c in n), [-ord(c) for c in n]))
        shown |= {n: best for n in members}
    return shown


def coreference(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(segment_id, name, canonical) from (segment_id, name). The greedy order matters, so a segment, which is one line of text, is one array.

    A segment with one name needs no comparison; the others go to Python in Arrow batches, many segments at a time.
    """
    each = names.select("segment_id", "name").where("name is not null").groupBy("segment_id").agg(F.array_sort(F.collect_set("name")).alias("names"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for segment, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shown = leaders(held, threshold) if len(held) > 1 else {held[0]: held[0]}
                out[0].extend([segment] * len(shown))
                out[1].extend(shown)
                out[2].extend(shown.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["segment_id", "name", "canonical"])

    return each.select(F.col("segment_id").cast("string"), "names").mapInArrow(work, "segment_id string, name string, canonical string")


def apply_mapping(triplets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relation ends become their canonical names; loops that this makes go."""
    s = mapping.select(F.col("segment_id").alias("_s1"), F.col("name").alias("_n1"), F.col("canonical").alias("_c1"))
    t = mapping.select(F.col("segment_id").alias("_s2"), F.col("name").alias("_n2"), F.col("canonical").alias("_c2"))
    rows = triplets.join(s, (F.col("segment_id") == F.col("_s1")) & (F.col("source") == F.col("_n1")), "left").join(t, (F.col("segment_id") == F.col("_s2")) & (F.col("target") == F.col("_n2")), "left")
    rows = rows.withColumns({"source": F.coalesce("_c1", "source"), "target": F.coalesce("_c2", "target")}).drop("_s1", "_n1", "_c1", "_s2", "_n2", "_c2")
    return rows.where("source <> target")


def best_labels(mentions: DataFrame) -> DataFrame:
    """(segment_id, name, label): the most confident label of a surface in a segment; ties go to the later mention."""
    return mentions.groupBy("segment_id", "name").agg(F.max_by("label", F.struct("confidence", "ord")).alias("label"))


def entity_nodes(typed: DataFrame) -> DataFrame:
    """(id, ontology_class, llm_type) from (name, llm_type, ner_label, ord): the last model type, else the first label that isn't Concept, else Concept."""
    last = F.max_by("llm_type", F.when(F.col("llm_type").isNotNull(), F.col("ord")))
    ner = F.min_by("ner_label", F.when(F.col("ner_label").isNotNull() & (F.col("ner_label") != "Concept"), F.col("ord")))
    return typed.groupBy(F.col("name").alias("id")).agg(F.coalesce(last, ner, F.lit("Concept")).alias("ontology_class"), last.alias("llm_type"))


def _latest(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("ord"))).alias(column)


def upsert_edges(edges: DataFrame, attributes: list[str]) -> DataFrame:
    """One row for each (src, dst): every attribute is that of the last writer that has one. Aggregation is partial, so hot pairs shrink before the shuffle."""
    return edges.groupBy("src", "dst").agg(*[_latest(a) for a in attributes])


def upsert_first(edges: DataFrame, attributes: list[str], origin: str) -> DataFrame:
    """The other rule: the first label wins and origins are united."""
    return edges.groupBy("src", "dst").agg(*[F.min_by(a, F.when(F.col(a).isNotNull(), F.col("ord"))).alias(a) for a in attributes], F.array_sort(F.collect_set(origin)).alias("extracted_from"))


def with_nodes_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, F.col("src") == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")


def has_entity(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """(chunk_id, entity): each chunk and the canonical names of what it mentions."""
    m = mapping.select(F.col("segment_id").alias("_s"), F.col("name").alias("_n"), "canonical")
    rows = mentions.join(m, (F.col("segment_id") == F.col("_s")) & (F.col("name") == F.col("_n")), "left")
    return rows.select("chunk_id", F.coalesce("canonical", "name").alias("entity")).distinct()


def segment_chunks(edges: DataFrame) -> DataFrame:
    """(segment, chunk) by three kinds of path: direct, by way of a conversation, by way of a context."""
    e = edges.select("src", "dst", "label")
    step = lambda label: e.where(F.col("label") == label)
    between = e.where(F.col("label").isin("HAS_CONVERSATION", "HAS_CONTEXT")).select(F.col("dst").alias("id"))
    direct = step("HAS_CHUNK").join(between, F.col("src") == F.col("id"), "left_anti").select(F.col("src").alias("segment"), F.col("dst").alias("chunk"))
    via = [step(x).alias("a").join(step("HAS_CHUNK" if x == "HAS_CONVERSATION" else "HAS_DESCRIPTION_CHUNK").alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("segment"), F.col("b.dst").alias("chunk")) for x in ("HAS_CONVERSATION", "HAS_CONTEXT")]
    return direct.unionByName(via[0]).unionByName(via[1]).distinct()
