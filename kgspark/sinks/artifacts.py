"""Run artifacts: schema, resolution report, iteration results, topic details."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The node and edge kinds that the pipeline writes.
SCHEMA = {
    "nodes": {"DOC": ["name"], "SEGMENT": ["content", "line_number"], "CHUNK": ["text", "length"], "ENTITY_CONCEPT": ["name", "ontology_class", "llm_type", "aliases"], "TOPIC": ["title", "summary"], "SUBTOPIC": ["title", "summary"]},
    "edges": {"HAS_SEGMENT": ["DOC", "SEGMENT"], "HAS_CHUNK": ["SEGMENT", "CHUNK"], "HAS_ENTITY": ["CHUNK", "ENTITY_CONCEPT"], "IN_TOPIC": ["ENTITY_CONCEPT", "TOPIC"], "PARENT_TOPIC": ["SUBTOPIC", "TOPIC"]},
}


def write_json(value: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, default=str, ensure_ascii=False)


def schema_json(path: str) -> None:
    write_json(SCHEMA, path)


def resolution_report(effect: DataFrame, path: str) -> dict:
    """The effect table of entity resolution as JSON: counts, five degrees and a histogram of a few classes."""
    out: dict = {}
    for r in effect.collect():
        if r.key is None:
            out[r.metric] = r.value
        else:
            out.setdefault(r.metric, {})[r.key] = r.value
    write_json(out, path)
    return out


def iteration_results(spark, rows: list[dict], folder: str) -> DataFrame:
    """One CSV row an iteration."""
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
    return df


def topic_details(nodes: DataFrame, folder: str) -> None:
    nodes.where(F.col("node_type").isin("TOPIC", "SUBTOPIC")).drop("embedding").write.mode("overwrite").json(folder)
