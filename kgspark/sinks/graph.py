"""Writers: Parquet graph store with upserts, GraphML, Cypher, node-link JSON, reports and provenance."""

from __future__ import annotations

import json
import os
import platform
import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.labels import cypher_identifier

NODE_BATCH, EDGE_BATCH = 1000, 2000
SECRET = re.compile(r"(?i)(api_?key|secret|password|token|credential)")


def clean_properties(df: DataFrame, keep: tuple[str, ...] = ("id", "src", "dst")) -> DataFrame:
    """Columns as a property store takes them: scalars and primitive arrays stay (empty arrays become null), structs and maps become JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)) and f.name not in keep:
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(f.dataType, T.TimestampType) else c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_store(nodes: DataFrame, edges: DataFrame, folder: str, clean: bool = False) -> dict[str, int]:
    """Nodes and edges as Parquet, partitioned by label. Without ``clean`` rows are merged into what is there, by key; ids stay unique."""
    spark = nodes.sparkSession
    done = {}
    for name, df, key, part in (("nodes", nodes, ["id"], "node_type"), ("edges", edges, ["src", "dst"], "label")):
        path = f"{folder}/{name}"
        new = clean_properties(df)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
        if not fs.exists(p) and fs.exists(aside):  # an earlier call ended between its two renames
            fs.rename(aside, p)
        if not clean and fs.exists(p):
            old = spark.read.parquet(path)
            new = new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)
        # the old table is set aside, not deleted, until the new one has its place: a crash between leaves one of the two under a name that says what it is
        new.write.mode("overwrite").partitionBy(part).parquet(f"{path}.new")
        fresh, old_path = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
        fs.delete(old_path, True)
        if fs.exists(p):
            fs.rename(p, old_path)
        fs.rename(fresh, p)
        fs.delete(old_path, True)
        done[name] = spark.read.parquet(path).count()
    return done


def index_statements(nodes: DataFrame, key: str = "id", vector: str = "embedding") -> list[str]:
    """What a property-graph database is asked for before an upload: a unique key for each kind of node, and a cosine vector index where it has vectors (their length is read, and has to be one)."""
    quoted = lambda x: "`" + x.replace("`", "``") + "`"
    has = vector in nodes.columns
    size = F.size(vector) if has else F.lit(None).cast("int")
    kinds = nodes.groupBy("node_type").agg(F.min(size).alias("least"), F.max(size).alias("most")).orderBy("node_type").collect()  # a row a kind
    out = []
    for r in kinds:
        out.append(f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{quoted(r.node_type)}) REQUIRE n.{key} IS UNIQUE")
        if r.most and r.most > 0:
            if r.least != r.most:
                raise ValueError(f"{r.node_type} has vectors of {r.least} to {r.most} numbers")
            out.append(f"CREATE VECTOR INDEX {quoted(f'{r.node_type}_{vector}')} IF NOT EXISTS FOR (n:{quoted(r.node_type)}) ON (n.{vector}) OPTIONS {{indexConfig: {{`vector.dimensions`: {r.most}, `vector.similarity_function`: 'cosine'}}}}")
    return out


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break uniqueness."""
    return df.groupBy(*key).count().where("count > 1")


def upload(df: DataFrame, make, batch: int = NODE_BATCH) -> DataFrame:
    """Send rows to a graph database: each task opens a client by ``make`` and merges batches of rows, which are lists of dicts. Returns (sent) by task."""
    cleaned = clean_properties(df)
    names = cleaned.columns

    def work(batches):
        import pandas as pd

        client, sent, held = make(), 0, []
        try:
            for b in batches:
                for row in b.to_dict("records"):
                    held.append({k: row[k] for k in names if row[k] is not None})
                    if len(held) >= batch:
                        client.merge(held)
                        sent, held = sent + len(held), []
            if held:
                client.merge(held)
                sent += len(held)
        finally:
            client.close()
        yield pd.DataFrame({"sent": [sent]})

    return cleaned.mapInPandas(work, "sent long")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line): a GraphML document; nulls are left out, nested values are JSON."""
    n, e = clean_properties(nodes), clean_properties(edges)
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "double", "boolean": "boolean"}
    text = lambda df, c: F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(f"`{c}`").cast("string")
    data = lambda df, skip, p: F.concat_ws("", *[F.concat(F.lit(f'<data key="{p}_{c}">'), _xml(text(df, c)), F.lit("</data>")) for c in df.columns if c not in skip])
    spark = nodes.sparkSession
    keys = [f'<key id="{p}_{c}" for="{kind}" attr.name="{c}" attr.type="{kinds.get(dict(df.dtypes)[c], "string")}"/>' for p, kind, df, skip in (("n", "node", n, {"id"}), ("e", "edge", e, {"src", "dst"})) for c in df.columns if c not in skip]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    fixed = spark.createDataFrame([(f"0{i:06d}", x) for i, x in enumerate(head)] + [("9", "</graph>\n</graphml>")], "ord string, line string")
    node = n.select(F.concat(F.lit("1"), F.col("id").cast("string")).alias("ord"), F.concat(F.lit('<node id="'), _xml(F.col("id").cast("string")), F.lit('">'), data(n, {"id"}, "n"), F.lit("</node>")).alias("line"))
    edge = e.select(F.concat_ws("\u0001", F.concat(F.lit("2"), F.col("src").cast("string")), F.col("dst").cast("string")).alias("ord"), F.concat(F.lit('<edge source="'), _xml(F.col("src").cast("string")), F.lit('" target="'), _xml(F.col("dst").cast("string")), F.lit('">'), data(e, {"src", "dst"}, "e"), F.lit("</edge>")).alias("line"))
    return fixed.unionByName(node).unionByName(edge)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file, streamed partition by partition to the driver's disk: the format is a single document."""
    with open(path, "w", encoding="utf-8") as f:
        for row in graphml_lines(nodes, edges).orderBy("ord").toLocalIterator():
            f.write(row.line + "\n")


def read_graphml(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file as attribute maps, by the XML reader."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    read = lambda tag, attrs: spark.read.format("xml").option("rowTag", tag).schema(f"{attrs}, {data}").load(path)
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.expr("cast(array() as array<struct<_key:string,_VALUE:string>>)")), lambda d: F.struct(F.substring(d["_key"], 3, 1000), d["_VALUE"])))
    return read("node", "_id string").select(F.col("_id").alias("id"), attrs.alias("attrs")), read("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs.alias("attrs"))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): MERGE statements."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.concat(F.lit("MERGE (n:"), cypher_identifier(F.col("node_type")), F.lit(" {id: "), quote(F.col("id")), F.lit("}) SET n.name = "), quote(F.coalesce("name", "id")), F.lit(";")).alias("line"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), quote(F.col("src")), F.lit("}), (b {id: "), quote(F.col("dst")), F.lit("}) MERGE (a)-[:"), cypher_identifier(F.col("label")), F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) rows without any embedding column."""
    slim = lambda df: df.drop(*[c for c in df.columns if "embedding" in c.lower()])
    return slim(nodes).select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).unionByName(slim(edges).select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def explorer_tables(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What an interactive explorer shows: entities and communities, and the edges between them; only the ``most`` connected ones where a number is given."""
    n = nodes.where(F.col("node_type").isin("ENTITY_CONCEPT", "COMMUNITY", "SUBCOMMUNITY", "TOPIC", "SUBTOPIC"))
    if most is not None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("_e")).groupBy("_e").agg(F.count("*").alias("_d"))
        n = n.join(ends, n.id == F.col("_e"), "left").orderBy(F.desc_nulls_last("_d"), "id").limit(most).drop("_e", "_d")
    ids = n.select("id")
    return n, edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def redact(value):
    """Configuration without secrets."""
    if isinstance(value, dict):
        return {k: "***" if SECRET.search(str(k)) and v else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, (list, tuple)) else value


def manifest(spark, folder: str, status: str, config: dict, **more) -> dict:
    """Write run_manifest.json: status, time, versions, revision, redacted configuration."""
    try:
        rev = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        rev = None
    row = {"status": status, "at": datetime.now(timezone.utc).isoformat(), "python": platform.python_version(), "spark": spark.version, "revision": rev, "config": redact(config), **more}
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/run_manifest.json", "w", encoding="utf-8") as f:
        json.dump(row, f, indent=1, default=str)
    return row


def sampling_manifest(lines: DataFrame) -> DataFrame:
    """(filename, line_number, sha256) of a sampled batch."""
    return lines.select("filename", "line_number", F.sha2("content", 256).alias("sha256"))


def diagnostics(rows: DataFrame, folder: str) -> None:
    """Per-chunk and per-segment diagnostics as one JSON table, partitioned by stage."""
    rows.write.mode("append").partitionBy("stage").json(folder)


def diagnostic_index(spark, folders: dict[str, str], folder: str) -> DataFrame:
    """(name, path, rows) of the diagnostic tables that are there, written beside them as JSON."""
    rows = []
    for name, path in sorted(folders.items()):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows.append((name, path, spark.read.text(path).count()))
    out = spark.createDataFrame(rows, "name string, path string, rows long")
    out.coalesce(1).write.mode("overwrite").json(folder)
    return out


def executive_summary(stats: dict) -> str:
    lines = ["# Knowledge graph summary", ""]
    for section, rows in stats.items():
        lines += [f"## {section}", "", *(f"- {k}: {v}" for k, v in rows.items()), ""]
    return "\n".join(lines)
