"""Text, CSV, speech, regex and XML sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T

# Names and lines of speech files.
SPEECH_FILE = "CRE-(\\d{8})-ITM-(\\d+)_EN\\.txt$"
SPEECH_LINE = "^\\[EN\\]\\s*(.+?)\\s+said from the (.+?) that\\s*(.*)$"


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(filename, text): whole files in name order of a glob. A folder without a match, or none at all, gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "filename string, text string")
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("text"))


def readable(spark: SparkSession, folder: str, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """(documents, errors): files that aren't UTF-8 become error rows instead of failing the scan."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return read.where(good).select("filename", F.col("content").cast("string").alias("text")), read.where(~good).select("filename", F.lit("not UTF-8").alias("error"))


def line_pool(docs: DataFrame) -> DataFrame:
    """(filename, line_number, content): all non-blank lines."""
    from kgspark.operators.lexical import segments

    return segments(docs, "filename", "text").select(F.col("doc").alias("filename"), "line_number", "content")


def segment_corpus(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(filename, line_number, segment): cleaned lines of ``min_words`` words or more."""
    rows = line_pool(docs).select("filename", "line_number", T.clean_segment(F.col("content")).alias("segment"))
    return rows.where(F.size(F.filter(F.split("segment", "\\s+"), lambda w: w != "")) >= min_words)


def gap_episodes(rows: DataFrame, time: str, by: list[str], minutes: int = 5) -> DataFrame:
    """Adds ``episode``: a new one begins after a gap of more than ``minutes``; a gap of exactly that stays inside."""
    w = W.partitionBy(*by).orderBy(time) if by else W.orderBy(time)
    gap = F.col(time).cast("timestamp") - F.lag(F.col(time).cast("timestamp")).over(w) > F.expr(f"interval {minutes} minutes")
    return rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("episode", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def lifelog(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of a life-log CSV (Time, Location, Audio, Image): (filename, episode, segment_id, date, start_time, end_time, content, locations, rows)."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"))
    timed = raw.withColumn("ts", T.parse_time(F.col("Time"))).where("ts is not null")
    told = gap_episodes(timed, "ts", ["filename"])
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.coalesce("Location", F.lit("")), F.lit(": "), F.substring(F.coalesce("Audio", F.lit("")), 1, 50), F.lit("..."))
    each = told.groupBy("filename", "episode").agg(
        F.to_date(F.min("ts")).alias("date"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"),
        F.array_sort(F.collect_set(F.nullif(F.col("Location"), F.lit("")))).alias("locations"),
    )
    return each.withColumn("segment_id", F.format_string("SEGMENT_%s_EPISODE_%03d", F.col("date").cast("string"), F.col("episode")))


def _regex_rows(pattern: str, attributes: dict[str, str]):
    rx = re.compile(pattern, re.MULTILINE | re.DOTALL)

    def parse(text: str) -> Iterator[tuple[int, str, int, dict]]:
        n = 0
        for m in rx.finditer(text or ""):
            named = m.groupdict()
            body = (named.get("text") or m[0]).strip()
            if body:
                yield n, body, m.start(), {attributes.get(k, k): v for k, v in named.items() if k != "text" and v is not None}
                n += 1
        if not n and (text or "").strip():
            yield 0, text.strip(), 0, {}

    return parse


def regex_segments(docs: DataFrame, pattern: str, attributes: dict[str, str] | None = None, name: str = "filename", text: str = "text") -> DataFrame:
    """(filename, segment_idx, content, line_number = character offset, metadata): one segment a match; the whole file where nothing matches."""
    parse = _regex_rows(pattern, attributes or {})

    def work(batches):
        for b in batches:
            rows = [(n, *r) for n, t in zip(b["n"], b["t"], strict=True) for r in parse(t)]
            yield pd.DataFrame(rows, columns=["filename", "segment_idx", "content", "line_number", "metadata"])

    return docs.select(F.col(name).alias("n"), F.col(text).alias("t")).mapInPandas(work, "filename string, segment_idx int, content string, line_number int, metadata map<string,string>")


def regex_date(name: Column, pattern: str) -> Column:
    """The date in a file name by the pattern's first group."""
    return F.to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))


def speeches(docs: DataFrame) -> DataFrame:
    """(doc_id, date, item, speech_order, speaker, first_name, last_name, party, text) of speech files; other names give nothing."""
    files = docs.where(F.col("filename").rlike(SPEECH_FILE))
    lines = files.select("filename", F.posexplode(F.split("text", T.LINE_BREAK, -1)).alias("line_number", "line"))
    hit = lines.where(F.col("line").rlike(SPEECH_LINE))
    part = lambda i: F.trim(F.regexp_extract("line", SPEECH_LINE, i))
    order = F.row_number().over(W.partitionBy("filename").orderBy("line_number")) - 1
    speaker = part(1)
    return hit.select(
        F.regexp_replace("filename", "\\.txt$", "").alias("doc_id"), F.to_date(F.regexp_extract("filename", SPEECH_FILE, 1), "yyyyMMdd").alias("date"), F.regexp_extract("filename", SPEECH_FILE, 2).alias("item"),
        order.alias("speech_order"), speaker.alias("speaker"), F.element_at(F.split(speaker, "\\s+"), 1).alias("first_name"), F.element_at(F.split(speaker, "\\s+"), -1).alias("last_name"), part(2).alias("party"), part(3).alias("text"),
    )


def proceedings(spark: SparkSession, path: str, row_tag: str = "INTERVENTION") -> DataFrame:
    """(speaker, party, line) from XML proceedings: one line an intervention."""
    read = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema("ORATEUR struct<_PP:string,_LIB:string>, PARA array<string>").load(path)
    return read.select(F.col("ORATEUR._LIB").alias("speaker"), F.col("ORATEUR._PP").alias("party"), F.concat(F.col("ORATEUR._LIB"), F.lit(" said from the "), F.coalesce("ORATEUR._PP", F.lit("floor")), F.lit(" that "), F.array_join("PARA", " ")).alias("line"))


def translate(lines: DataFrame, make=None, text: str = "text") -> DataFrame:
    """The speech part of each line through a translator (identity by default); the prefix stays."""
    if make is None:
        return lines

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in parts:
            yield pd.Series([None if t is None else f(t) for t in s], index=s.index)

    return lines.withColumn(text, run(F.col(text)))


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON graph."""
    raw = spark.read.schema("nodes array<map<string,string>>, links array<map<string,string>>").option("multiLine", True).json(path)
    n = raw.select(F.explode("nodes").alias("a")).select(F.col("a")["id"].alias("id"), F.col("a")["node_type"].alias("node_type"), F.col("a")["graph_type"].alias("graph_type"), "a")
    e = raw.select(F.explode("links").alias("a")).select(F.col("a")["source"].alias("src"), F.col("a")["target"].alias("dst"), F.col("a")["label"].alias("label"), F.col("a")["graph_type"].alias("graph_type"), "a")
    return n.withColumnRenamed("a", "attrs"), e.withColumnRenamed("a", "attrs")


def reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Own outputs read again: iteration results, iteration reports, silhouette samples."""
    return {
        "results": spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/results"),
        "reports": spark.read.option("multiLine", True).json(f"{folder}/iteration_*_report.json"),
    }
