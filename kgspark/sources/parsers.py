"""Parsers by file type: each turns documents of its kind into segments of one shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.sources import files

SEGMENT = ("filename", "segment_idx", "segment_id", "content", "line_number", "date", "metadata")


@dataclass(frozen=True)
class Parser:
    """``parse`` takes (spark, folder, glob) and gives the columns of SEGMENT but ``date``; ``date`` finds a document's date in its name, and ``content_date`` in a segment where the name has none."""

    name: str
    glob: str
    parse: Callable[[SparkSession, str, str], DataFrame]
    date: Callable[[Column], Column] = T.date_in_name
    content_date: Callable[[Column], Column] | None = None

    def supports(self, filename: Column) -> Column:
        """Whether a file is of this parser's kind, by its glob."""
        return filename.rlike("^" + self.glob.replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$")

    def segments(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = self.parse(spark, folder, self.glob)
        found = self.date(F.col("filename"))
        if self.content_date is not None:
            found = F.coalesce(found, self.content_date(F.col("content")))
        own = [F.col("date")] if "date" in rows.columns else []
        return rows.withColumn("date", F.coalesce(*own, found)).select(*SEGMENT)


def _none() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def parse_lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    from kgspark.operators.lexical import segments

    rows = segments(files.text_files(spark, folder, glob), "filename", "text")
    return rows.select(F.col("doc").alias("filename"), "segment_idx", "segment_id", "content", "line_number", _none().alias("metadata"))


def parse_lifelog(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    if files.text_files(spark, folder, glob).isEmpty():
        return spark.createDataFrame([], "filename string, segment_idx int, segment_id string, content string, line_number int, date date, metadata map<string,string>")
    rows = files.lifelog(spark, f"{folder}/{glob}")
    told = F.create_map(F.lit("start_time"), F.col("start_time").cast("string"), F.lit("end_time"), F.col("end_time").cast("string"), F.lit("locations"), F.array_join("locations", ", "))
    return rows.select("filename", F.col("episode").cast("int").alias("segment_idx"), "segment_id", "content", F.lit(0).alias("line_number"), "date", told.alias("metadata"))


def regex_parser(name: str, glob: str, pattern: str, attributes: dict[str, str] | None = None, date: str | None = None) -> Parser:
    """A parser by a pattern with named groups; ``date`` is a pattern whose first group is the date in a file name."""

    def parse(spark: SparkSession, folder: str, glob_: str) -> DataFrame:
        rows = files.regex_segments(files.text_files(spark, folder, glob_), pattern, attributes)
        return rows.withColumn("segment_id", F.concat_ws("_S", "filename", F.col("segment_idx").cast("string")))

    return Parser(name, glob, parse, (lambda c: files.regex_date(c, date)) if date else T.date_in_name)


#: Parsers in the order in which they are asked; the first that supports a file reads it.
PARSERS: list[Parser] = [Parser("lifelog", "*.csv", parse_lifelog), Parser("lines", "*.txt", parse_lines)]


def register(parser: Parser) -> None:
    """Put a parser before the others."""
    PARSERS.insert(0, parser)


def read_segments(spark: SparkSession, folder: str, parsers: list[Parser] | None = None) -> DataFrame:
    """The segments of all files of a folder, with ``parser``: each file goes to the first parser that supports it, and files of no kind are left out."""
    out, before = None, F.lit(False)
    for p in PARSERS if parsers is None else parsers:
        name = F.col("filename")
        rows = p.segments(spark, folder).where(~before).withColumn("parser", F.lit(p.name))
        out = rows if out is None else out.unionByName(rows)
        before = before | p.supports(name)
    return out
