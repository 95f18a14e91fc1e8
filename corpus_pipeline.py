"""A corpus pipeline of five stages. Each reads all that its predecessor kept, as Parquet, and its decisions take effect.

quality -> near duplicates -> decontamination -> PII -> mixing. All but the last return the columns of ``documents``; the
last adds what the mix takes of each document and leaves out those of which it takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontam, mixing, pii, quality, similar
from kgspark.llm._common import cut, discard, free_name, packed, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    name = next(c for c in scored.columns if c not in docs.columns)
    return scored.where(F.col(f"{name}.kept")).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity of 0.8 or more) the document with the least id stays, once.

    Rows are told apart by id and text, so rows of different groups stay although they share an id or have none. Null ids come
    last; where a group's least id has several texts, the one with the least hash stays.
    """
    found = similar.groups(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")).alias("x"))
    # a group's first row is in no other group: rows of one text have one set of shingles
    stay = cut(first.select(F.col("x.doc_id").alias("d"), F.col("x.th").alias("t")), "stay")
    own = F.col("i").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("t"))
    # texts are joined by a merge at every size, so that what a stage shuffles follows its input
    rows = packed(docs, i=F.col("doc_id"), h=F.xxhash64("text")).join(stay.hint("merge"), own, "left_semi")
    several = found.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    twice = cut(several.join(stay.select(F.col("d").alias("i"), F.col("t").alias("h")), own, "left_semi"), "twice")
    if twice.isEmpty():
        return rows.select("row.*")
    once, again = rows.join(twice, own, "left_anti"), rows.join(twice, own, "left_semi")
    return once.unionByName(again.dropDuplicates(["i", "h"])).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark window of 13 words go, and those of which shorter items cover a twentieth or more.

    A window of 13 words in the same order is no accident, however long the text around it is; an item of a few words may be one.
    """
    prefix = "_b_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    scanned = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=True, prefix=prefix)
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return scanned.where((hit == 0) | ((hit < decontam.WINDOW) & (20 * hit < words))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them; those it takes nothing of go. Rows that repeat an id and text share what is taken of them."""
    mixed = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "th").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("target").alias("target"))
    mixed = cut(mixed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.expr("taken div n").alias("taken"), "size", "target").where("taken > 0"), "mixed")
    joined = packed(docs, i=F.col("doc_id"), h=F.xxhash64("text")).join(mixed.hint("merge"), F.col("i").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("t")))
    return joined.select("row.*", *[F.col(c).alias(free_name(docs, c)) for c in ("taken", "size", "target")])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the fitted classifier, the covering tables or the sanitiser's rewriting; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), name, keep=True)
        discard(before)
    return docs
