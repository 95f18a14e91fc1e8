"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import decontam, licenses, linefreq, mixing, oracles, pii, quality, simhash, substrings, tokens, warc
from kgspark.llm._common import table

TOKENIZER = "word_bpe_49k.json"


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_bundles(warc.write_bundles(warc.resolve(table(spark, sf_dir, "pages"))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.decontaminate(docs.select("doc_id", "text"), items))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return said.select("doc_id", "evidence.*")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linefreq.line_quality(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tokens, op2_warc, op3_decontaminate, op4_licenses, op5_mix, op6_substrings, op7_pii, op8_simhash, op9_quality, op10_lines)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
