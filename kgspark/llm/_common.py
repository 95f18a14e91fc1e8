"""Helpers shared by the training-data operators: tables and Arrow batches; lineage is cut as in the rest of the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.storage import cut, discard, scratch, shared_dir
from kgspark.session import bound_batches, spread

ARROW_ROWS = 500
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """``row`` (a struct of all columns of ``df``) and ``extra``: whatever names ``df`` has, they can't clash with those of a join."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def ddl(df: DataFrame, extra: str) -> str:
    """The schema of ``df`` with further fields, as DDL."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, extra])


def map_texts(df: DataFrame, text: str, fields: dict[str, tuple[str, pa.DataType]], make: Callable[[], Callable], keep_text: bool = False) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches.

    ``make()`` runs once in each task and returns a function from a list of texts (None where null) to one list
    a field. Every other column passes through; the text itself is returned only where asked for.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    if clash := {c.lower() for c in kept} & {c.lower() for c in fields}:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    schema = ddl(df.select(*[F.col(f"`{c}`") for c in kept]), ", ".join(f"`{n}` {t[0]}" for n, t in fields.items())).lstrip(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            got = work(batch.column(batch.schema.names.index(text)).to_pylist())
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            columns += [pa.array(values, kind) for values, (_, kind) in zip(got, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *fields])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


__all__ = ["ARROW_ROWS", "SPACE", "cut", "ddl", "discard", "free_name", "map_texts", "packed", "scratch", "shared_dir", "sliced", "table"]
