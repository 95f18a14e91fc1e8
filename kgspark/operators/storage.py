"""Cutting lineage on shared storage, so that iterative operators survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: What ``cut`` wrote and nobody deleted yet; the last list is that of the innermost ``scratch`` block.
_written: list[list[DataFrame]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    A session that names none gets a temporary folder if all its executors are threads of this machine. Elsewhere each executor would write
    to its own disk and rows would be lost without a word, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share; the master is {master}")
        if "local" not in _own:
            _own["local"] = "file://" + tempfile.mkdtemp(prefix="kgspark-")
        at = _own["local"]
    return at.rstrip("/")


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recompute.

    The table is deleted by ``discard``, at the end of the ``scratch`` block it was written in (unless ``keep``), or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kg_path = path
    _written[0 if keep else -1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_kg_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            df._kg_path = None
            for held in _written:
                held[:] = [x for x in held if x is not df]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables cut inside the block, but for those to ``keep``, are deleted at its end: write what you want of them before."""
    _written.append([])
    try:
        yield
    finally:
        discard(*_written.pop())


@atexit.register
def _sweep() -> None:
    with suppress(Exception):  # the session may be gone, and its folder with it
        discard(*[x for held in list(_written) for x in list(held)])
