"""A session with the settings the operators are made for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 32 << 20
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def bound_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once by bytes, where the session sets no bound of its own: Spark's 64 MB are held several times over in each task.

    There is one value for all operators and it changes no result, so it doesn't matter which of them runs first or when a lazy frame is executed.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def spread(df: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """Deal a small table out to all cores: a file of one row group is one task, however much work each of its rows is. Larger tables have splits enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < small and df.rdd.getNumPartitions() < cores else df


def session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None, name: str = "kgspark") -> SparkSession:
    """On a cluster leave everything unset: the submitted configuration holds, and so does its spark.checkpoint.dir."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config(*BATCH_BYTES)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if memory:
        b = b.config("spark.driver.memory", memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
