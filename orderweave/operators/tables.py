"""Frames that are read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in ``spark.checkpoint.dir`` and read from there, so that a lost executor costs a reread.

    Without that setting, as in tests, it is cached. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes and much work: several a core, whatever the bytes would come to."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt by columns to so many tasks; adaptive execution merges partitions by bytes and leaves these alone."""
    return df.repartition(task_count(df.sparkSession), *cols)
