"""An index of catalog vectors that is written once and read again while the catalog and the model are the same."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(catalog: DataFrame, passage: str) -> dict:
    """What tells whether an index fits: the number of rows, and an order-free sum over codes and passages."""
    row = catalog.agg(F.count("*").alias("n"), F.sum(F.xxhash64("code", passage).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row["n"], "sum": str(row["sum"])}


def is_valid(spark: SparkSession, path: str, want: dict) -> bool:
    """Whether the index in ``path`` is there, whole and made from just that."""
    try:
        meta = spark.read.text(f"{path}/meta", wholetext=True).first()
    except Exception:  # no index yet
        return False
    try:
        return meta is not None and json.loads(meta["value"]) == want
    except ValueError:
        return False


def build_or_load(spark: SparkSession, catalog: DataFrame, path: str, embed: Column, model: str, passage: str = "search") -> DataFrame:
    """(vec_id, embedding) of the catalog; ``meta`` is written last, so an index cut short is never taken for one."""
    want = {"version": VERSION, "model": model, **fingerprint(catalog, passage)}
    if not is_valid(spark, path, want):
        catalog.select(F.col("code").alias("vec_id"), embed.alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
        spark.createDataFrame([(json.dumps(want),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return spark.read.parquet(f"{path}/vectors")
