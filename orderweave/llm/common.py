"""What the operators share: table access, scratch tables in the shared folder, the word rule."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space that ends a word, as Java and RE2 regex.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without it, only a local master gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="orderweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs only a reread.

    ``keep`` writes a frame and returns it as a scan; ``drop`` deletes a scan's files once nothing reads them. Results
    are lazy and may read tables late, so the folder itself is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/ow-{uuid.uuid4().hex}", {}
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)  # what isn't dropped before goes with the driver

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *scans: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for scan in scans:
            _, path = self.paths.pop(id(scan))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` to the same columns, whatever their names; batches have them by place."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*df.columns)


def word_count(text: Column) -> Column:
    """How many maximal runs of other than white space a text has; a null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_CLASS + "+"))).cast("long")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null where the key is null."""
    return F.crc32(key.cast("string")) % F.lit(modulus)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A batch function whose worker gives what it has freed back to the system, as workers outlive their tasks."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner
