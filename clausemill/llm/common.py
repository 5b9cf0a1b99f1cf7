"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread  # noqa: F401  used by the operators

#: Words of the contracts: maximal runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets one of its own; on a cluster that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = f"file://{tempfile.gettempdir()}/checkpoints"
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive lost executors. Also keeps broadcasts until they are dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/clausemill-{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.shared: list[Broadcast] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def share(self, value: object) -> Broadcast:
        """A broadcast that ends with unshare(), once no later plan needs it."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def unshare(self) -> None:
        while self.shared:
            self.shared.pop().destroy()

    def settle(self) -> None:
        """Has the driver collect its garbage, as plans, broadcasts and shuffle files of finished jobs stay until it does. For operators of many jobs."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Forgets tables that no later plan reads."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.names if n not in names])
        self.names = [n for n in self.names if n in names]

    def close(self) -> None:
        """Forgets everything."""
        self.unshare()
        self._delete(self.root)
        self.names = []

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Gives a worker's freed memory back, as workers are used again and don't shrink by themselves."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_count(text: Column) -> Column:
    """Number of WORD runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Whether the fold is 0; a null id is never held out."""
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns of `docs` as one struct `row`, so that no name clashes with an operator's own columns."""
    return docs.select(F.struct("*").alias("row"))
