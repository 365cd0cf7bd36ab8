"""Shared helpers: checkpoint folder, input sizes and reading tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='assaylake-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, through the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark).rsplit("/", 1)[0])
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one call in the shared folder: written once, read by what follows, removed where nothing reads them any more.

    A table that a returned, lazy result still reads has to stay; its folder is the caller's to clear with the checkpoints.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.held = spark, shared_dir(spark), {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of this call; those it doesn't hold are left alone.

        Shuffle files go when the driver's JVM collects the plans that wrote them, which a large heap puts off; so it is asked to.
        """
        for t in tables:
            if found := self.held.pop(id(t), None):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()  # what Python holds of those plans
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Exact size of a text column: one scan of that column, one number back."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunk_count(spark: SparkSession, total_bytes: int, chunk_bytes: int = 4 << 20) -> int:
    """How many chunks of about chunk_bytes so many bytes make; a multiple of the partitions, so that each gets some."""
    parts = shuffle_partitions(spark)
    wanted = -(-total_bytes // chunk_bytes)
    return parts * max(2, -(-wanted // parts))


def bucket_count(spark: SparkSession, total_bytes: int, bucket_bytes: int = 8 << 20) -> int:
    """How many ranges of hashes keep one range's share of so many bytes small, whatever the input's size; one a partition at least.

    Each chunk sends to and hears from each range that it has hashes in, so more ranges than that only make more and smaller messages.
    """
    return max(shuffle_partitions(spark), -(-total_bytes // bucket_bytes))


def chunk_of(doc_id: Column, text: Column, chunks: int) -> Column:
    """A chunk number from the row's content alone: the same in each attempt; copies of a text spread by their id."""
    return F.pmod(F.xxhash64(doc_id, F.xxhash64(text), F.lit(17)), F.lit(chunks).cast("long"))
