"""Scratch tables in the shared folder, and helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests, a laptop)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            return java.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        named = "file://" + tempfile.mkdtemp(prefix="findlode-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables of ids, or of ids with a few small values, are broadcast up to this many rows (some 30 to 100 MB).
BROADCAST_ROWS = 1_000_000


def if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, as counted; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Scratch:
    """Tables that live as long as one operator call.

    A table is written as Parquet to the shared folder and read again, which cuts its lineage and survives the loss of
    executors. ``close`` deletes them all; what an operator returns is therefore checkpointed first (``result``).
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        self._delete(self.path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` kept in the checkpoint folder, after which the scratch tables go."""
        shared_dir(self.spark)
        kept = df.checkpoint(eager=True)
        self.close()
        return kept

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``df``, found by their exact names, so that extra columns, whatever they are called, play no part."""
    names = df.columns
    plain = unnamed(df)
    return plain.select(*[F.col(f"_{names.index(c)}").alias(c) for c in columns])


def unnamed(df: DataFrame) -> DataFrame:
    """``df`` with its columns called _0, _1, ...; ``toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
