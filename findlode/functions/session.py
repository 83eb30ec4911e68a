"""The shared folder, cutting a plan's lineage in it, and the state of input files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of ids, or of ids with a few small values, are broadcast up to this many rows (some 30 to 100 MB).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset, on one machine."""
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


def if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, as counted; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def file_states(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that a table is read from."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out
