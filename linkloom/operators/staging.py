"""Tables written once between steps, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HELD: list[str] = []
#: Bytes that a join sends to every executor at most.
BROADCAST = 32 << 20


def _root(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, root: str | None = None) -> DataFrame:
    """df, written once: a download, a probe or a parse isn't run again by later steps."""
    path = f"{root or _root(df.sparkSession)}/_staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _HELD.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes all that stage() wrote in this process, once results are stored."""
    while _HELD:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_HELD.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, row_bytes: int) -> DataFrame | None:
    """df marked for broadcast if its counted rows take at most BROADCAST bytes; else None."""
    return F.broadcast(df) if df.limit(BROADCAST // row_bytes + 1).count() * row_bytes <= BROADCAST else None
