"""Structured Streaming: a folder of link files into the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.staging import drop_staged
from ..plans.pipeline import Pipeline


def stream_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """path, modificationTime and content of files as they come."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kinds).option("maxFilesPerTrigger", files_a_batch).load(folder)


def collect_into(pipeline: Pipeline, stream: DataFrame, checkpoint: str, path: str, after: Callable[[Pipeline], None] = lambda p: None):
    """Merges each micro-batch into the store under path. Late files rewrite
    what was first seen, so no watermark may drop them. A commit holds the
    batch's number and the checkpoint's name, and a batch that one holds is
    skipped: a batch that comes again, after a failure between the two, or a
    new driver on an old checkpoint, counts once. after is called with the
    pipeline, read from the store, once a batch is in."""

    def merge(batch: DataFrame, number: int) -> None:
        tag = f"{checkpoint.rstrip('/')}#{number}"
        if tag not in store.tags(pipeline.spark, path):
            at = batch.agg(F.max(F.unix_seconds("modificationTime"))).first()[0]
            if at is None:
                return
            new = Pipeline.load(pipeline.spark, path, pipeline.lists)
            new.add_blobs(batch.select(F.col("path").alias("url"), F.col("content").alias("data")), at).run().commit(path, tag)
            drop_staged(pipeline.spark)
        stored = Pipeline.load(pipeline.spark, path, pipeline.lists)
        pipeline.sources, pipeline.servers, pipeline.sightings = stored.sources, stored.servers, stored.sightings
        after(pipeline)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
