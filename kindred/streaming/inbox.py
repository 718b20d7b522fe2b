"""New archives of a folder, profiled as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from kindred.config import Config
from kindred.plans import store

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls handle(paths, batch) with the (path, length) of what is new; the checkpoint makes each file come once."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path", "length")
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def profiles(spark: SparkSession, folder: str, config: Config, kept: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fills a store of fingerprints with what arrives; a batch that comes twice changes nothing."""

    def handle(batch: DataFrame, _: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # of one batch's new archives, which the file source lists on the driver too
        if paths:
            store.fill(batch.sparkSession, "\n".join(paths), config, kept)

    return watch(spark, folder, handle, checkpoint, **trigger)
