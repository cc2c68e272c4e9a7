"""Incremental ingestion and index building with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from bitsift.functions.paths import has_suffix
from bitsift.operators.catalog import Catalog, Duplicate, content_hash
from bitsift.operators.ivf import IvfIndex, build


def file_stream(spark: SparkSession, path: str, suffixes: str = "jpg,png,webp", max_files: int = 1000) -> DataFrame:
    """New files of a folder as (path, data); max_files a batch is the back-pressure."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return found.where(has_suffix(F.col("path"), suffixes)).select("path", F.col("content").alias("data"))


def add_stream(items: DataFrame, catalog: Catalog, codes_of: Callable[[DataFrame], DataFrame], checkpoint: str, policy: Duplicate | str = Duplicate.IGNORE, min_features: int = 250, index: IvfIndex | None = None) -> StreamingQuery:
    """Adds each micro-batch of (path, data) to the catalog and, if given, the index.

    Adding is idempotent: hashes that a repeated batch brings again are known, and
    a segment written again replaces itself.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        items = codes_of(df.select("path", "data", content_hash(F.col("data")).alias("hash"))).select("path", "hash", "codes")
        items.persist()
        try:
            catalog.add(items, policy, min_features)
            if index is not None:
                build(catalog, index)
        finally:
            items.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_stream(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and tumbling window, closed by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class ProgressPush(StreamingQueryListener):
    """Hands the figures of each batch to a function, which may push them on."""

    def __init__(self, push: Callable[[dict], None]):
        self.push = push

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.push({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
