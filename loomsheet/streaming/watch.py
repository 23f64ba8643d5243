"""A change feed: the change log as a stream; the checkpoint is the resume token."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import compile_filter
from ..plans import filters as f


def change_stream(spark: SparkSession, path: str, schema: T.StructType | str, node: Any = None, resume_after: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """(operation, id, doc, timestamp, cursor) of the log's entries as they arrive; the filter sees the log's columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    log = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    if resume_after is not None:
        log = log.filter(F.col("cursor") > resume_after)
    if node is not None and node != f.TRUE:
        log = log.filter(compile_filter(node, log.schema, "document"))
    return log.select(F.col("op").alias("operation"), F.col("docId").alias("id"), "doc", F.col("at").alias("timestamp"), "cursor")


def drain(changes: DataFrame, checkpoint: str, sink: str) -> int:
    """Everything that is there now, exactly once over calls with one checkpoint; rows go to parquet."""
    query = changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def watch(changes: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], Any], seconds: float | None = None):
    """Calls ``handle`` with each batch until the returned query is stopped."""
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Counts by event-time window, closed once the watermark has passed."""
    t = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", lateness)
    return t.groupBy(F.window("__time", width), *keys).agg(F.count(F.lit(1)).alias("n"))
