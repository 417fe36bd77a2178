"""Incremental intake: a file stream whose new documents go through the stages once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factengine.sources.store import Store, insert_or_ignore


def stream_intake(spark: SparkSession, landing: str, schema: StructType | str, store: Store, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None, content: str = "text", order: str = "doc_id", file_format: str = "parquet") -> StreamingQuery:
    """Takes what has landed and stops; a run without new files does nothing.

    The checkpoint remembers files. The same content in a new file is recognised by its hash: only rows whose hash is not
    in the ``documents`` table go through ``process`` and into it. Each batch is an increment of that table under its own
    number, so what is stored is never rewritten, and a batch that runs again after a failure replaces its own increment.
    """

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
        stored = store.read("documents", without=f"{number:09d}")
        known = stored.select("content_hash") if stored is not None else new.select("content_hash").limit(0)
        fresh = insert_or_ignore(known, new, "content_hash", F.col(order)).where("inserted").drop("inserted")
        done = process(fresh) if process else fresh
        store.append("documents", done, f"{number:09d}")

    source = spark.readStream.schema(schema).format(file_format).load(landing)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key and window of event time; the watermark bounds the state and drops what comes later."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("count"))
