"""Resumable incremental ingest and embedding, and windows over journals (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lectern.engine import Engine


def ingest(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Hand new Parquet files to ``sink`` batch by batch, until all that are there are done; a rerun resumes after the last whole batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(engine: Engine, path: str, checkpoint: str, name: str = "books", embed: Callable[[Engine], object] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Take books (key, title, shelf, text, at) that arrive as Parquet files into a library, and have ``embed`` called after each batch.

    A batch and its number become one commit, so a batch that comes again after a failure changes nothing. ``at`` is when a text was
    written: of a key's texts the latest counts, whatever the order in which they come.
    """

    def take(batch: DataFrame, number: int) -> None:
        if engine.take_batch(name, number, batch) and embed:
            embed(engine)

    query = ingest(engine.spark, path, BOOKS, checkpoint, take, files_per_batch)
    return query


#: What arrives.
BOOKS = "key string, title string, shelf string, text string, at timestamp"


class Watch(StreamingQueryListener):
    """Tells from outside how far streams have come: a frame for each batch, and one last frame when a stream ends."""

    def __init__(self, say: Callable[[dict], None]) -> None:
        self.say = say

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.say({"run": str(event.runId), "stage": "start", "state": "running"})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.say({"run": str(p.runId), "stage": "batch", "state": "running", "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.say({"run": str(event.runId), "stage": "end", "state": "failed" if event.exception else "done", "final": True})


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and type; on a stream, late rows are waited for."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap of ``gap``."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
