"""Streams: a folder of new documents, and the feedback journal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwood.operators import feedback
from siftwood.sources.store import Store

JOURNAL = "seq long, q string, shown array<long>, picked long, sign int"


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """The journal's JSON lines as a stream."""
    return spark.readStream.schema(JOURNAL).json(folder)


def follow_journal(stream: DataFrame, table: str, checkpoint: str, learn: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Appends events to a Parquet table; learn gets each micro-batch in order, as sequential learners need.

    A batch writes to a folder of its own number, so a repeated batch overwrites itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")
        if learn:
            learn(batch.orderBy("seq"), number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def running_feedback(stream: DataFrame, name: str) -> StreamingQuery:
    """Sums of feedback per document, kept up to date in an in-memory table."""
    return feedback.doc_feedback(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def ingest_folder(spark: SparkSession, folder: str, store: Store, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch of new text files becomes one segment of the store."""
    stream = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("text"), F.input_file_name().alias("source"))

    def step(batch: DataFrame, number: int) -> None:
        done = set(store.read_note("BATCHES", []))
        if number not in done:
            store.append(chunk(batch))
            store.write_note("BATCHES", sorted({*done, number}))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_windows(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per user and session, with a watermark for what comes late; works on a stream and on a batch."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), user).agg(F.count("*").alias("n"))
