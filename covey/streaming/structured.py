"""Structured Streaming: basic windows with a watermark, and results of every finished epoch by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covey.plans.query import run_on_pairs
from covey.spec import QuerySpec
from covey.streaming.replay import checked


def basic_window_stream(events: DataFrame, size: str = "1 hour", late: str = "2 hours", how: str = "sum") -> DataFrame:
    """(id, t, v) of a stream events(id, ts, value): closed when the watermark has passed; repeated events count once.

    Windows are closed on the right: an event at the very end of one belongs to it, so times are moved back by the
    smallest step before Spark's left-closed windows apply.
    """
    marked = events.withColumn("ts", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("ts", late)
    if "event_id" in events.columns:
        marked = marked.dropDuplicatesWithinWatermark(["event_id"])
    agg = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double"), "first": F.min_by("value", "ts"), "last": F.max_by("value", "ts")}[how]
    return marked.groupBy(F.window("ts", size), "id").agg(agg.alias("v")).select("id", F.col("window.end").alias("t"), "v")


def run_stream(windows: DataFrame, spec: QuerySpec, table: str, width_seconds: int, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query: each batch adds its closed windows to the parquet folder ``table`` and evaluates the sliding window.

    A batch is written under its number, so a batch that runs again replaces what it wrote before.
    """
    spec = checked(spec)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        kept = spark.read.parquet(table).where(F.col("batch") <= number)
        end = kept.agg(F.max("t")).first()[0]
        if end is None:
            return
        from covey.operators.pairs import long_correlations
        from covey.operators.series import dense

        now = kept.where(F.col("t") > F.lit(end) - F.expr(f"interval {width_seconds} seconds")).select("id", "t", "v")
        pairs = long_correlations(dense(now))
        sink(run_on_pairs(pairs, spec), number)

    writer = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
