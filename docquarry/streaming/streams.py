"""Structured Streaming: event logs, telemetry, the outbox, and event-time windows.

Each query reads the event files as a stream (``availableNow``: what is there, in micro-batches), keeps its
state in checkpoints in the shared folder, and ends; the sink is then read as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.operators.state import drained, latest_per
from docquarry.session import new_path
from docquarry.sources.store import Store


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The events table as a stream; ts as a timestamp, for watermarks."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into files (append) and read them."""
    spark = stream.sparkSession
    root = new_path(spark, f"stream-{name}")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def completed(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run an aggregating stream; the sink keeps the last row of each key (update mode) or the last batch
    (complete mode, for sessions, whose windows move)."""
    spark = stream.sparkSession
    root = new_path(spark, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out/*")
    if mode == "complete":
        last = out.agg(F.max("__batch")).first()[0]
        return out.where(F.col("__batch") == last).drop("__batch")
    return latest_per(out, keys, ["__batch"]).drop("__batch")


def telemetry(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Idempotent enqueue: an id counts once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _sequence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, closed = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values("event_id")
    end = (rows["event_type"] == "error").to_numpy()
    n = 0 if closed else int(end.argmax()) + 1 if end.any() else len(rows)
    state.update((last + n, closed or bool(end[:n].any())))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy()[:n], "sequence": np.arange(last + 1, last + n + 1), "terminal": end[:n]})


def sequenced(events: DataFrame) -> DataFrame:
    """Gap-free sequence numbers for each run (user), none after its terminal event (an error).

    State is two numbers a run; batches carry only what the state needs.
    """
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(_sequence, "user_id long, event_id long, sequence long, terminal boolean", "last long, closed boolean", "append", GroupStateTimeout.NoTimeout)


def drain_outbox(events: DataFrame, store: Store, table: str, key: str = "record_id") -> DataFrame:
    """Apply a stream of work items (record_id, operation, event_id and the table's columns) to a table.

    A micro-batch is reduced to the last item of each record and committed at once, into the buckets that it
    touches. Batches are numbered in the store, so a batch that is run again after a failure is passed over.
    """
    spark = events.sparkSession
    marks = f"{table}_batches"

    def apply(batch: DataFrame, number: int) -> None:
        if marks in store.tables() and store.read(marks).where(F.col("batch") == number).limit(1).count():
            return
        done = spark.range(number, number + 1).select(F.col("id").alias("batch"))
        if marks in store.tables():
            done = store.read(marks).unionByName(done)
        store.commit({marks: done.coalesce(1)}, merges={table: (batch, [key], lambda old, new: drained(old, new, [key], ["event_id"]))})

    q = events.writeStream.foreachBatch(apply).option("checkpointLocation", new_path(spark, "outbox-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read(table)


def sse(events: DataFrame) -> DataFrame:
    """event_id, frame: server-sent event frames; a run_result has no event line."""
    data = F.to_json(F.struct("event_type", "user_id", "value"))
    event = F.when(F.col("event_type") == "run_result", F.lit("")).otherwise(F.concat(F.lit("event: "), F.col("event_type"), F.lit("\n")))
    return events.select("event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\n"), event, F.lit("data: "), data, F.lit("\n\n")).alias("frame"))
