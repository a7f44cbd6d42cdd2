"""A log of run events as a stream that can be left and taken up again at any event.

The log is a folder of Parquet files with run_id, sequence, type and further columns. Followed is one run, by its own
sequence, or the whole log, by a sequence over all runs. The offset is the last sequence delivered: what a client
sends back as its last event id. Only what has no gap before it is offered, so an event that another writer has not
written yet holds back those after it, and nothing is passed over. Tasks read ranges of sequences, and of the files
only the row groups that may hold them.

Defined results: an empty or missing folder offers nothing; an event written twice (a retry) is delivered once if it
is in one row group or in one range of its sequence, as a range keeps the first of each sequence; rows with a null
sequence are passed over; columns besides those of the schema are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from docquarry.operators.ingest import TERMINAL
from docquarry.sources.artifacts import _filesystem

SCHEMA = "run_id long, sequence long, type string, data string"


def _log(path: str) -> ds.Dataset | None:
    fs, root = _filesystem(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = sorted(f.path for f in found if f.base_name.endswith(".parquet") and "/_temporary/" not in f.path and f.size)
    return ds.dataset(files, filesystem=fs, format="parquet") if files else None


class Frontier:
    """Sequences seen after ``at``: ``at`` moves on over what has no gap, the rest is kept as intervals."""

    def __init__(self, at: int):
        self.at = at
        self.ahead: list[tuple[int, int]] = []

    def add(self, sequences: np.ndarray) -> None:
        new = np.unique(sequences[sequences > self.at])
        if len(new):
            cuts = np.flatnonzero(np.diff(new) > 1)
            self.ahead += zip(new[np.r_[0, cuts + 1]].tolist(), new[np.r_[cuts, len(new) - 1]].tolist(), strict=True)

    def close(self) -> int:
        merged: list[tuple[int, int]] = []
        for low, high in sorted(self.ahead):
            if low <= self.at + 1:
                self.at = max(self.at, high)
            elif merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        self.ahead = []
        return self.at


@dataclass
class Range(InputPartition):
    low: int
    high: int


class RunLogReader(DataSourceStreamReader):
    """Options: path; run (none: the whole log); after, the last sequence that the reader has (default 0);
    rows, the most sequences of a task."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.run = options["path"], options.get("run")
        self.after, self.rows = int(options.get("after", 0)), int(options.get("rows", 100_000))
        self.schema = schema
        self.seen = self.after

    def _where(self, low: int, high: int | None) -> pc.Expression:
        found = pc.field("sequence") > low
        if high is not None:
            found &= pc.field("sequence") <= high
        return found & (pc.field("run_id") == int(self.run)) if self.run is not None else found

    def initialOffset(self) -> dict:
        return {"sequence": self.after}

    def latestOffset(self) -> dict:
        """The driver reads sequences that are newer than the last ones, batch by batch, and keeps intervals."""
        log = _log(self.path)
        if log is not None:
            frontier = Frontier(self.seen)
            for batch in log.scanner(columns=["sequence"], filter=self._where(self.seen, None)).to_batches():
                frontier.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            self.seen = frontier.close()
        return {"sequence": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        low, high = start["sequence"], end["sequence"]
        return [Range(a, min(a + self.rows, high)) for a in range(low, high, self.rows)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        log = _log(self.path)
        names = self.schema.fieldNames()
        kept = np.zeros(partition.high - partition.low, dtype=bool)
        for batch in log.scanner(columns=names, filter=self._where(partition.low, partition.high)).to_batches():
            at = batch.column("sequence").to_numpy(zero_copy_only=False) - partition.low - 1
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= ~kept[at]
            kept[at] = True
            yield batch.filter(pa.array(first))


class RunLogSource(DataSource):
    """``spark.readStream.format("run_log").option("path", folder).option("after", last).load()``"""

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> RunLogReader:
        return RunLogReader(self.options, schema)


def tail(spark: SparkSession, path: str, run: int | None = None, after: int = 0, rows: int = 100_000) -> DataFrame:
    """The events after ``after``, as a stream (columns of ``SCHEMA``)."""
    spark.dataSource.register(RunLogSource)
    stream = spark.readStream.format("run_log").option("path", path).option("after", after).option("rows", rows)
    return (stream if run is None else stream.option("run", run)).load()


def _is_terminal(path: str, run: int, sequence: int) -> bool:
    log = _log(path)
    rows = log.to_table(columns=["type"], filter=(pc.field("run_id") == run) & (pc.field("sequence") == sequence)) if log else None
    return rows is not None and rows.num_rows > 0 and rows.column(0)[0].as_py() in TERMINAL


def follow(spark: SparkSession, path: str, out: str, run: int | None = None, after: int = 0, idle: float = 0.0) -> DataFrame:
    """Deliver events into the Parquet folder ``out`` until the run's last event is terminal, or, where it is not (or the
    whole log is followed), until nothing new came for ``idle`` seconds. A later call with the same ``out`` goes on after
    the last delivered event, whatever ``after`` says: a reopened run without gap or repeat."""
    stream = tail(spark, path, run, after)
    known = _delivered(spark, out)
    q = stream.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        last, since = None, time.monotonic()
        while True:
            q.processAllAvailable()
            ends = [p.sources[0].endOffset for p in q.recentProgress[-1:]]
            at = max([int(n) for e in ends for n in re.findall(r"-?\d+", e or "")] + ([known] if known is not None else []), default=after)
            if at != last:
                last, since = at, time.monotonic()
            if (run is not None and _is_terminal(path, run, at)) or time.monotonic() - since >= idle:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{out}/events")


def _delivered(spark: SparkSession, out: str) -> int | None:
    """The last sequence that an earlier call left in ``out``."""
    fs, root = _filesystem(out)
    if fs.get_file_info(f"{root}/events/_spark_metadata").type == pyarrow.fs.FileType.NotFound:
        return None
    return spark.read.schema(SCHEMA).parquet(f"{out}/events").agg(F.max("sequence")).first()[0]


def replayed(log: DataFrame, asks: DataFrame) -> DataFrame:
    """The events that each ask (ask_id, run_id, after) is owed at once: ask_id, the log's columns, and ``live``, whether
    the run goes on after them. A run reopened after a terminal event is replayed over that event. One join on the run;
    asks of unknown runs give nothing (see ``unknown_runs``), a null ``after`` counts as 0."""
    last = log.groupBy("run_id").agg(F.max_by("type", "sequence").alias("__last"))
    owed = asks.select("ask_id", "run_id", F.coalesce("after", F.lit(0)).alias("__after")).join(last, "run_id")
    live = ~F.coalesce(F.col("__last").isin(*TERMINAL), F.lit(False))
    return log.join(owed.withColumn("live", live), "run_id").where(F.col("sequence") > F.col("__after")).select("ask_id", *log.columns, "live")


def unknown_runs(log: DataFrame, asks: DataFrame) -> DataFrame:
    return asks.join(log.select("run_id").distinct(), "run_id", "left_anti")


def frame(run_id: Column, sequence: Column, kind: Column, data: Column) -> Column:
    """A server-sent event of the log; its id is what a client sends back, a run_result has no event line."""
    event = F.when(kind == "run_result", F.lit("")).otherwise(F.concat(F.lit("event: "), kind, F.lit("\n")))
    body = F.to_json(F.struct(run_id.alias("run_id"), kind.alias("type"), data.alias("data")))
    return F.concat(F.lit("id: "), sequence.cast("string"), F.lit("\n"), event, F.lit("data: "), body, F.lit("\n\n"))
