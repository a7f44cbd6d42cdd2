"""Following a run over its end and reopening; reservations and calls that time out by themselves."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from docquarry.operators import state
from docquarry.session import new_path
from docquarry.streaming import runlog, streams, timers

START = dt.datetime(2024, 1, 1)


def _append(spark, path, rows):
    spark.createDataFrame(rows, runlog.SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _events(run, first, kinds):
    return [(run, first + i, kind, f"{run}-{first + i}") for i, kind in enumerate(kinds)]


def test_a_run_is_followed_to_its_end_and_on_after_reopening(spark):
    path, out = new_path(spark, "log"), new_path(spark, "followed")
    _append(spark, path, _events(1, 1, ["run_started", "node", "run_completed"]) + _events(2, 1, ["run_started", "node"]))
    got = runlog.follow(spark, path, out, run=1, idle=60)  # ends by the terminal event, long before a minute is over
    assert sorted(r.sequence for r in got.collect()) == [1, 2, 3]
    _append(spark, path, _events(1, 4, ["run_reopened", "node"]) + _events(1, 2, ["node"]))  # one written twice
    _append(spark, path, _events(1, 7, ["run_completed"]))  # 6 is missing yet
    got = runlog.follow(spark, path, out, run=1, idle=0.5)
    assert sorted(r.sequence for r in got.collect()) == [1, 2, 3, 4, 5]
    _append(spark, path, _events(1, 6, ["node"]))
    got = runlog.follow(spark, path, out, run=1, after=99, idle=60)  # the checkpoint decides
    assert sorted((r.sequence, r.data) for r in got.collect()) == [(n, f"1-{n}") for n in range(1, 8)]
    again = runlog.follow(spark, path, out, run=1, idle=60)  # nothing new, and the run has ended
    assert again.count() == 7
    late = runlog.follow(spark, path, new_path(spark, "late"), run=1, after=5, idle=60)
    assert sorted(r.sequence for r in late.collect()) == [6, 7]


def test_ranges_of_a_long_run_are_read_by_several_tasks(spark):
    path = new_path(spark, "long-log")
    _append(spark, path, [(1, n, "node", "") for n in range(1, 2001)])
    stream = runlog.tail(spark, path, run=1, rows=300)
    q = stream.writeStream.format("memory").queryName("long_run").option("checkpointLocation", new_path(spark, "long-checkpoint")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.sequence for r in spark.table("long_run").collect()) == list(range(1, 2001))
    finally:
        q.stop()
    reader = runlog.RunLogReader({"path": path, "run": "1", "rows": "300"}, stream.schema)
    assert len(reader.partitions(reader.initialOffset(), reader.latestOffset())) == 7
    assert runlog.RunLogReader({"path": new_path(spark, "no-log")}, stream.schema).latestOffset() == {"sequence": 0}


def test_frontier_stops_at_gaps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        have = rng.choice(np.arange(1, 30), size=rng.integers(0, 29), replace=True)
        at = int(rng.integers(0, 5))
        f = runlog.Frontier(at)
        for part in np.array_split(have, 3):
            f.add(part)
        want = at
        while want + 1 in set(have.tolist()):
            want += 1
        assert f.close() == want


def test_replay_for_many_asks(spark):
    log = spark.createDataFrame(_events(1, 1, ["node", "run_failed", "run_reopened", "node"]) + _events(2, 1, ["node", "run_completed"]), runlog.SCHEMA)
    asks = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 2, 2), (4, 2, 1), (5, 9, 0), (6, None, 0)], "ask_id int, run_id long, after long")
    got = {}
    for r in runlog.replayed(log, asks).collect():
        got.setdefault((r.ask_id, r.live), []).append(r.sequence)
    assert {k: sorted(v) for k, v in got.items()} == {(1, True): [2, 3, 4], (2, True): [1, 2, 3, 4], (4, False): [2]}
    assert sorted(r.ask_id for r in runlog.unknown_runs(log, asks).collect()) == [5, 6]


def _streamed(spark, rows, timeout, late="0 seconds", final=True):
    """Each list of rows (key, request, minute, kind, token) is a micro-batch."""
    path = new_path(spark, "requests")
    schema = "key string, request_id long, ts timestamp, kind string, token long"
    for batch in rows:
        ready = [(k, r, None if m is None else START + dt.timedelta(minutes=m), kind, t) for k, r, m, kind, t in batch]
        spark.createDataFrame(ready, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.finished(timers.timed(stream, timeout * 60, late, final), "timed").collect()
    return sorted(((r.key, (r.ts - START).total_seconds() / 60, r.request_id, r.outcome) for r in out), key=lambda x: (x[0], x[1], x[2] or 0))


def test_stale_reservations_fail_at_the_border(spark):
    rows = [[("a", 1, 0, "start", None), ("b", 2, 1, "start", None)], [("a", 3, 59, "start", None)], [("a", 4, 60, "start", None), ("b", 5, 10, "done", 7)], [("a", 6, 61, "done", 1), ("a", 7, 62, "done", 4)], [("a", 8, 63, "start", None), ("z", 9, 300, "start", None)]]
    got = _streamed(spark, rows, 60, late="50 minutes")
    assert [x[1:] for x in got if x[0] == "a"] == [(0, 1, "reserved"), (59, 3, "busy"), (60, None, "timed_out"), (60, 4, "reserved"), (61, 6, "refused"), (62, 7, "done"), (63, 8, "ready")]
    assert [x[1:] for x in got if x[0] == "b"] == [(1, 2, "reserved"), (10, 5, "refused"), (61, None, "timed_out")]


def test_streamed_and_batch_reservations_agree(spark):
    starts = [("a", 1, 0), ("a", 2, 59.999), ("a", 3, 60), ("b", 4, 61), ("a", 5, 119), ("b", 6, 121), ("a", 7, 120)]
    got = _streamed(spark, [[(k, r, m, "start", None)] for k, r, m in sorted(starts, key=lambda s: s[2])] + [[("end", 99, 1000, "start", None)]], 60)
    streamed = {r: o for _, _, r, o in got if o in ("reserved", "busy")}
    ledger: dict[str, float] = {}
    want = {}
    for k, r, m in sorted(starts, key=lambda s: s[2]):
        rows = [(key, "processing", START + dt.timedelta(minutes=at)) for key, at in ledger.items()]
        x = state.reserve(spark.createDataFrame([(k, r)], "key string, request_id long"), spark.createDataFrame(rows, "key string, status string, updated_at timestamp"), ["key"], F.lit(START + dt.timedelta(minutes=m))).first()
        want[r] = x.outcome
        if x.outcome == "reserved":
            ledger[k] = m
    assert streamed == want


def test_calls_time_out_without_another_row(spark):
    rows = [[("c1", 1, 0, "start", None), ("c2", 2, 0, "start", None), (None, 3, 0, "start", None), ("c3", None, 0, "start", None), ("c4", 4, None, "start", None), ("c5", 5, 0, "other", None)], [("c1", 6, 3, "failed", None)], [("clock", 7, 50, "start", None)]]
    got = _streamed(spark, rows, 5, final=False)
    assert got == [("c1", 0, 1, "reserved"), ("c1", 3, 6, "failed"), ("c2", 0, 2, "reserved"), ("c2", 5, None, "timed_out")]
