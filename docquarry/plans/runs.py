"""Queries of run logs and timers over the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.plans.queries import query
from docquarry.session import new_path, table
from docquarry.streaming import runlog, streams, timers

_KIND = "CASE event_type WHEN 'purchase' THEN 'run_completed' WHEN 'error' THEN 'run_failed' ELSE event_type END"


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "run_completed").when(F.col("event_type") == "error", "run_failed").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("sequence"), kind.alias("type"), F.col("event_type").alias("data"))


@query(f"""WITH l AS (SELECT user_id, event_id + 1 AS sequence, {_KIND} AS type FROM events),
t AS (SELECT user_id, arg_max(type, sequence) NOT IN ('run_completed', 'run_failed') AS live FROM l GROUP BY 1)
SELECT c_custkey AS ask_id, user_id AS run_id, sequence, type, live FROM customer JOIN l ON user_id = c_custkey JOIN t USING (user_id) WHERE sequence > coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 60 END, 0)""")
def run_replay(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ask_id"), key.alias("run_id"), F.when(key % 5 > 0, key * 60).alias("after"))
    return runlog.replayed(_log(spark, sf_dir), asks).drop("data")


@query(f"""SELECT user_id AS run_id, event_id + 1 AS sequence, 'id: ' || event_id + 1 || chr(10) || 'event: ' || {_KIND} || chr(10) || 'data: {{"run_id":' || user_id || ',"type":"' || {_KIND} || '","data":"' || event_type || '"}}' || chr(10) || chr(10) AS frame FROM events""")
def stream_log_tail(spark, sf_dir):
    """The whole log, followed until nothing is new, left, and taken up again once the rest was written."""
    path, out = new_path(spark, "run-log"), new_path(spark, "run-log-tail")
    log = _log(spark, sf_dir)
    first = F.col("run_id") % 2 == 0  # leaves gaps everywhere, so that the log is offered up to the first of them only
    log.where(first).write.parquet(path)
    runlog.follow(spark, path, out)
    log.where(~first).write.mode("append").parquet(path)
    got = runlog.follow(spark, path, out)
    return got.select("run_id", "sequence", runlog.frame(F.col("run_id"), F.col("sequence"), F.col("type"), F.col("data")).alias("frame"))


def _timed_sql(final: bool) -> str:
    """The outcomes of all rows that the watermark has passed, one row of each user at a step."""
    done = "kind = 'done' AND live OR ready" if final else "false"
    return f"""WITH RECURSIVE cut AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS most FROM events),
e AS (SELECT user_id AS k, event_id AS r, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'start' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts < (SELECT most FROM cut)),
s AS (SELECT DISTINCT k, 0::BIGINT AS n, NULL::TIMESTAMP AS was, NULL::BIGINT AS held, false AS live, NULL::VARCHAR AS outcome, NULL::TIMESTAMP AS opened, NULL::BIGINT AS holder, NULL::BIGINT AS r, NULL::TIMESTAMP AS ts, false AS ready FROM e
UNION ALL SELECT k, n, was, held, live,
  CASE WHEN kind = 'start' THEN CASE WHEN ready THEN 'ready' WHEN live THEN 'busy' ELSE 'reserved' END WHEN live THEN kind ELSE 'refused' END,
  CASE WHEN kind = 'start' AND NOT ready THEN CASE WHEN live THEN was ELSE ts END WHEN kind <> 'start' AND NOT live THEN NULL END,
  CASE WHEN kind = 'start' AND NOT ready THEN CASE WHEN live THEN held ELSE r END END, r, ts, {done}
  FROM (SELECT e.*, s.opened AS was, s.holder AS held, s.ready, s.opened IS NOT NULL AND e.ts - s.opened < INTERVAL 1 DAY AS live FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1)),
ends AS (SELECT k, opened, holder FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)
SELECT k::VARCHAR AS key, r AS request_id, CASE WHEN outcome = 'reserved' THEN holder WHEN live THEN held END AS holder, ts, outcome, CASE WHEN outcome IN ('done', 'failed') THEN (epoch_us(ts) - epoch_us(was)) / 1e6 END AS seconds FROM s WHERE n > 0
UNION ALL SELECT k::VARCHAR, NULL, held, was + INTERVAL 1 DAY, 'timed_out', 86400.0 FROM s WHERE n > 0 AND was IS NOT NULL AND NOT live
UNION ALL SELECT k::VARCHAR, NULL, holder, opened + INTERVAL 1 DAY, 'timed_out', 86400.0 FROM ends WHERE opened IS NOT NULL AND opened + INTERVAL 1 DAY < (SELECT most FROM cut)"""


def _timed(spark, sf_dir, final):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("start")
    requests = streams.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), "ts", kind.alias("kind"), F.lit(None).cast("long").alias("token"))
    return streams.finished(timers.timed(requests, 86400, "1 hour", final), "timed")


@query(_timed_sql(True))
def stream_reservations(spark, sf_dir):
    return _timed(spark, sf_dir, True)


@query(f"SELECT key, holder, ts, outcome, seconds FROM ({_timed_sql(False)}) WHERE outcome IN ('done', 'failed', 'timed_out')")
def stream_calls(spark, sf_dir):
    """Calls and how they ended; one that nobody ends is timed out by the clock."""
    ended = F.col("outcome").isin("done", "failed", "timed_out")
    return _timed(spark, sf_dir, False).where(ended).select("key", "holder", "ts", "outcome", "seconds")
