"""State tables: reconciliation, outbox, content ledger, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.ids import stale_delete_id

PROJECTION = ("record_id", "input_hash", "model", "dimensions")


def reconcile(existing: DataFrame, desired: DataFrame, key: str = "entity_key", projection: tuple[str, ...] = PROJECTION) -> DataFrame:
    """key and change (new, changed, unchanged, stale), with the desired row, or the existing one if stale.

    Unchanged needs an equal projection and an existing row whose sync_status is synced. One full outer join.
    """
    e, d = existing.alias("e"), desired.alias("d")
    both = e.join(d, F.col(f"e.{key}") == F.col(f"d.{key}"), "full_outer")
    same = F.lit(True)
    for c in projection:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}"))
    change = F.when(F.col(f"e.{key}").isNull(), "new").when(F.col(f"d.{key}").isNull(), "stale").when(same & (F.col("e.sync_status") == "synced"), "unchanged").otherwise("changed")
    keep = [c for c in desired.columns if c in existing.columns and c != key]
    stale = F.col(f"d.{key}").isNull()
    return both.select(F.coalesce(f"d.{key}", f"e.{key}").alias(key), change.alias("change"), *[F.when(stale, F.col(f"e.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in keep])


def stale_events(changes: DataFrame, run_id: str, document_ref: str, source_version: str) -> DataFrame:
    """A delete event for each stale row of ``reconcile`` (entity_type, collection, record_id, index_version …)."""
    s = changes.where(F.col("change") == "stale")
    return s.select(
        stale_delete_id(F.lit(run_id), F.col("entity_type"), F.col("entity_key"), F.col("collection"), F.col("record_id"), F.col("index_version")).alias("event_id"),
        F.lit(run_id).alias("run_id"), F.coalesce("document_ref", F.lit(document_ref)).alias("document_ref"), F.coalesce("source_version", F.lit(source_version)).alias("source_version"),
        "collection", "record_id", F.lit("delete").alias("operation"), F.lit("{}").alias("payload"), "index_version",
    )


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after upserts: rows of changes win by key."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def replaced(table: DataFrame, scope: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The table without the scope's rows, and with ``rows``."""
    return table.join(scope.select(*on).distinct(), on, "left_anti").unionByName(rows)


def latest_per(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key by order: partial aggregation, no window."""
    others = [c for c in events.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("last")
    return events.groupBy(*key).agg(last).select(*key, "last.*")


def drained(table: DataFrame, events: DataFrame, key: list[str], order: list[str], operation: str = "operation") -> DataFrame:
    """The table after all events: the last event of each key decides; its operation is upsert or delete."""
    last = latest_per(events, key, order)
    rows = last.where(F.col(operation) == "upsert").select(*table.columns)
    return table.join(last.select(*key), key, "left_anti").unionByName(rows)


def enqueue(outbox: DataFrame, events: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """New events (by event_id, one each), and the conflicts: ids whose payload differs from a known one.

    Rows are dealt by id before they are counted: ids hardly repeat, so a count where they lie would hold all of a
    file's part. Payloads differ where the least and the most of a column do, or some are null and some are not.
    """
    given = events.withColumn("__known", F.lit(False))
    known = outbox.where("event_id IS NOT NULL").select("event_id", *payload).withColumn("__known", F.lit(True))
    rows = given.unionByName(known, allowMissingColumns=True).repartition("event_id")
    differ = F.lit(False)
    for c in payload:
        differ |= F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    others = [c for c in events.columns if c != "event_id"]
    each = rows.groupBy("event_id").agg(*[F.first(c).alias(c) for c in others], F.max("__known").alias("__known"), F.min("__known").alias("__alone"), differ.alias("__differ"))
    fresh = each.where(~F.col("__known") & (~F.col("__differ") | F.col("event_id").isNull())).select(*events.columns)
    return fresh, each.where(F.col("__differ") & ~F.col("__alone")).select("event_id")


def next_batch(outbox: DataFrame, limit: int | None, run_id: str | None = None) -> DataFrame:
    """Pending and failed events by event_id; all of them, in no order, without a limit."""
    open_ = outbox.where(F.col("status").isin("pending", "failed"))
    if run_id is not None:
        open_ = open_.where(F.col("run_id") == run_id)
    return open_ if limit is None else open_.orderBy("event_id").limit(limit)


def transitioned(outbox: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outbox after outcomes (event_id, outcome, error): a failure counts an attempt and keeps the error."""
    o = outcomes.select("event_id", "outcome", "error")
    x = outbox.join(o, "event_id", "left")
    failed = F.col("outcome") == "failed"
    return x.withColumns(
        {"status": F.coalesce("outcome", "status"), "attempts": F.col("attempts") + F.when(failed, 1).otherwise(0), "last_error": F.when(failed, F.col("error")).when(F.col("outcome").isNotNull(), F.lit(None)).otherwise(F.col("last_error"))}
    ).drop("outcome", "error")


def reserve(requests: DataFrame, ledger: DataFrame, key: list[str], now: Column, timeout_minutes: int = 60) -> DataFrame:
    """requests with outcome: ready (known), busy (in work, fresh), reserved (one winner a key, the first by
    request_id), shared (others of a reserved key in this batch); recovered marks a stale one taken over."""
    l = ledger.select(*key, F.col("status").alias("__status"), F.col("updated_at").alias("__at"))
    x = requests.join(l, key, "left")
    stale = (F.col("__status") == "processing") & (now - F.col("__at") >= F.expr(f"INTERVAL {timeout_minutes} MINUTES"))
    least = requests.groupBy(*key).agg(F.min("request_id").alias("__first"))  # a hot key costs a row a task
    x = x.join(least, key, "left")
    first = F.col("request_id") == F.col("__first")
    outcome = F.when(F.col("__status") == "ready", "ready").when((F.col("__status") == "processing") & ~stale, "busy").when(first, "reserved").otherwise("shared")
    return x.withColumns({"outcome": outcome, "recovered": F.coalesce(stale, F.lit(False)) & first}).drop("__status", "__at", "__first")


def collisions(rows: DataFrame, digest: str = "sha256", others: tuple[str, ...] = ("md5", "byte_length")) -> DataFrame:
    """Digests with more than one fingerprint."""
    return rows.groupBy(digest).agg(F.count_distinct(F.struct(*others)).alias("n")).where("n > 1")


def latest_ready(ledger: DataFrame, key: list[str]) -> DataFrame:
    """The last ready row of each key, by updated_at."""
    return latest_per(ledger.where(F.col("status") == "ready"), key, ["updated_at"])


def cached(requests: DataFrame, cache: DataFrame, key: list[str], value: str) -> DataFrame:
    """requests with the cached value, and hit; misses (not hit) are what a provider is asked for."""
    return requests.join(cache.select(*key, value), key, "left").withColumn("hit", F.col(value).isNotNull())


def representatives(rows: DataFrame, key: list[str], id_: str) -> DataFrame:
    """rows with representative (the least id of equal keys) and whether the row is a reuse of it."""
    first = rows.groupBy(*key).agg(F.min(id_).alias("representative"))
    return rows.join(first, key).withColumn("reused", F.col(id_) != F.col("representative"))


#: Legal edges of a run's state; null is before the first.
EDGES = ((None, "processing"), ("processing", "pending"), ("processing", "failed"), ("pending", "ready"), ("pending", "failed"), ("failed", "processing"))


def transitions(log: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """The log with previous state and whether the edge is legal."""
    edges = F.broadcast(log.sparkSession.createDataFrame(EDGES, "__from string, __to string"))  # six rows
    x = log.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    x = x.join(edges, F.col("previous").eqNullSafe(F.col("__from")) & (F.col(state) == F.col("__to")), "left")
    return x.withColumn("legal", F.col("__to").isNotNull()).drop("__from", "__to")


def bucket_digests(states: DataFrame, key: str = "entity_key", projection: tuple[str, ...] = PROJECTION, buckets: int = 256) -> DataFrame:
    """bucket (of the key), n, d1, d2: what tells whether a bucket of states has changed. Kept beside a table, it
    saves reading the buckets that have not. A row that is not synced never agrees with one that is."""
    row = F.struct(key, *projection, "sync_status")
    hashed = states.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(F.lit(1), F.to_json(row)).alias("a"), F.xxhash64(F.lit(2), F.to_json(row)).alias("b"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("a").alias("d1"), F.bit_xor("b").alias("d2"))


def changes_by_digest(existing: DataFrame, desired: DataFrame, digests: DataFrame | None = None, key: str = "entity_key", projection: tuple[str, ...] = PROJECTION, buckets: int = 256) -> tuple[DataFrame, int]:
    """``reconcile`` without its unchanged rows, from the buckets alone whose digests differ, and how many these are.

    ``digests`` are those kept with ``existing`` (see ``bucket_digests``), else they are computed; keys are unique on
    either side. The driver holds the numbers of the buckets that differ.
    """
    known = bucket_digests(existing, key, projection, buckets) if digests is None else digests
    wanted = bucket_digests(desired.withColumn("sync_status", F.lit("synced")), key, projection, buckets)
    k, w = known.alias("k"), wanted.alias("w")
    same = F.col("k.n").eqNullSafe(F.col("w.n")) & F.col("k.d1").eqNullSafe(F.col("w.d1")) & F.col("k.d2").eqNullSafe(F.col("w.d2"))
    differ = [r[0] for r in k.join(w, F.col("k.bucket") == F.col("w.bucket"), "full_outer").where(~same).select(F.coalesce("k.bucket", "w.bucket")).collect()]
    inside = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").isin(differ)
    return reconcile(existing.where(inside), desired.where(inside), key, projection).where("change != 'unchanged'"), len(differ)
