"""Outbox events applied to the chunk index, the concept index and the vector states.

An event's collection decides which index it touches. Each is decoded and checked by itself, so one that fails is
marked and stops no other; of one record's events the last by event_id decides what its index holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.ids import concept_record_id
from docquarry.functions.vectors import is_vector
from docquarry.operators import state

# Collections, the fields of the payloads' records and the error texts.
CHUNKS, CONCEPTS = "document_chunks", "concept_catalog"
UNSUPPORTED = "unsupported vector collection"
INVALID = "vector upsert payload is invalid"
INVALID_CONCEPT = "vector concept upsert payload is invalid"
MISMATCH = "vector upsert payload identity does not match event"
TAKEN = "vector state already exists with a different identity"
RECORD = "struct<record:struct<chunk_id:string,document_ref:string,source_version:string,search_text:string,embedding:array<double>,embedding_profile:string,access_scope:string,metadata:map<string,string>>>"
CONCEPT = "struct<record:struct<record_id:string,canonical_label:string,normalized_label:string,search_text:string,embedding:array<double>,usage_count:bigint,embedding_input_hash:string,embedding_model:string,embedding_dimensions:int,index_version:string,metadata:map<string,string>>>"
STATE = ["entity_type", "entity_key", "collection", "record_id", "input_hash", "model", "dimensions", "index_version", "sync_status", "document_ref", "source_version"]
IDENTITY = ["entity_type", "entity_key", "collection", "index_version"]


def _filled(record: Column, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= ~T.is_blank(record[n])
    return out


def decoded(events: DataFrame) -> DataFrame:
    """Events (event_id, collection, operation, record_id, document_ref, payload) with ``record`` (of a chunk),
    ``concept`` and ``error``: a collection that is not known, a payload that is not whole or sound, a record that is
    not the event's. A delete needs no payload."""
    is_chunk, is_concept = F.col("collection") == CHUNKS, F.col("collection") == CONCEPTS
    x = events.withColumn("record", F.when(~is_concept, F.from_json("payload", RECORD)["record"])).withColumn("concept", F.when(is_concept, F.from_json("payload", CONCEPT)["record"]))
    r, c = F.col("record"), F.col("concept")
    chunk_ok = _filled(r, "chunk_id", "document_ref", "source_version", "search_text", "embedding_profile", "access_scope") & T.is_safe_document_ref(r["document_ref"]) & is_vector(r["embedding"]) & r["metadata"].isNotNull()
    concept_ok = (
        _filled(c, "record_id", "canonical_label", "normalized_label", "search_text", "embedding_input_hash", "embedding_model", "index_version") & (c["record_id"] == concept_record_id(c["normalized_label"])) & is_vector(c["embedding"])
        & (c["embedding_dimensions"] == F.size(c["embedding"])) & (c["usage_count"] >= 0) & c["embedding_input_hash"].rlike("^[0-9a-f]{64}$") & c["metadata"].isNotNull()
    )
    error = (
        F.when(~F.coalesce(is_chunk | is_concept, F.lit(False)), UNSUPPORTED)
        .when(F.col("operation") == "delete", F.lit(None))
        .when(is_chunk & ~F.coalesce(chunk_ok, F.lit(False)), INVALID)
        .when(is_concept & ~F.coalesce(concept_ok, F.lit(False)), INVALID_CONCEPT)
        .when(is_chunk & ((r["chunk_id"] != F.col("record_id")) | (r["document_ref"] != F.col("document_ref"))), MISMATCH)
        .when(is_concept & (c["record_id"] != F.col("record_id")), MISMATCH)
    )
    return x.withColumn("error", error)


def _mark() -> Column:
    """The state that a decoded event leaves; null for all but good upserts."""
    r, c, null = F.col("record"), F.col("concept"), F.lit(None).cast("string")
    own = F.trim(r["metadata"]["index_version"])
    version = F.coalesce("index_version", F.when(F.length(own) > 0, own), r["source_version"])
    chunk = F.struct(
        F.lit("chunk").alias("entity_type"), r["chunk_id"].alias("entity_key"), "collection", r["chunk_id"].alias("record_id"), F.sha2(r["search_text"], 256).alias("input_hash"), r["embedding_profile"].alias("model"),
        F.size(r["embedding"]).alias("dimensions"), version.alias("index_version"), F.lit("synced").alias("sync_status"), r["document_ref"].alias("document_ref"), r["source_version"].alias("source_version"),
    )
    concept = F.struct(
        F.lit("concept").alias("entity_type"), c["normalized_label"].alias("entity_key"), "collection", c["record_id"].alias("record_id"), c["embedding_input_hash"].alias("input_hash"), c["embedding_model"].alias("model"),
        c["embedding_dimensions"].alias("dimensions"), c["index_version"].alias("index_version"), F.lit("synced").alias("sync_status"), null.alias("document_ref"), F.col("source_version"),
    )
    good = F.col("error").isNull() & (F.col("operation") == "upsert")
    return F.when(good & (F.col("collection") == CHUNKS), chunk).when(good & (F.col("collection") == CONCEPTS), concept)


def marks(batch: DataFrame) -> DataFrame:
    """The states that good upserts of decoded events leave, with their event_id."""
    return batch.select("event_id", _mark().alias("mark")).where("mark IS NOT NULL").select("event_id", "mark.*")


def _transitioned(outbox: DataFrame, opened: DataFrame, refused: DataFrame) -> DataFrame:
    """``state.transitioned`` of an outbox whose open events are all in the batch, from those that failed (event_id, __error)."""
    x = opened.join(refused, "event_id", "left")
    failed = F.col("__error").isNotNull()
    own = {"status": F.when(failed, "failed").otherwise("done"), "attempts": F.col("attempts") + F.when(failed, 1).otherwise(0), "last_error": F.col("__error")}
    closed = outbox.where(~F.coalesce(F.col("status").isin("pending", "failed"), F.lit(False)))
    return closed.unionByName(x.withColumns(own).select(*outbox.columns))


def _coded(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("__code", F.xxhash64(*key))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """__code: the hashes of keys that several rows have; some that two keys share may be among them."""
    return _coded(rows, key).groupBy("__code").count().where("count > 1").select("__code")


@dataclass
class Synced:
    outbox: DataFrame
    chunks: DataFrame
    concepts: DataFrame
    states: DataFrame
    counts: DataFrame  # succeeded, failed


def sync(outbox: DataFrame, chunks: DataFrame, concepts: DataFrame, states: DataFrame, limit: int | None = 100, run_id: str | None = None, kept: Callable[[DataFrame], DataFrame] | None = None) -> Synced:
    """All tables after the next events (all open ones without a limit).

    chunks: record_id and any of document_ref, search_text, embedding; concepts: record_id and any of canonical_label,
    normalized_label, search_text, embedding, usage_count, index_version. An upsert whose state's identity is known
    with another record or document fails, as its state cannot be marked, but its index keeps the record. A delete
    takes away the record's states of its document (a concept's has none) and index version, where it names one.

    With ``kept`` (which writes rows and reads them back) and without a limit, events are read where they lie, and their
    payloads are not written again: what is joined to them is the exceptions alone (events that are refused or followed
    by another of their record or identity), which are few as a rule and are then broadcast by their size. Event ids are unique.
    """
    missing = {n: F.lit(None).cast("string") for n in ("source_version", "index_version") if n not in outbox.columns}
    opened = state.next_batch(outbox, limit, run_id).withColumns(missing)
    batch, narrow = decoded(opened), kept is not None and limit is None
    if narrow:  # decoded and checked here for what decides, and read once more where the index is written
        batch = kept(batch.select("event_id", "collection", "operation", "record_id", "document_ref", "index_version", "error", _mark().alias("mark")))
    known = states.select(*IDENTITY, F.struct("record_id", "document_ref").alias("known"))
    marked = batch.where("mark IS NOT NULL").select("event_id", "mark.*") if narrow else marks(batch)
    taken = marked.join(known, IDENTITY).where(~F.col("known").eqNullSafe(F.struct("record_id", "document_ref"))).select("event_id", F.lit(TAKEN).alias("taken"))
    if narrow:
        taken, wrong = kept(taken), kept(batch.where("error IS NOT NULL").select("event_id", F.col("error").alias("__error")))
    outcomes = batch.join(taken, "event_id", "left").select("event_id", F.coalesce("error", "taken").alias("error"))
    outcomes = outcomes.select("event_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("outcome"), "error")
    counts = outcomes.agg(F.count_if(F.col("outcome") == "done").alias("succeeded"), F.count_if(F.col("outcome") == "failed").alias("failed"))

    def index(table: DataFrame, collection: str, name: str, kind: str) -> DataFrame:
        record = F.col(name)
        good = batch.where(F.col("error").isNull() & (F.col("collection") == collection))
        fields = [record[n].alias(n) for n in table.columns if n != "record_id"]
        if narrow:
            codes = kept(_repeated(good, ["record_id"]))
            whole = opened.where((F.col("collection") == collection) & (F.col("operation") == "upsert")).join(wrong.select("event_id"), "event_id", "left_anti")
            if not codes.isEmpty():
                some = _coded(good.select("record_id", "event_id"), ["record_id"]).join(codes, "__code", "left_semi")
                last = some.groupBy("record_id").agg(F.max("event_id").alias("last"))
                followed = kept(some.join(last, "record_id").where("event_id < last").select("event_id"))
                whole = whole.join(followed, "event_id", "left_anti")
            rows = whole.select("record_id", F.from_json("payload", kind)["record"].alias(name)).select("record_id", *fields).select(*table.columns)
            return table.join(good.select("record_id"), "record_id", "left_anti").unionByName(rows)
        return state.drained(table, good.select("event_id", "operation", "record_id", *fields), ["record_id"], ["event_id"])

    # The last mark of an identity stands, unless a later delete takes it away.
    fresh = marked.join(taken, "event_id", "left_anti")
    every = states.select(*STATE).withColumn("event_id", F.lit("")).unionByName(fresh.select(*STATE, "event_id"))
    if narrow:  # marks that are alone are the last ones of their identity
        codes, rest = kept(_repeated(every, IDENTITY)), every
        if not codes.isEmpty():
            coded = _coded(every, IDENTITY)
            several = coded.join(codes, "__code", "left_semi").drop("__code")
            rest = coded.join(codes, "__code", "left_anti").drop("__code").unionByName(state.latest_per(several, IDENTITY, ["event_id"]))
        last = rest
    else:
        last = state.latest_per(every, IDENTITY, ["event_id"])
    gone = batch.where("error IS NULL AND operation = 'delete'").select(
        F.col("collection").alias("__c"), F.col("record_id").alias("__r"), F.when(F.col("collection") == CHUNKS, F.col("document_ref")).alias("__d"), F.col("index_version").alias("__v"), F.col("event_id").alias("__e")
    )
    gone = gone.groupBy("__c", "__r", "__d", "__v").agg(F.max("__e").alias("__e"))
    if narrow:
        gone = kept(gone)
    hit = (F.col("collection") == F.col("__c")) & (F.col("record_id") == F.col("__r")) & (F.col("__e") > F.col("event_id")) & (F.col("__d").isNull() | F.col("__d").eqNullSafe(F.col("document_ref"))) & (F.col("__v").isNull() | (F.col("__v") == F.col("index_version")))
    after = last.join(gone, hit, "left_anti").select(*STATE)
    if narrow and run_id is None and not missing:
        after_events = _transitioned(outbox, opened, kept(wrong.unionByName(taken.select("event_id", F.col("taken").alias("__error")))))
    else:
        after_events = state.transitioned(outbox, outcomes)
    return Synced(after_events, index(chunks, CHUNKS, "record", RECORD), index(concepts, CONCEPTS, "concept", CONCEPT), after, counts)
