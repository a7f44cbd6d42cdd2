"""Ingest that writes what changed: chunks in batches with checkpoints and events, then catalog and stale rows.

Every commit holds all tables of its step, so a run that ends early leaves whole batches; started again, it finds their
chunks in the store and goes on with the rest. Chunks that are stored as they are cost nothing. Vectors travel in the
outbox and reach index and states by ``apply_pending``, which may fail and be run again without tagging anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import ports
from docquarry.functions.ids import joined_hash
from docquarry.operators import concepts, outbox
from docquarry.plans.flows import MADE, chunked, paragraphs_of
from docquarry.session import saved
from docquarry.sources.store import Store

CHUNK, DOCUMENT, LABEL, EVENT, RECORD = ["chunk_id"], ["document_ref"], ["normalized_label"], ["event_id"], ["record_id"]
_EVENT = "event_id string, run_id string, document_ref string, source_version string, collection string, record_id string, operation string, payload string, index_version string, status string, attempts int, last_error string"
_STATE = ", ".join(f"{n} {'int' if n == 'dimensions' else 'string'}" for n in outbox.STATE)


def _current(store: Store, name: str, schema) -> DataFrame:
    # Without a limit no plan would know that there are no rows.
    return store.read(name) if name in store.tables() else store.spark.createDataFrame([], schema).limit(0)


def _events(rows: DataFrame, store: Store, run_id: str, operation: str, payload: Column, index_version: str) -> DataFrame:
    """Events of chunks; their ids follow the order of commits."""
    number = F.lit(f"{store.manifest()['number'] + 1:012d}-{operation}-")
    null = F.lit(None).cast("string")
    return rows.select(
        F.concat(number, joined_hash(F.lit(run_id), F.col("chunk_id"))).alias("event_id"), F.lit(run_id).alias("run_id"), "document_ref", "source_version", F.lit(outbox.CHUNKS).alias("collection"), F.col("chunk_id").alias("record_id"), F.lit(operation).alias("operation"),
        payload.alias("payload"), F.lit(index_version).alias("index_version"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), null.alias("last_error"),
    )


def _payload(model: str, scope: str) -> Column:
    record = F.struct("chunk_id", "document_ref", "source_version", "search_text", "embedding", F.lit(model).alias("embedding_profile"), F.lit(scope).alias("access_scope"), F.create_map(F.lit("heading"), F.col("heading")).alias("metadata"))
    return F.to_json(F.struct(record.alias("record")))


def ingest(store: Store, documents: DataFrame, embedder: ports.Embedder, tagger: ports.Tagger | None, run_id: str, model: str = "profile-1", index_version: str = "v1", scope: str = "public", batches: int = 4, stop_after: int | None = None) -> dict[str, int]:
    """Bring the store's chunks, paragraphs, relations, observations, catalog and outbox up to date with ``documents``
    (document_ref, source_version, markdown); all chunks of the documents named that they no longer have go.

    Returns how many batches were committed and whether the run was completed; ``stop_after`` ends it early.
    """
    # What is stored is compared by digests; texts are joined only where some chunks are stored as they are.
    first, batch = "chunks" not in store.tables(), F.pmod(F.xxhash64("chunk_id"), F.lit(batches)).cast("int")
    if first:  # all are new, and are written once, where their batches' commits take them
        chunks, parts = store.staged_parts("chunks", chunked(documents), batch, batches, MADE)
    else:
        chunks = saved(chunked(documents).drop(*MADE), "chunks", codec="zstd").withColumns({c: F.expr(x) for c, x in MADE.items()})
    old, digest = _current(store, "chunks", chunks.schema), F.sha2("search_text", 256).alias("digest")
    stored = old.select("document_ref", "source_version", "chunk_id", "page_start", "page_end", digest)
    if not first:
        stored = saved(stored.join(documents.select("document_ref").distinct(), DOCUMENT, "left_semi"), "stored-chunks")
    known = not (first or stored.isEmpty())
    if not first and not known:
        parts = store.staged_parts("chunks", chunks, batch, batches, MADE)[1]
    if known:
        n, o = chunks.select("source_version", "chunk_id", "page_start", "page_end", digest).alias("n"), stored.alias("o")
        same = saved(n.join(o, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("chunk_id", "digest", "page_start", "page_end", "source_version")], "left_semi").select("chunk_id"), "same-chunks")
        parts = store.staged_parts("chunks", chunks if same.isEmpty() else chunks.join(same, CHUNK, "left_anti").select(*chunks.columns), batch, batches, MADE)[1]
    done = 0
    for part in parts:
        if part is None:
            continue
        if stop_after is not None and done >= stop_after:
            return {"batches": done, "completed": 0}
        # Only keys that are stored are named as taken away: a table without such keys is read without a join.
        keys = saved(part.select("chunk_id").join(stored.select("chunk_id"), CHUNK, "left_semi"), "taken-chunks") if known else None
        own = store.staged("paragraphs", paragraphs_of(part).drop("header"))
        labelled = ports.tag(own, "text", tagger) if tagger else own.withColumn("labels", F.expr("cast(array() as array<string>)"))
        relations = labelled.select("document_ref", "source_version", "chunk_id", "ordinal", "paragraph_id", "text", F.explode("labels").alias("concept")).withColumn("role", F.lit("mention"))
        events = _events(ports.embed(part, "search_text", embedder), store, run_id, "upsert", _payload(model, scope), index_version)
        marks = part.select(F.lit(run_id).alias("run_id"), "document_ref", "chunk_id")
        store.commit({}, layers={"chunks": (part, keys, CHUNK), "paragraphs": (own, keys, CHUNK), "relations": (relations, keys, CHUNK), "outbox": (events, None, EVENT), "checkpoints": (marks, None, CHUNK)})
        done += 1
    if stop_after is not None and done >= stop_after:
        return {"batches": done, "completed": 0}
    stale = saved(stored.join(chunks.select("chunk_id"), CHUNK, "left_anti"), "stale-chunks")
    keys = stale.select("chunk_id")
    marked = _current(store, "checkpoints", "run_id string, document_ref string, chunk_id string").where(F.col("run_id") == run_id)
    touched = saved(marked.select("document_ref").union(stale.select("document_ref")).distinct(), "touched-documents")
    if touched.isEmpty():
        return {"batches": done, "completed": 1}
    # The catalog takes the observations of these documents away and adds their new ones, label by label.
    kept = _current(store, "relations", "document_ref string, source_version string, chunk_id string, ordinal int, paragraph_id string, text string, concept string, role string").join(touched, DOCUMENT, "left_semi").join(keys, CHUNK, "left_anti")
    facts = kept.join(chunks.select("chunk_id", F.col("heading").alias("header")), "chunk_id").withColumnRenamed("text", "excerpt")
    observed = saved(concepts.document_catalog(facts, ["document_ref", "source_version"]), "observations")
    before = _current(store, "observations", observed.schema)
    labels = saved(before.join(touched, DOCUMENT, "left_semi").select("normalized_label").union(observed.select("normalized_label")).distinct(), "touched-labels")
    after = before.join(touched, DOCUMENT, "left_anti").unionByName(observed).join(labels, LABEL, "left_semi")
    catalog = concepts.global_catalog(after)
    layers = {"observations": (observed, touched, DOCUMENT), "catalog": (catalog, labels, LABEL)}
    if not stale.isEmpty():
        deletes = _events(stale, store, run_id, "delete", F.lit("{}"), index_version)
        layers |= {n: (store.read(n).limit(0), keys, CHUNK) for n in ("chunks", "paragraphs", "relations")} | {"outbox": (deletes, None, EVENT)}
    store.commit({}, layers=layers)
    return {"batches": done, "completed": 1}


def apply_pending(store: Store, run_id: str | None = None, limit: int | None = None) -> tuple[int, int]:
    """Apply open events to index and states, with the outbox, in one commit: how many succeeded and failed. Only the
    records that the events name are read into the step and written."""
    every = _current(store, "outbox", _EVENT)
    events = every.where("status IN ('pending', 'failed')")
    if run_id is not None:
        events = events.where(F.col("run_id") == run_id)
    if limit is not None:
        events = saved(events.orderBy("event_id").limit(limit), "open-events", codec="zstd")
    if events.isEmpty():
        return 0, 0
    index = _current(store, "index", "record_id string, document_ref string, search_text string, embedding array<double>")
    known, records = _current(store, "states", _STATE), None
    if {"index", "states"} & set(store.tables()):  # a first time nothing is stored that they could name
        records = saved(events.select("record_id").distinct(), "open-records")
        index, known = (x.join(records, RECORD, "left_semi") for x in (index, known))
    out = outbox.sync(events, index, store.spark.createDataFrame([], "record_id string"), known, None, kept=lambda rows: saved(rows, "sync", codec="zstd"))
    states, after = store.staged("states", out.states), store.staged("outbox", out.outbox)
    counts = after.agg(F.count_if(F.col("status") == "done").alias("succeeded"), F.count_if(F.col("status") != "done").alias("failed")).first()
    layers = {"outbox": (after, events.select("event_id"), EVENT), "index": (out.chunks, records, RECORD), "states": (states, records, RECORD)}
    # Where all events of the table were open, what they are now is the table.
    whole = [n for n in ("outbox",) if counts["succeeded"] + counts["failed"] == every.count()]
    store.commit({}, layers=layers, afresh=whole)
    return counts["succeeded"], counts["failed"]
