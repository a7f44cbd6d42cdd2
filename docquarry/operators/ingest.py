"""Ingest: vector states, outbox events and their effects, reservations, runs, tag resolution, chunk parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docquarry.functions import text as T
from docquarry.functions.ids import chunk_id, vector_event_id
from docquarry.operators import concepts, evidence, state
from docquarry.operators.outbox import INVALID, MISMATCH, STATE, UNSUPPORTED, decoded, sync  # noqa: F401

# What a state is known by, the order of stale states, and the ends of a run.
IDENTITY = ["entity_type", "entity_key", "collection", "index_version"]
STALE_ORDER = ["entity_type", "collection", "index_version", "record_id", "entity_key"]
TERMINAL = ("run_completed", "run_failed")


# ---- vector states


def chunk_states(records: DataFrame, index_version: str) -> tuple[DataFrame, DataFrame]:
    """Desired states of chunk records (chunk_id, document_ref, source_version, search_text, embedding_profile,
    dimensions), and what forbids them: chunk ids given twice, documents of several versions (key, rule)."""
    states = records.select(
        F.lit("chunk").alias("entity_type"), F.col("chunk_id").alias("entity_key"), F.lit("document_chunks").alias("collection"), F.col("chunk_id").alias("record_id"), F.sha2("search_text", 256).alias("input_hash"),
        F.col("embedding_profile").alias("model"), "dimensions", F.lit(index_version.strip()).alias("index_version"), "document_ref", "source_version",
    )
    twice = records.groupBy("chunk_id").count().where("count > 1").select(F.col("chunk_id").alias("key"), F.lit("repeated chunk").alias("rule"))
    versions = records.groupBy("document_ref").agg(F.min("source_version").alias("a"), F.max("source_version").alias("b")).where("a != b").select(F.col("document_ref").alias("key"), F.lit("several versions").alias("rule"))
    return states, twice.unionByName(versions)


def concept_states(records: DataFrame, index_version: str) -> tuple[DataFrame, DataFrame]:
    """Desired states of concept records (normalized_label, record_id, input_hash, model, dimensions,
    index_version), of no document, and what forbids them: labels given twice, records of another version."""
    null = F.lit(None).cast("string")
    states = records.select(
        F.lit("concept").alias("entity_type"), F.col("normalized_label").alias("entity_key"), F.lit("concept_catalog").alias("collection"), "record_id", "input_hash", "model", "dimensions", F.lit(index_version.strip()).alias("index_version"),
        null.alias("document_ref"), null.alias("source_version"),
    )
    twice = records.groupBy("normalized_label").count().where("count > 1").select(F.col("normalized_label").alias("key"), F.lit("repeated label").alias("rule"))
    other = records.where(F.col("index_version") != index_version.strip()).select(F.col("normalized_label").alias("key"), F.lit("other index version").alias("rule"))
    return states, twice.unionByName(other)


def mark_synced(states: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states after ``done`` were synced, and those refused: their identity is known with another record or
    document, or given twice with different contents. Both have the same columns."""
    done = done.dropDuplicates()
    twice = done.groupBy(*IDENTITY).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    known = states.select(*IDENTITY, F.struct("record_id", "document_ref").alias("known"))
    met = done.join(known, IDENTITY, "left").join(twice.withColumn("twice", F.lit(True)), IDENTITY, "left")
    met = met.withColumn("ok", F.col("twice").isNull() & (F.col("known").isNull() | F.col("known").eqNullSafe(F.struct("record_id", "document_ref"))))
    good = met.where("ok").select(*done.columns).withColumn("sync_status", F.lit("synced"))
    return state.upserted(states, good.select(*states.columns), IDENTITY), met.where("NOT ok").select(*done.columns)


def synced(states: DataFrame, entity_type: str, collection: str, index_version: str, document_ref: str | None = None) -> DataFrame:
    """Synced states of a collection (and document), by entity_key."""
    some = states.where((F.col("sync_status") == "synced") & (F.col("entity_type") == entity_type) & (F.col("collection") == collection) & (F.col("index_version") == index_version))
    return (some if document_ref is None else some.where(F.col("document_ref") == document_ref)).orderBy("entity_key")


def relations_of(relations: DataFrame, document_ref: str, source_version: str | None = None) -> DataFrame:
    """A document's relations by paragraph, concept and role."""
    own = relations.where(F.col("document_ref") == document_ref)
    own = own if source_version is None else own.where(F.col("source_version") == source_version)
    return own.select("paragraph_id", "concept", "role").orderBy("paragraph_id", "concept", "role")


def chunk_ids_of(index: DataFrame, document_ref: str) -> DataFrame:
    return index.where(F.col("document_ref") == document_ref).select("chunk_id")


# ---- outbox


def sync_pending(outbox: DataFrame, index: DataFrame, limit: int, run_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outbox, the chunk index (record_id, document_ref, search_text, embedding) and the counts after the next
    events, where neither concepts nor states are kept. See ``outbox.sync``."""
    spark = outbox.sparkSession
    states = spark.createDataFrame([], ", ".join(f"{n} {'int' if n == 'dimensions' else 'string'}" for n in STATE))
    done = sync(outbox, index, spark.createDataFrame([], "record_id string"), states, limit, run_id)
    return done.outbox, done.chunks, done.counts


def merged_events(provided: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (chunk_id, pos, event_id) of both lists with their place in the chunk, the provided ones first, and
    the event ids that occur twice (an error)."""
    both = provided.select("chunk_id", "pos", "event_id", F.lit(0).alias("list")).unionByName(generated.select("chunk_id", "pos", "event_id", F.lit(1).alias("list")))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("list", "pos")))
    return placed.select("chunk_id", "place", "event_id"), both.groupBy("event_id").count().where("count > 1").select("event_id")


def concept_upserts(records: DataFrame, catalog_ref: str, catalog_version: str, run_id: str | None = None) -> DataFrame:
    """An upsert event for each concept record (record_id, normalized_label, search_text, input_hash,
    index_version, embedding); its id depends on the catalog and all of the record."""
    fields = {"catalog_ref": F.lit(catalog_ref.strip()), "catalog_version": F.lit(catalog_version.strip()), "collection": F.lit("concept_catalog"), "index_version": F.col("index_version"), "operation": F.lit("upsert"), "run_id": F.lit(run_id).cast("string")}
    record = F.struct("index_version", "input_hash", "normalized_label", "record_id", "search_text").alias("record")
    identity = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], record), {"ignoreNullFields": "false"})
    return records.select(
        vector_event_id(F.lit("concept-upsert-"), identity, F.col("embedding")).alias("event_id"), fields["catalog_ref"].alias("document_ref"), fields["catalog_version"].alias("source_version"), fields["collection"].alias("collection"),
        "record_id", F.lit("upsert").alias("operation"), F.to_json(record).alias("payload"), "index_version",
    )


# ---- reservations and runs


def closed(ledger: DataFrame, claims: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ledger (key, status, token, result) after claims (key, token, outcome: ready or failed, result), and
    the claims refused: only who holds a processing row's token may close it."""
    c = claims.select(*key, F.col("token").alias("by"), "outcome", F.col("result").alias("given"))
    x = ledger.join(c, key, "left").withColumn("owned", F.coalesce((F.col("status") == "processing") & (F.col("token") == F.col("by")), F.lit(False)))
    none = F.lit(None).cast("string")
    after = x.select(*key, F.when(F.col("owned"), F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(F.col("owned"), none).otherwise(F.col("token")).alias("token"), F.when(F.col("owned") & (F.col("outcome") == "ready"), F.col("given")).otherwise(F.col("result")).alias("result"))
    return after, claims.join(x.where("owned").select(*key), key, "left_anti")


def reopened(runs: DataFrame, log: DataFrame, run: str = "run_id") -> DataFrame:
    """runs with outcome: unknown, active (its last event ends nothing), or reopened."""
    last = log.groupBy(run).agg(F.max_by("type", "sequence").alias("last"))
    return runs.join(last, run, "left").select(run, F.when(F.col("last").isNull(), "unknown").when(F.col("last").isin(*TERMINAL), "reopened").otherwise("active").alias("outcome"))


def timed_calls(calls: DataFrame, timeout: float, seconds: str = "seconds") -> DataFrame:
    """Calls with status (done, or timed_out) and the seconds that count against the budget."""
    late = F.col(seconds) > timeout
    return calls.withColumns({"status": F.when(late, "timed_out").otherwise("done"), "charged": F.when(late, F.lit(float(timeout))).otherwise(F.col(seconds))})


def limited_hits(hits: DataFrame, scope: list[str], most: int) -> DataFrame:
    """The first hits of each call by rank."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy("rank"))
    return hits.withColumn("place", n).where(F.col("place") <= most).drop("place")


# ---- tags


def resolution_violations(generated: DataFrame, resolutions: DataFrame, existing: DataFrame) -> DataFrame:
    """paragraph_id, tag, rule. generated: paragraph_id, pos, tag; resolutions: paragraph_id, pos, generated_tag,
    resolved_tag, action; existing: paragraph_id, tag (the candidates)."""
    r = resolutions.select("paragraph_id", F.trim("generated_tag").alias("tag"), F.trim("resolved_tag").alias("resolved"), "action", F.col("pos").alias("at"))
    known = existing.select("paragraph_id", F.trim("tag").alias("resolved")).distinct()
    g = generated.select("paragraph_id", F.trim("tag").alias("tag"), "pos")

    def found(df: DataFrame, rule: str) -> DataFrame:
        return df.select("paragraph_id", "tag", F.lit(rule).alias("rule"))

    rules = [
        found(r.where(~F.col("action").isin("reuse_existing", "keep_new")), "unknown action"),
        found(r.where(F.col("action") == "reuse_existing").join(known, ["paragraph_id", "resolved"], "left_anti"), "reuse without candidate"),
        found(r.groupBy("paragraph_id", "tag").count().where("count > 1"), "resolved twice"),
        found(g.join(r, ["paragraph_id", "tag"], "left_anti"), "not resolved"),
        found(r.join(g, ["paragraph_id", "tag"], "left_anti"), "not generated"),
        found(r.join(g, ["paragraph_id", "tag"]).where("at != pos"), "out of order"),
    ]
    out = rules[0]
    for x in rules[1:]:
        out = out.unionByName(x)
    return out


def resolved_tags(paras: DataFrame, generated: DataFrame, resolutions: DataFrame) -> DataFrame:
    """paras (paragraph_id …) with generated_tags and tags, in order, and status completed."""
    r = resolutions.select("paragraph_id", F.trim("generated_tag").alias("tag"), F.trim("resolved_tag").alias("resolved"))
    both = generated.select("paragraph_id", "pos", F.trim("tag").alias("tag")).join(r, ["paragraph_id", "tag"])
    per = both.groupBy("paragraph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "resolved"))).alias("l"))
    return paras.join(per, "paragraph_id").select(*paras.columns, F.transform("l", lambda x: x["tag"]).alias("generated_tags"), F.transform("l", lambda x: x["resolved"]).alias("tags"), F.lit("completed").alias("status"))


def persisted(table: DataFrame, catalog: DataFrame, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paragraph table and the tag catalog (tag) after ``tagged`` paragraphs were added."""
    more = tagged.select(F.explode("tags").alias("tag")).distinct()
    return state.upserted(table, tagged.select(*table.columns), ["paragraph_id"]), catalog.select("tag").union(more).distinct()


# ---- sources and chunk parts


def is_raw_raster(space: Column) -> Column:
    """Coordinates (name, transform_to_source) are pixels of the page as it was rastered."""
    return F.coalesce((space["name"] == "raw_pdf_raster_pixels") & (space["transform_to_source"] == "identity"), F.lit(False))


def source_violations(sources: DataFrame, found: DataFrame) -> DataFrame:
    """path, rule: sources (path, kind, media_type, size, sha256) that are no PDF source or whose bytes (found:
    path, length, sha256) differ."""
    f = found.select("path", "length", F.col("sha256").alias("own"))
    rule = (
        F.when(F.col("kind") != "source_pdf", "kind").when(F.col("media_type") != "application/pdf", "media type").when(F.col("own").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("own") != F.col("sha256"), "checksum")
    )
    return sources.join(f, "path", "left").select("path", rule.alias("rule")).where("rule IS NOT NULL")


def part_chunks(parts: DataFrame, access_scope: str = "public") -> DataFrame:
    """Source chunks of parts (document_ref, source_version, index, header, content, part, parts; null where a
    section is whole): the header names the part, the id does not depend on it."""
    shown = F.when(F.col("parts").isNotNull(), F.format_string("%s (Part %d of %d)", "header", "part", "parts")).otherwise(F.col("header"))
    return parts.select(
        chunk_id(F.col("document_ref"), F.col("source_version"), F.col("index"), F.col("header"), F.col("content")).alias("chunk_id"), "document_ref", "source_version",
        F.concat(F.lit("## "), shown, F.lit("\n\n"), F.col("content")).alias("search_text"), F.lit(access_scope).alias("access_scope"), shown.alias("heading"), F.when(F.col("parts").isNotNull(), F.col("header")).alias("source_heading"), "part", "parts",
    )


def token_slices(tokenizer_file: str, target: int):
    """A function of (header, block) columns: the block in slices of as many tokens as ``target`` leaves beside the
    header. The tokenizer's file is the caller's."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_file)  # once a task
        ids = lambda t: model.encode_batch_fast([t], add_special_tokens=False)[0].ids
        budgets: dict[str, int] = {}

        def one(h: str, b: str) -> list[str]:
            if h not in budgets:
                if len(budgets) >= 10_000:
                    budgets.clear()
                budgets[h] = target - len(ids(f"## {h}\n\n"))
            if (budget := budgets[h]) < 1:
                raise ValueError("chunk header leaves no token budget")
            own = ids(b)
            return [model.decode(own[i : i + budget], skip_special_tokens=False).strip() for i in range(0, len(own), budget)]

        for header, block in batches:
            yield pd.Series([one(h, b) for h, b in zip(header, block, strict=True)])

    return cut


# ---- questions


def concept_roles(selected: DataFrame, facts: DataFrame, hits: DataFrame, scope: str = "query_id") -> DataFrame:
    """scope, paragraph_id, chunk_id: the paragraphs of the selected (scope, concept, role), among relations of the
    scope's hit chunks (hits: scope, chunk_id, rank); facts: paragraph_id, chunk_id, concept, role."""
    s = T.with_key(selected, "concept", "key").select(scope, "key", "role").distinct()
    f = T.with_key(facts, "concept", "key").select("key", "role", "chunk_id", "paragraph_id").distinct()
    return hits.select(scope, "chunk_id").distinct().join(f, "chunk_id").join(s, [scope, "key", "role"]).select(scope, "paragraph_id", "chunk_id").distinct()


def question_bundles(questions: DataFrame, hits: DataFrame, facts: DataFrame, selected: DataFrame, paras: DataFrame, paragraphs: int, words: int, scope: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """scope, status (no_retrieval_context, no_relevant_concept_role, ready) of each question, and the bounded
    context of those that are ready: paragraphs (paras: paragraph_id, chunk_id, ordinal, text) of the selected
    concepts and roles, in order of their chunks' ranks."""
    met = concept_roles(selected, facts, hits, scope)
    rows = met.join(hits.groupBy(scope, "chunk_id").agg(F.min("rank").alias("rank")), [scope, "chunk_id"]).join(paras.select("paragraph_id", "ordinal", "text"), "paragraph_id")
    context = evidence.limited(rows, [scope], ["rank", "ordinal", "paragraph_id"], paragraphs, words)
    found, some = hits.select(scope).distinct().withColumn("hit", F.lit(True)), met.select(scope).distinct().withColumn("some", F.lit(True))
    status = F.when(F.col("hit").isNull(), "no_retrieval_context").when(F.col("some").isNull(), "no_relevant_concept_role").otherwise("ready")
    return questions.select(scope).join(found, scope, "left").join(some, scope, "left").select(scope, status.alias("status")), context


def role_inventory(facts: DataFrame, hits: DataFrame, scope: str = "query_id") -> DataFrame:
    """The concepts and roles that a question's hit chunks offer (see ``concepts.inventory``)."""
    rows = facts.join(hits.select(scope, "chunk_id", F.col("rank").alias("chunk_rank")), "chunk_id")
    return concepts.inventory(rows, [scope])
