"""Ingest operators on small cases whose outcomes are stated."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docquarry.operators import ingest, outbox, segment
from docquarry.session import new_path
from docquarry.sources.store import BUCKETS, Store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_states_are_marked_but_never_taken_over(spark):
    schema = "entity_type string, entity_key string, collection string, record_id string, index_version string, document_ref string, input_hash string, sync_status string"
    old = spark.createDataFrame([("chunk", "a", "c", "ra", "v1", "d1", "h", "pending"), ("concept", "x", "k", "rx", "v1", None, "h", "synced")], schema)
    done = spark.createDataFrame([("chunk", "a", "c", "ra", "v1", "d2", "h2", ""), ("concept", "x", "k", "rx", "v1", None, "h2", ""), ("chunk", "n", "c", "rn", "v1", "d1", "h3", "")], schema)
    after, refused = ingest.mark_synced(old, done)
    assert rows(after, "entity_key", "input_hash", "sync_status") == [("a", "h", "pending"), ("n", "h3", "synced"), ("x", "h2", "synced")]
    assert rows(refused, "entity_key") == [("a",)]
    assert [r.entity_key for r in ingest.synced(after, "chunk", "c", "v1", "d1").collect()] == ["n"]
    assert ingest.mark_synced(old.limit(0), done.limit(0))[0].count() == 0


def payload(**changes):
    record = {"chunk_id": "c1", "document_ref": "d1", "source_version": "s", "search_text": "t", "embedding": [1.0, 2.0], "embedding_profile": "m", "access_scope": "public", "metadata": {}}
    return json.dumps({"record": {k: v for k, v in (record | changes).items() if v is not None}})


def test_an_event_that_fails_stops_no_other(spark):
    given = [
        ("e1", "document_chunks", "upsert", payload()), ("e2", "document_chunks", "upsert", payload(chunk_id="c2")), ("e3", "document_chunks", "upsert", "{"), ("e4", "document_chunks", "upsert", payload(embedding=None)),
        ("e5", "pictures", "upsert", payload()), ("e6", "document_chunks", "delete", "{}"), ("e7", "document_chunks", "upsert", payload(search_text="last")), ("e8", "document_chunks", "upsert", payload(document_ref="other")),
    ]
    outbox = spark.createDataFrame([(e, "run", c, o, "c1", "d1", p, "pending", 0, None) for e, c, o, p in given], "event_id string, run_id string, collection string, operation string, record_id string, document_ref string, payload string, status string, attempts int, last_error string")
    index = spark.createDataFrame([("c1", "d1", "old", [0.0]), ("c9", "d1", "stays", [0.0])], "record_id string, document_ref string, search_text string, embedding array<double>")
    after, found, counts = ingest.sync_pending(outbox, index, 100)
    assert rows(after.where("status = 'failed'"), "event_id", "last_error", "attempts") == [("e2", ingest.MISMATCH, 1), ("e3", ingest.INVALID, 1), ("e4", ingest.INVALID, 1), ("e5", ingest.UNSUPPORTED, 1), ("e8", ingest.MISMATCH, 1)]
    assert rows(found, "record_id", "search_text") == [("c1", "last"), ("c9", "stays")] and tuple(counts.first()) == (3, 5)
    again, _, counts = ingest.sync_pending(after, found, 2, "run")
    assert tuple(counts.first()) == (0, 2) and rows(again.where("attempts = 2"), "event_id") == [("e2",), ("e3",)]
    assert tuple(ingest.sync_pending(outbox.limit(0), index, 5)[2].first()) == (0, 0)


def concept(**changes):
    record = {"record_id": CONCEPT_ID, "canonical_label": "Jazz", "normalized_label": "jazz", "search_text": "t", "embedding": [1.0, 2.0], "usage_count": 3, "embedding_input_hash": "a" * 64, "embedding_model": "m", "embedding_dimensions": 2, "index_version": "v1", "metadata": {}}
    return json.dumps({"record": {k: v for k, v in (record | changes).items() if v is not None}})


CONCEPT_ID = "concept::" + hashlib.sha256(b"jazz").hexdigest()


def test_concept_events_touch_the_concept_index_alone(spark):
    bad = [concept(usage_count=-1), concept(usage_count=True), concept(embedding=[]), concept(embedding_dimensions=3), concept(embedding_input_hash="x"), concept(metadata=None), concept(canonical_label=" "), concept(normalized_label="other"), concept(embedding=["x"]), "not json", "[]"]
    given = [("e00", "concept_catalog", "upsert", CONCEPT_ID, concept()), ("e01", "concept_catalog", "upsert", "concept::else", concept()), ("e02", "concept_catalog", "delete", "c9", "{}"), ("e03", "document_chunks", "upsert", "c1", payload())]
    given += [(f"f{i:02}", "concept_catalog", "upsert", CONCEPT_ID, p) for i, p in enumerate(bad)]
    outbox_ = spark.createDataFrame([(e, "run", c, o, r, "d1", "s", "v1", p, "pending", 0, None) for e, c, o, r, p in given], "event_id string, run_id string, collection string, operation string, record_id string, document_ref string, source_version string, index_version string, payload string, status string, attempts int, last_error string")
    chunks = spark.createDataFrame([("c9", "stays")], "record_id string, search_text string")
    concepts = spark.createDataFrame([("c9", "goes", 1)], "record_id string, search_text string, usage_count long")
    states = spark.createDataFrame([("concept", "old", "concept_catalog", "c9", "h", "m", 2, "v1", "synced", None, "s"), ("chunk", "c9", "document_chunks", "c9", "h", "m", 2, "v1", "synced", "d1", "s")], ", ".join(f"{n} {'int' if n == 'dimensions' else 'string'}" for n in outbox.STATE))
    done = outbox.sync(outbox_, chunks, concepts, states)
    assert rows(done.chunks, "record_id", "search_text") == [("c1", "t"), ("c9", "stays")]
    assert rows(done.concepts, "record_id", "search_text", "usage_count") == [(CONCEPT_ID, "t", 3)]
    assert rows(done.states, "entity_type", "entity_key", "document_ref", "input_hash") == sorted([("chunk", "c1", "d1", hashlib.sha256(b"t").hexdigest()), ("chunk", "c9", "d1", "h"), ("concept", "jazz", None, "a" * 64)], key=str)
    assert {r.last_error for r in done.outbox.where("event_id LIKE 'f%'").collect()} == {outbox.INVALID_CONCEPT} and rows(done.outbox.where("event_id = 'e01'"), "last_error") == [(outbox.MISMATCH,)]
    assert tuple(done.counts.first()) == (3, 1 + len(bad))


def test_the_last_of_a_record_decides_and_taken_states_fail(spark):
    given = [("e1", "upsert", "c1", payload()), ("e2", "delete", "c1", ""), ("e3", "upsert", "c2", payload(chunk_id="c2")), ("e4", "upsert", "c1", payload(search_text="again")), ("e5", "delete", "c3", ""), ("e6", "upsert", "c4", payload(chunk_id="c4"))]
    outbox_ = spark.createDataFrame([(e, "run", "document_chunks", o, r, "d1", "s", "v1", p, "pending", 0, None) for e, o, r, p in given], "event_id string, run_id string, collection string, operation string, record_id string, document_ref string, source_version string, index_version string, payload string, status string, attempts int, last_error string")
    known = [("c3", "d1", "v1"), ("c3", "d1", "v2"), ("c4", "elsewhere", "v1")]
    states = spark.createDataFrame([("chunk", k if v == "v1" else k + v, "document_chunks", k, "h", "m", 2, v, "synced", d, "s") for k, d, v in known], ", ".join(f"{n} {'int' if n == 'dimensions' else 'string'}" for n in outbox.STATE))
    done = outbox.sync(outbox_, spark.createDataFrame([], "record_id string, search_text string"), spark.createDataFrame([], "record_id string"), states, None)
    assert rows(done.chunks, "record_id", "search_text") == [("c1", "again"), ("c2", "t"), ("c4", "t")]
    assert rows(done.states, "entity_key", "document_ref", "index_version") == [("c1", "d1", "v1"), ("c2", "d1", "v1"), ("c3v2", "d1", "v2"), ("c4", "elsewhere", "v1")]
    assert rows(done.outbox.where("status = 'failed'"), "event_id", "last_error") == [("e6", outbox.TAKEN)]


def test_only_the_owner_closes_a_reservation(spark):
    ledger = spark.createDataFrame([("a", "processing", "t1", None), ("b", "processing", "t2", None), ("c", "ready", None, "done"), ("d", "processing", "t4", None)], "k string, status string, token string, result string")
    claims = spark.createDataFrame([("a", "t1", "ready", "r"), ("b", "other", "ready", "r"), ("c", "t3", "failed", "r"), ("d", "t4", "failed", "r"), ("z", "t", "ready", "r")], "k string, token string, outcome string, result string")
    after, refused = ingest.closed(ledger, claims, ["k"])
    assert rows(after, "k", "status", "token", "result") == [("a", "ready", None, "r"), ("b", "processing", "t2", None), ("c", "ready", None, "done"), ("d", "failed", None, None)]
    assert rows(refused, "k") == [("b",), ("c",), ("z",)]


def test_tag_resolutions(spark):
    generated = spark.createDataFrame([("p", 0, "Tonic "), ("p", 1, "Scale"), ("q", 0, "Beat")], "paragraph_id string, pos int, tag string")
    resolutions = spark.createDataFrame([("p", 0, "Tonic", "Key", "reuse_existing"), ("p", 1, " Scale", "Scale", "keep_new"), ("q", 0, "Beat", "Pulse", "reuse_existing"), ("q", 1, "New", "New", "invent")], "paragraph_id string, pos int, generated_tag string, resolved_tag string, action string")
    existing = spark.createDataFrame([("p", "Key ")], "paragraph_id string, tag string")
    assert rows(ingest.resolution_violations(generated, resolutions, existing), "paragraph_id", "tag", "rule") == [("q", "Beat", "reuse without candidate"), ("q", "New", "not generated"), ("q", "New", "unknown action")]
    paras = spark.createDataFrame([("p", "text")], "paragraph_id string, text string")
    tagged = ingest.resolved_tags(paras, generated, resolutions)
    assert rows(tagged, "paragraph_id", "generated_tags", "tags", "status") == [("p", ["Tonic", "Scale"], ["Key", "Scale"], "completed")]
    table, catalog = ingest.persisted(tagged.select("paragraph_id", "tags").limit(0), spark.createDataFrame([("Key",)], "tag string"), tagged)
    assert rows(table, "paragraph_id") == [("p",)] and rows(catalog, "tag") == [("Key",), ("Scale",)]


def test_question_bundles(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (2, "c1", 1)], "query_id int, chunk_id string, rank int")
    facts = spark.createDataFrame([("p1", "c1", "Harmony", "Definition"), ("p2", "c2", "harmony", "Definition"), ("p3", "c9", "Harmony", "Definition")], "paragraph_id string, chunk_id string, concept string, role string")
    selected = spark.createDataFrame([(1, " HARMONY ", "Definition"), (2, "Harmony", "Example")], "query_id int, concept string, role string")
    paras = spark.createDataFrame([(f"p{i}", 0, "one two") for i in (1, 2, 3)], "paragraph_id string, ordinal int, text string")
    status, context = ingest.question_bundles(q, hits, facts, selected, paras, 5, 3)
    assert rows(status, "query_id", "status") == [(1, "ready"), (2, "no_relevant_concept_role"), (3, "no_retrieval_context")]
    assert rows(context, "query_id", "paragraph_id") == [(1, "p1")]


def test_chunk_parts_and_token_slices(spark):
    parts = spark.createDataFrame([("d", "s", 0, "H", "text", 1, 2), ("d", "s", 1, "H", "text", None, None)], "document_ref string, source_version string, index int, header string, content string, part int, parts int")
    got = ingest.part_chunks(parts).orderBy("chunk_id").collect()
    assert [(r.heading, r.search_text, r.source_heading) for r in got] == [("H (Part 1 of 2)", "## H (Part 1 of 2)\n\ntext", "H"), ("H", "## H\n\ntext", None)]
    assert got[0].chunk_id.split(":")[-1] == got[1].chunk_id.split(":")[-1]
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = tokenizers.path("byte_bpe_50k.json")
    text = "Several words, and some more of them. " * 30
    cut = ingest.token_slices(file, 50)
    slices = spark.createDataFrame([("H", text), ("H", "")], "h string, t string").select(cut("h", "t").alias("s")).collect()
    size = lambda t: len(Tokenizer.from_file(file).encode(t, add_special_tokens=False).ids)
    assert "".join(slices[0].s).replace(" ", "") == text.replace(" ", "") and slices[1].s == []
    assert all(size(f"## H\n\n{x}") <= 51 for x in slices[0].s) and len(slices[0].s) > 3


def test_upserts_touch_their_buckets_only(spark):
    store = Store(spark, new_path(spark, "bucket-test"))
    store.upsert("t", spark.range(2000).select("id", F.lit("old").alias("v")), ["id"])
    before = store.manifest()["tables"]["t"]["parts"]
    assert len(before) == BUCKETS
    store.upsert("t", spark.createDataFrame([(5, "new"), (7, "new")], "id int, v string"), ["id"])  # an int key meets its long bucket
    after = store.manifest()["tables"]["t"]["parts"]
    assert 1 <= sum(before[b] != after[b] for b in after) <= 2
    assert store.read("t").count() == 2000 and store.read("t").where("v = 'new'").count() == 2
    store.delete("t", spark.createDataFrame([(5,)], "id int"), ["id"])
    store.commit({"u": spark.range(3)})
    store.upsert("u", spark.range(2, 5), ["id"])
    assert store.read("t").count() == 1999 and rows(store.read("u"), "id") == [(0,), (1,), (2,), (3,), (4,)]
    store.vacuum()
    assert store.read("t").count() == 1999 and store.read("u").count() == 5


def test_paths_of_headings(spark):
    text = "### C\n\na\n\n## B\n\nb\n\n# A\n\nc\n\n## D\n\n" + "\n\n".join(f"p{i}" for i in range(300))
    got = segment.paragraphs(spark.createDataFrame([(1, text)], "id int, search_text string"), ["id"]).orderBy("ordinal").collect()
    assert [r.heading_path for r in got[:4]] == [["C"], ["C", "B"], ["A"], ["A", "D"]] and got[-1].heading_path == ["A", "D"] and len(got) == 303
