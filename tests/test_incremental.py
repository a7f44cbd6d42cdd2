"""Ingest that writes what changed."""

import pytest
from pyspark.sql import functions as F

from docquarry import ports
from docquarry.plans import flows, incremental
from docquarry.session import new_path
from docquarry.sources import store as store_module
from docquarry.sources.store import Store

WORDS = ["jazz", "blues", "swing"]


def markdown(spark, docs):
    return spark.createDataFrame([(f"d{k}", "s1", text) for k, text in docs.items()], "document_ref string, source_version string, markdown string")


def sections(*lines):
    return "\n\n".join(f"## S{i}\n\n{x}" for i, x in enumerate(lines))


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def same_as_whole(spark, store, docs):
    """All tables equal those of an ingest of the documents as they are now into an empty store."""
    whole = Store(spark, new_path(spark, "whole"))
    flows.ingest(whole, markdown(spark, docs), ports.FakeEmbedder(), ports.FakeTagger(WORDS))
    for name, columns in {"chunks": ["chunk_id", "heading", "content", "page_end"], "paragraphs": ["chunk_id", "paragraph_id", "ordinal", "text"], "relations": ["chunk_id", "paragraph_id", "concept"], "observations": ["document_ref", "normalized_label", "usage_count", "examples"], "catalog": ["normalized_label", "canonical_label", "usage_count", "examples", "first_seen"]}.items():
        assert rows(store.read(name), *columns) == rows(whole.read(name), *columns), name
    assert rows(store.read("index"), "record_id") == rows(whole.read("index"), "chunk_id")
    assert rows(store.read("states"), "entity_key", "input_hash") == rows(whole.read("states"), "entity_key", "input_hash")


def test_changes_leave_what_a_whole_ingest_leaves(spark):
    store, fake, tags = Store(spark, new_path(spark, "inc")), ports.FakeEmbedder(), ports.FakeTagger(WORDS)
    docs = {1: sections("jazz one", "blues"), 2: sections("Jazz two", "none", "swing"), 3: sections("blues three")}
    assert incremental.ingest(store, markdown(spark, docs), fake, tags, "r1") == {"batches": store.manifest()["number"] - 1, "completed": 1}
    assert incremental.apply_pending(store) == (6, 0) and incremental.apply_pending(store) == (0, 0)
    same_as_whole(spark, store, docs)
    number = store.manifest()["number"]
    assert incremental.ingest(store, markdown(spark, docs), fake, tags, "r2") == {"batches": 0, "completed": 1} and store.manifest()["number"] == number  # nothing changed
    docs |= {2: sections("Jazz two", "jazz again"), 3: ""}  # a section changed, one went, a document is empty now
    incremental.ingest(store, markdown(spark, {k: docs[k] for k in (2, 3)}), fake, tags, "r3")
    assert incremental.apply_pending(store, "r3") == (4, 0)
    same_as_whole(spark, store, docs)
    assert {r.normalized_label for r in store.read("catalog").collect()} == {"jazz", "blues"}


def test_a_stopped_run_goes_on_with_the_rest(spark):
    store, seen = Store(spark, new_path(spark, "inc-stop")), []
    docs = {i: sections(f"jazz {i}", f"blues {i}", f"text {i}") for i in range(10)}
    first = incremental.ingest(store, markdown(spark, docs), ports.FakeEmbedder(), ports.FakeTagger(WORDS), "r", stop_after=2)
    assert first == {"batches": 2, "completed": 0} and "catalog" not in store.tables()
    before = {r.chunk_id for r in store.read("checkpoints").collect()}
    assert before == {r.chunk_id for r in store.read("chunks").collect()} and len(before) == store.read("outbox").count() < 30
    assert incremental.ingest(store, markdown(spark, docs), ports.FakeEmbedder(), ports.FakeTagger(WORDS), "r") == {"batches": 2, "completed": 1}
    marks = [r.chunk_id for r in store.read("checkpoints").collect()]
    assert len(marks) == len(set(marks)) == 30 and before < set(marks) and seen == []
    assert incremental.apply_pending(store, limit=7) == (7, 0) and incremental.apply_pending(store) == (23, 0)
    same_as_whole(spark, store, docs)


def test_a_hundredth_of_the_documents_writes_about_a_hundredth(spark):
    import random

    rng = random.Random(3)
    store, fake, tags = Store(spark, new_path(spark, "inc-bytes")), ports.FakeEmbedder(), ports.FakeTagger([f"w{i}" for i in range(100)])
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400))
    docs = {i: sections(*(prose() for _ in range(6))) for i in range(400)}
    spark_docs = markdown(spark, docs).coalesce(1)
    incremental.ingest(store, spark_docs, fake, tags, "r1", batches=1)
    incremental.apply_pending(store)
    full = store._bytes(store.root)
    changed = {i: docs[i] + "\n\n## More\n\n" + prose() for i in (7, 70, 170, 270)}
    incremental.ingest(store, markdown(spark, changed).coalesce(1), fake, tags, "r2", batches=1)
    incremental.apply_pending(store)
    assert store._bytes(store.root) - full < 0.02 * full
    assert store.read("chunks").count() == 400 * 6 + 4 == store.read("index").count()


def test_layers(spark, monkeypatch):
    monkeypatch.setattr(store_module, "LAYERS", 4)
    store = Store(spark, new_path(spark, "layers"))
    add = lambda pairs, gone=None: store.commit({}, layers={"t": (spark.createDataFrame(pairs, "k int, v string"), None if gone is None else spark.createDataFrame([(g,) for g in gone], "k int"), ["k"])})
    want = {}
    for i in range(9):
        pairs, gone = [(i % 7, f"v{i}")], [i % 7, (i + 3) % 7]
        add(pairs, gone)
        for g in gone:
            want.pop(g, None)
        want |= dict(pairs)
        assert {r.k: r.v for r in store.read("t").collect()} == want
        assert len(store.manifest()["tables"]["t"]["layers"]) <= 4
    add([], list(range(7)))
    assert store.read("t").count() == 0 and store.vacuum() > 0 and store.read("t").count() == 0
    add([(1, "a"), (1, "b")])
    assert rows(store.read("t"), "v") == ["('a',)", "('b',)"]
    with pytest.raises(KeyError):
        store.read("none")
