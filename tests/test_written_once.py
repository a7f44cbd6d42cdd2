import json

from pyspark.sql import functions as F

from docquarry import ports
from docquarry.operators import outbox
from docquarry.plans import incremental
from docquarry.session import new_path
from docquarry.sources.store import Store


def columns(spark, store, name):
    return {c for layer in store.manifest()["tables"][name]["layers"] for c in spark.read.parquet(f"{store.root}/{name}/{layer['rows']}").columns}


def test_made_columns_are_not_in_files(spark):
    store = Store(spark, new_path(spark, "made"))
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(6)], "id int, a string").withColumn("b", F.expr("concat('-', a)"))
    whole, parts = store.staged_parts("t", rows, F.col("id") % 2, 3, {"b": "concat('-', a)"})
    assert parts[2] is None and sorted(r.b for r in whole.collect()) == [f"-x{i}" for i in range(6)] and whole.columns == rows.columns
    store.commit({}, layers={"t": (parts[1], None, ["id"])})
    assert sorted(r.b for r in store.read("t").collect()) == ["-x1", "-x3", "-x5"]
    new = spark.createDataFrame([(1, "y", "-y"), (7, "z", "-z")], "id int, a string, b string")
    for n in range(3):  # the later layers outweigh the first: all become one
        store.commit({}, layers={"t": (new, new.select("id"), ["id"])})
        assert sorted(r.b for r in store.read("t").collect()) == ["-x3", "-x5", "-y", "-z"]
    assert columns(spark, store, "t") == {"id", "a"}
    store.vacuum()
    assert store.read("t").count() == 4
    store.commit({}, layers={"u": (rows, None, ["id"])})  # a table that has the column in its files keeps it there
    store.commit({}, layers={"u": (store.staged("u", new, made={"b": "concat('-', a)"}), None, ["id"])})
    assert columns(spark, store, "u") == {"id", "a", "b"} and store.read("u").count() == 8


def test_a_first_ingest_writes_chunks_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(incremental, "saved", lambda df, name, path=None, codec=None, own=incremental.saved: kept.append(name) or own(df, name, path, codec))
    store = Store(spark, new_path(spark, "once"))
    docs = spark.createDataFrame([(f"d{i}", "s1", f"## H{i}\n\ntext {i}\n\n## I\n\nsame") for i in range(4)], "document_ref string, source_version string, markdown string")
    assert incremental.ingest(store, docs, ports.FakeEmbedder(), None, "r", batches=2) == {"batches": 2, "completed": 1}
    assert incremental.apply_pending(store) == (8, 0)
    assert not {"chunks", "changed-chunks", "open-records"} & set(kept) and "search_text" not in columns(spark, store, "chunks")
    assert len({x["rows"].split("/")[0] for x in store.manifest()["tables"]["chunks"]["layers"]}) == 1
    assert {r.search_text for r in store.read("chunks").where("document_ref = 'd2'").collect()} == {"## H2\n\ntext 2", "## I\n\nsame"}


def test_sync_with_kept_rows_equals_sync_without(spark):
    """What is kept holds no payloads; records that come twice, bad payloads, deletes and taken identities included."""

    def event(i, key, doc="d1", operation="upsert", text="t", version="v1", status="pending"):
        record = {"chunk_id": key, "document_ref": doc, "source_version": "s", "search_text": text, "embedding": [1.0, 2.0], "embedding_profile": "m", "access_scope": "public", "metadata": {}}
        return (f"e{i:03d}", "r", doc, "s", outbox.CHUNKS, key, operation, json.dumps({"record": record}) if text else "{", version, status, 0, None)

    rows = [event(1, "a"), event(2, "a", text="newer"), event(3, "b"), event(4, "b", operation="delete"), event(5, "c", text=""), event(6, "x", doc="other"), event(7, "y"), event(8, "z", operation="delete"), event(9, "q", status="done"), event(10, "a", version="v2", status="failed")]
    events = spark.createDataFrame(rows, incremental._EVENT)
    index = spark.createDataFrame([("z", "d1", "old", [0.5]), ("a", "d1", "older", [0.5]), ("u", "d1", "stays", [0.5])], "record_id string, document_ref string, search_text string, embedding array<double>")
    states = spark.createDataFrame([("chunk", "x", outbox.CHUNKS, "x", "h", "m", 2, "v1", "synced", "d9", "s"), ("chunk", "z", outbox.CHUNKS, "z", "h", "m", 2, "v1", "synced", "d1", "s"), ("chunk", "u", outbox.CHUNKS, "u", "h", "m", 2, "v1", "synced", "d1", "s")], incremental._STATE)
    none, kept = spark.createDataFrame([], "record_id string"), []
    plain = outbox.sync(events, index, none, states, None)
    narrow = outbox.sync(events, index, none, states, None, kept=lambda df: kept.append(set(df.columns)) or df.localCheckpoint())
    for name in ("outbox", "chunks", "concepts", "states", "counts"):
        a, b = (sorted(map(str, getattr(x, name).select(*getattr(plain, name).columns).collect())) for x in (plain, narrow))
        assert a == b, name
    assert not any({"payload", "record", "concept"} & x for x in kept) and plain.counts.first()["failed"] == 2


def test_batches_of_a_first_ingest_are_not_written_again(spark):
    """Layers that take nothing away are no reason to write all as one, however they compare."""
    store = Store(spark, new_path(spark, "batches"))
    for n in (1, 60, 60):
        store.commit({}, layers={"t": (spark.range(n * 50).select((F.col("id") * 200 + n).alias("id"), F.md5(F.col("id").cast("string")).alias("x")), None, ["id"])})
    few = spark.createDataFrame([(1, "new")], "id long, x string")
    store.commit({}, layers={"t": (few, few.select("id"), ["id"])})
    assert len(store.manifest()["tables"]["t"]["layers"]) == 4 and store.read("t").where("id = 1").first().x == "new"
