import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docquarry import ports
from docquarry.plans import flows
from docquarry.session import new_path
from docquarry.sources import files
from docquarry.sources.store import Store
from docquarry.streaming import streams

SMALL = "/root/testdata/sf0.001"


def test_commits_show_whole(spark):
    store = Store(spark, new_path(spark, "store-test"))
    assert store.tables() == []
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert store.commit({"a": a, "b": a.limit(0)}) == 1
    before = store.read("a")
    assert store.upsert("a", spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"]) == 2
    assert sorted(map(tuple, store.read("a").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, before.collect())) == [(1, "x"), (2, "y")]  # an old reader keeps its version
    store.delete("a", spark.createDataFrame([(1,)], "k int"), ["k"])
    assert sorted(r.k for r in store.read("a").collect()) == [2, 3] and store.read("b").count() == 0
    with pytest.raises(ValueError):
        store.upsert("a", spark.createDataFrame([(5, "p"), (5, "q")], "k int, v string"), ["k"])
    assert Store(spark, store.root).manifest()["number"] == 3
    assert store.vacuum() == 2 and store.read("a").count() == 2
    with pytest.raises(KeyError):
        store.read("nothing")


def test_a_lost_race_is_an_error(spark):
    store = Store(spark, new_path(spark, "store-race"))
    rows = spark.range(1)
    store.commit({"t": rows})
    stale = store.manifest()
    store.commit({"t": rows})
    store.manifest = lambda: stale
    with pytest.raises(RuntimeError):
        store.commit({"t": rows})


def test_file_scans(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(json.dumps([{"header": "H", "content": "C", "page_start": 4, "page_end": 5}, {"header": " ", "content": "x"}, {"header": "Z", "content": "y", "page_start": 0}]))
    got = files.header_chunks(spark, str(tmp_path / "h")).orderBy("index").collect()
    assert [(r.header, r.page_start, r.page_end, r.valid) for r in got] == [("H", 4, 5, True), (" ", None, None, False), ("Z", 0, None, False)]
    assert files.source_version(files.header_chunks(spark, str(tmp_path / "h"))).count() == 1
    (tmp_path / "c.json").write_text('{"matches": [{"asset": "a.png", "caption": "A"}, {"asset": 5}, {"caption": "no asset"}, {"asset": "b.png", "caption": " "}]}')
    assert [tuple(r) for r in files.caption_map(spark, str(tmp_path / "c.json")).collect()] == [("a.png", "A")]
    (tmp_path / "p").mkdir()
    block = {"block_id": 1, "block_label": "text", "block_content": "t"}
    (tmp_path / "p" / "page-1.json").write_text(json.dumps({"page_index": 0, "width": 10, "height": 20, "parsing_res_list": [block | {"block_bbox": [0, 0, 1, 1]}, block | {"block_bbox": [0, 0, 1, 1], "source_bbox": [1, 1, 1, 2]}, block | {"source_bbox": [0, 0, 5, 5], "block_bbox": None}]}))
    (tmp_path / "p" / "page-2.json").write_text(json.dumps({"page_index": 1, "width": 0, "height": 20, "parsing_res_list": []}))
    b = files.layout_blocks(files.layout_pages(spark, str(tmp_path / "p"))).orderBy("order").collect()
    assert [(r.page, r.bbox) for r in b] == [(1, [0, 0, 1, 1]), (1, None), (1, [0, 0, 5, 5])]
    (tmp_path / "blob.bin").write_bytes(b"abc")
    found = files.artifacts(spark, str(tmp_path / "blob.bin"))
    path = found.first().path
    want = spark.createDataFrame([(path, 3, hashlib.sha256(b"abc").hexdigest()), ("gone", 1, "x")], "path string, size long, sha256 string")
    assert [tuple(r) for r in files.artifact_violations(found, want).collect()] == [("gone", "missing")]


def test_web_results(spark):
    raw = spark.createDataFrame([("q", '{"results": [{"title": "T", "url": "u", "content": "abcdef"}, {"title": "no url"}, {"link": "v", "description": "d"}]}'), ("r", "{}"), ("s", "not json")], "query string, body string")
    got = files.web_results(raw, most_chars=3).orderBy("query", "rank").collect()
    assert [(r.query, r.status, r["rank"], r.url, r.snippet, r.content) for r in got] == [("q", "ready", 1, "u", None, "abc"), ("q", "ready", 2, "v", "d", None), ("r", "empty", None, None, None, None), ("s", "empty", None, None, None, None)]


def test_ports_see_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, t string")
    seen = ports.embed(rows, "t", ports.FakeEmbedder(8)).orderBy("k").collect()
    assert seen[0].embedding == seen[1].embedding != seen[2].embedding and abs(sum(x * x for x in seen[0].embedding) - 1) < 1e-9

    def short(texts):
        return []

    with pytest.raises(Exception, match="answer each input"):
        ports.embed(rows, "t", short).collect()
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("inf"), 1.0]), (5, [0.0, 1.0])], "k int, embedding array<double>")
    assert sorted((r.k, r.rule) for r in ports.vector_violations(v, "k").collect()) == [(2, "other dimension"), (3, "missing"), (4, "empty or not finite")]


def test_ingest_again_embeds_only_changes(spark):
    store = Store(spark, new_path(spark, "flow-test"))
    schema = "document_ref string, source_version string, markdown string"
    first = spark.createDataFrame([("a", "1", "## One\n\nharmony text\n\n## Two\n\nother text"), ("b", "1", "## B\n\nmore harmony")], schema)
    assert {r.change for r in flows.ingest(store, first, ports.FakeEmbedder(), ports.FakeTagger(["harmony"])).collect()} == {"new"}
    again = spark.createDataFrame([("a", "1", "## One\n\nharmony text\n\n## Two\n\nnew words")], schema)
    changes = sorted(r.change for r in flows.ingest(store, again, ports.FakeEmbedder(), ports.FakeTagger(["harmony"])).collect())
    assert changes == ["new", "stale", "unchanged"]
    assert store.read("index").count() == 3 and store.read("chunks").count() == 3
    assert [(r.normalized_label, r.usage_count) for r in store.read("catalog").collect()] == [("harmony", 2)]
    context = flows.retrieve(store, "harmony", ports.FakeEmbedder()(["harmony"])[0], hits=3, paragraphs=2)
    rows = context.collect()
    assert [r.place for r in rows] == [1, 2] and all(r.evidence_id.startswith("document:") for r in rows)
    text, sources = flows.answer(context, lambda q, c: ("Both [2] and [1].", ["[2]", "[1]"]), "q")
    assert text == "Both [1] and [2]." and sources == [rows[1].evidence_id, rows[0].evidence_id]
    with pytest.raises(ValueError):
        flows.answer(context, lambda q, c: ("No [9].", ["[9]"]), "q")


def test_stream_applies_a_batch_once(spark, tmp_path):
    store = Store(spark, new_path(spark, "outbox-test"))
    store.commit({"t": spark.createDataFrame([(1, 0.5), (2, 0.5)], "record_id long, value double")})
    events = streams.event_stream(spark, SMALL).select("event_id", F.col("user_id").alias("record_id"), F.lit("upsert").alias("operation"), "value")
    streams.drain_outbox(events, store, "t")
    number = store.manifest()["number"]
    last = spark.read.parquet(f"{SMALL}/events.parquet").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    got = {r.record_id: r.value for r in store.read("t").collect()}
    assert all(got[r.user_id] == r.v for r in last.collect()) and number >= 2


def test_scratch_is_deleted_and_results_stay(spark):
    from docquarry.session import saved, scratch

    path = new_path(spark, "kept")
    with scratch(spark):
        inner = saved(spark.range(5), "inner")
        out = saved(inner.where("id > 1"), "out", path)
    assert out.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|not found"):
        inner.collect()
