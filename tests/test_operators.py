import pytest
from pyspark.sql import functions as F

from docquarry.functions import vectors
from docquarry.operators import concepts, evidence, metrics, records, search, state


def test_vector_distances_and_topk(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = search.vector_topk(df, [2.0, 0.0], 4).select("vec_id", "distance").collect()
    assert [(r[0], round(r[1], 9)) for r in top] == [(1, 0.0), (3, 0.0), (2, 1.0), (4, 1.0)]
    assert search.vector_topk(df, [1.0, 0.0], 0).count() == 0
    assert [r[0] for r in search.vector_topk(df, [1.0, 0.0], 2, metric="l2sq").select("vec_id").collect()] == [1, 3]
    queries = spark.createDataFrame([(10, [0.0, 3.0]), (11, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.distance, 6)) for r in search.batch_topk(df.repartition(3), queries, 2).collect())
    assert got == [(10, 1, 2, 0.0), (10, 2, 1, 1.0), (11, 1, 1, 1.0), (11, 2, 2, 1.0)]
    assert search.batch_topk(df.limit(0), queries, 2).count() == 0 and search.batch_topk(df, queries.limit(0), 2).count() == 0
    bad = spark.createDataFrame([([1.0],), ([],), ([float("nan")],), (None,)], "v array<double>").select(vectors.is_vector(F.col("v")))
    assert [r[0] for r in bad.collect()] == [True, False, False, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "a", 2)], "k int, s string, n int")
    assert [r.k for r in df.where(search.matches({"s": "a"})).orderBy("k").collect()] == [1, 3]
    assert [r.k for r in df.where(search.matches({"s": "a", "n": None})).collect()] == [1]
    for bad in ({" ": 1}, {"s": float("inf")}, {"s": [1]}):
        with pytest.raises(ValueError):
            search.matches(bad)
    with pytest.raises(ValueError):
        search.browse(df, "k", 0, 101)
    page = search.browse(df, "k", 1, 1, {"s": "a"}).collect()
    assert [(r.k, r.total, r.has_more) for r in page] == [(3, 2, False)]


def test_fusion_ranks_and_breaks_ties_by_key(spark):
    s = spark.createDataFrame([("shared", 1, 0.9), ("dense", 2, 0.8)], "chunk_ref string, rank int, semantic_score double")
    k = spark.createDataFrame([("shared", 1, 0.7), ("lexical", 2, 0.5)], "chunk_ref string, rank int, keyword_score double")
    got = search.fuse(s, k, 10).orderBy("rank").collect()
    assert [(r.chunk_ref, r.rank) for r in got] == [("shared", 1), ("dense", 2), ("lexical", 3)]
    assert abs(got[0].fused_score - 2 / 61) < 1e-12 and (got[0].semantic_score, got[0].keyword_score) == (0.9, 0.7)


def test_lexical_search_counts_substrings(spark):
    df = spark.createDataFrame([("b", "Major triads"), ("a", "a major key"), ("c", "minor")], "chunk_ref string, t string")
    got = search.lexical_search(df, "MAJOR triad major", F.col("t"), 5).orderBy("rank").collect()
    assert [(r.chunk_ref, r.keyword_score) for r in got] == [("b", 1.0), ("a", 0.5)]
    assert search.lexical_search(df, " ,. ", F.col("t"), 5).count() == 0


def test_candidates(spark):
    c = spark.createDataFrame([(1, "Harmony", 2, 0.5), (1, " harmony ", 1, 0.1), (1, "Harmonics", 3, 0.9), (1, "Major Triad", 4, 0.9), (1, " ", 0, 1.0)], "s int, label string, rank int, score double")
    assert [(r.label, r.rank) for r in concepts.deduplicated_candidates(c, ["s"]).orderBy("rank").collect()] == [(" harmony ", 1), ("Harmonics", 3), ("Major Triad", 4)]
    assert [r.label.strip() for r in concepts.ranked_candidates(c, F.lit("  harmony "), 3, ["s"]).orderBy("place").collect()] == ["harmony", "Harmonics", "Major Triad"]


def test_catalogs(spark):
    schema = "document_ref string, chunk_id int, ordinal int, paragraph_id string, concept string, header string, excerpt string"
    f = spark.createDataFrame([("a", 1, 0, "p1", "Harmony", "H", "x"), ("a", 1, 0, "p1", "harmony", "H", "x"), ("a", 1, 1, "p2", "HARMONY", "H", "y"), ("a", 2, 0, "p3", "Theory", "T", "z")], schema)
    got = {r.normalized_label: r for r in concepts.document_catalog(f, ["document_ref"], 1).collect()}
    assert got["harmony"].usage_count == 2 and got["harmony"].canonical_label == "HARMONY" and [tuple(e) for e in got["harmony"].examples] == [("H", "x")]
    obs = "document_ref string, source_version string, normalized_label string, canonical_label string, usage_count long, examples array<struct<header:string,excerpt:string>>"
    o = spark.createDataFrame([("doc-b", "1", "harmony", "Harmony", 1, [("B", "b")]), ("doc-a", "1", "harmony", "harmony", 2, [("A", "a")]), ("doc-a", "1", "theory", "Theory", 1, [])], obs)
    g = {r.normalized_label: r for r in concepts.global_catalog(o).collect()}
    assert g["harmony"].usage_count == 3 and [e.header for e in g["harmony"].examples] == ["A", "B"] and g["harmony"].first_seen.document_ref == "doc-a" and g["theory"].usage_count == 1


def test_tagging_violations(spark):
    kind = "chunk_id string, paragraphs array<struct<paragraph_id:string, labels:array<struct<label:string, roles:array<string>, reuse:boolean>>>>"
    t = spark.createDataFrame([("c", [("p1", [("Known", ["d"], True)]), ("p1", []), ("p9", [("New", ["d", "e"], False)])])], kind)
    want = spark.createDataFrame([("c", "p1"), ("c", "p2")], "chunk_id string, paragraph_id string")
    cand = spark.createDataFrame([("p1", "other")], "paragraph_id string, label string")
    assert sorted((r.paragraph_id, r.rule) for r in concepts.tagging_violations(t, want, cand).collect()) == [("p1", "repeated paragraph"), ("p1", "reused label is no candidate"), ("p2", "missing paragraph"), ("p9", "unknown paragraph")]
    assert sorted((r.paragraph_id, r.concept, r.role) for r in concepts.relations(t).collect()) == [("p1", "Known", "d"), ("p9", "New", "d"), ("p9", "New", "e")]


def test_state_diff(spark):
    schema = "entity_key string, record_id string, input_hash string, model string, dimensions int, sync_status string"
    old = spark.createDataFrame([("a", "a", "h", "m", 1, "synced"), ("b", "b", "h", "m", 1, "synced"), ("c", "c", "old", "m", 1, "synced"), ("e", "e", "h", "m", 1, "stale")], schema)
    new = spark.createDataFrame([("a", "a", "h", "m", 1, "synced"), ("c", "c", "h", "m", 1, "synced"), ("d", "d", "h", "m", 1, "synced"), ("e", "e", "h", "m", 1, "synced")], schema)
    assert {r.entity_key: r.change for r in state.reconcile(old, new).collect()} == {"a": "unchanged", "b": "stale", "c": "changed", "d": "new", "e": "changed"}


def test_reservations(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    ledger = spark.createDataFrame([("r", "ready", "2024-01-01 00:00:00"), ("f", "processing", "2024-01-01 11:00:01"), ("s", "processing", "2024-01-01 11:00:00"), ("x", "failed", "2024-01-01 11:59:00")], "sha string, status string, t string").select("sha", "status", F.to_timestamp("t").alias("updated_at"))
    asked = spark.createDataFrame([(1, "r"), (2, "f"), (4, "s"), (3, "s"), (5, "x"), (6, "n"), (7, "n")], "request_id int, sha string")
    assert {r.request_id: (r.outcome, r.recovered) for r in state.reserve(asked, ledger, ["sha"], now).collect()} == {1: ("ready", False), 2: ("busy", False), 3: ("reserved", True), 4: ("shared", False), 5: ("reserved", False), 6: ("reserved", False), 7: ("shared", False)}


def test_outbox(spark):
    box = spark.createDataFrame([("e2", "pending", 0, None), ("e1", "failed", 1, "x"), ("e3", "done", 0, None)], "event_id string, status string, attempts int, last_error string")
    assert [r.event_id for r in state.next_batch(box, 5).collect()] == ["e1", "e2"]
    out = spark.createDataFrame([("e1", "done", None), ("e2", "failed", "boom")], "event_id string, outcome string, error string")
    assert {r.event_id: (r.status, r.attempts, r.last_error) for r in state.transitioned(box, out).collect()} == {"e1": ("done", 1, None), "e2": ("failed", 1, "boom"), "e3": ("done", 0, None)}
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "event_id string, payload string")
    fresh, conflicts = state.enqueue(known, spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("c", "3"), ("d", "4"), ("d", "5")], "event_id string, payload string"), ["payload"])
    assert [r.event_id for r in fresh.collect()] == ["c"] and sorted(r.event_id for r in conflicts.collect()) == ["b", "d"]


def test_context_limit_stops_at_the_first_overflow(spark):
    p = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three four five"), (1, 3, "six")], "q int, n int, text string")
    get = lambda most, words: [r.n for r in evidence.limited(p, ["q"], ["n"], most, words).orderBy("n").collect()]
    assert get(1, 99) == [1] and get(5, 4) == [1] and get(5, 5) == [1, 2] and get(5, 1) == []
    assert [r.q for r in evidence.first_too_long(p, ["q"], ["n"], 1).collect()] == [1]
    fit = spark.range(1).select(evidence.greedy_fit(F.array(*[F.struct(F.lit(n).alias("n")) for n in (2, 3, 1, 1)]), 4)).first()[0]
    assert fit == [0, 2, 3]


def test_citations(spark):
    labels = F.array(F.lit("[2]"), F.lit("[1]"))
    one = spark.range(1).select(evidence.renumbered(F.lit("a [1] b [2][1]"), labels), evidence.citations_agree(F.lit("a [1]"), labels), evidence.renumbered(F.lit("none"), F.array(F.lit("[1]"))), evidence.renumbered(F.lit("[2]"), labels)).first()
    assert list(one) == ["a [2] b [1][2]", False, "none", "[1]"]
    pages = spark.createDataFrame([(["x", "0", " 7 ", "8"],), (["x"],), ([],)], "p array<string>").select(evidence.first_page(F.col("p")))
    assert [r[0] for r in pages.collect()] == [7, None, None]


def test_choices_merge(spark):
    rows = [(1, 1, "r1", "s", "Same text", ["1"]), (1, 2, "r2", "", "same  TEXT", ["1", "2"]), (1, 3, "r3", "t", "other", [])]
    got = evidence.merged_choices(spark.createDataFrame(rows, "q int, n int, paragraph_ref string, source string, text string, pages array<string>"), ["q"], "n").orderBy("key").collect()
    assert [(r.key, r.paragraph_ref, r.source, r.text, r.pages) for r in got] == [("1", "r1", "s", "same  TEXT", ["1", "2"]), ("2", "r3", "t", "other", [])]


def test_metrics(spark):
    spans = spark.createDataFrame([("t", 0, 10), ("t", 5, 7), ("t", 7, 9), ("u", 1, 1)], "task string, s int, e int")
    assert {r.task: r.max_concurrency for r in metrics.max_concurrency(spans, "task", "s", "e").collect()} == {"t": 2, "u": 0}
    calls = spark.createDataFrame([("deepseek-flash", 1000, 400, 10), ("other", 1, 0, 1)], "model string, input_tokens long, cached_tokens long, output_tokens long")
    assert [r.cost_usd for r in metrics.model_cost(calls).orderBy("model").collect()] == [(600 * 0.30 + 400 * 0.006 + 10 * 1.20) / 1e6, None]
    c = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.5), (2, "a", 0.9), (2, "b", 0.7), (3, "a", 0.9), (3, "a", 0.9)], "q int, label string, confidence double")
    assert [(r.q, r.options) for r in metrics.clarification(c, "q").collect()] == [(1, ["a", "b"])]


def test_records(spark):
    docs = spark.createDataFrame([("d1", "v1"), ("d2", None), ("d3", "v2")], "document_ref string, active_version string")
    commands = spark.createDataFrame([("d1", "v2"), ("d2", "v1"), ("d3", "v2")], "document_ref string, source_version string")
    assert [tuple(r) for r in records.previous_versions(docs, commands).collect()] == [("d1", "v1")]
    q = spark.createDataFrame([("search the web",), ("Tìm kiếm trên mạng",), ("research theweb",), ("show the figure",), ("figures shown",)], "q string").select(records.wants_web(F.col("q")), records.wants_image(F.col("q")))
    assert [tuple(r) for r in q.collect()] == [(True, False), (True, False), (False, False), (False, True), (False, False)]
    meta = spark.createDataFrame([("k", {"chunk_id": ["x"], " ": ["y"], "ok": [], "tags": ["a"]})], "key string, m map<string,array<string>>")
    assert sorted(r.name for r in records.metadata_violations(meta, "key", "m").collect()) == [" ", "chunk_id"]
    assert set(meta.select(records.plain_metadata(F.col("m"))).first()[0]) == {"chunk_id", " ", "tags"}
    img = spark.createDataFrame([(1, ["a.png", "../b", "a.png"]), (2, ["c.png"])], "id int, refs array<string>")
    known = spark.createDataFrame([("a.png",)], "ref string")
    assert sorted((r.id, r.refs, r.image_errors) for r in records.safe_images(img, "refs", known).collect()) == [(1, ["a.png"], ["image unavailable"]), (2, [], ["image unavailable"])]
    assert records.retry_delay(3, 0.5) == 2.0 and records.retry_delay(1, 0.5, 9.0) == 9.0


def test_transitions(spark):
    log = spark.createDataFrame([("r", 1, "processing"), ("r", 2, "pending"), ("r", 3, "ready"), ("r", 4, "failed"), ("s", 1, "ready"), ("s", 2, "failed"), ("s", 3, "processing")], "k string, n int, state string")
    assert [r.legal for r in state.transitions(log, "k", ["n"]).orderBy("k", "n").collect()] == [True, True, True, False, False, False, True]
