"""Steps whose shuffles and memory must not outgrow their input."""

from pyspark.sql import functions as F

from docquarry import ports
from docquarry.functions import text as T
from docquarry.operators import concepts, records, search, segment
from docquarry.plans import flows, incremental
from docquarry.session import new_path
from docquarry.sources.store import Store


def test_examples_are_limited_before_headers_and_excerpts_move(spark):
    rows = [("d", f"C{i % 2}", i // 3, i % 4, f"p{i:03d}", f"h{i}", f"e{i}") for i in range(40)]
    facts = spark.createDataFrame(rows + rows[::-1] + [("d", " c0 ", 0, 0, "p000", "a", "b"), ("d", None, 0, 0, "p0", "h", "e")], "document_ref string, concept string, chunk_id int, ordinal int, paragraph_id string, header string, excerpt string")
    out = concepts.document_catalog(facts, ["document_ref"])
    got = {r.normalized_label: r for r in out.collect()}
    assert {k: (r.canonical_label, r.usage_count) for k, r in got.items()} == {"c0": (" c0 ", 20), "c1": ("C1", 20)}
    assert [(e.header, e.excerpt) for e in got["c0"].examples] == [("a", "b"), ("h2", "e2"), ("h4", "e4")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The headers are grouped above the window that limits, so only limited rows carry them on.
    assert plan.index("min(header") < plan.index("dense_rank(")


def test_staged_rows_become_a_layer_as_they_lie(spark):
    store = Store(spark, new_path(spark, "staged-store"))
    rows = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h")], "k string, v int, beside string")
    first = store.staged("t", rows, ["beside"])
    assert "t" not in store.tables() and first.columns == ["k", "v", "beside"]
    store.commit({}, layers={"t": (first, None, ["k"])})
    second = store.staged("t", spark.createDataFrame([("b", 3, "x")], "k string, v int, beside string"), ["beside"])
    store.commit({}, layers={"t": (second, spark.createDataFrame([("b",)], "k string"), ["k"])})
    assert sorted(tuple(r) for r in store.read("t").collect()) == [("a", 1), ("b", 3)]
    folders = {x["rows"] for x in store.manifest()["tables"]["t"]["layers"]}
    assert len(folders) == 1 or any(f in folders for f in (first.inputFiles()[0].split("/")[-2], second.inputFiles()[0].split("/")[-2]))
    store.commit({"old": rows})
    store.commit({}, layers={"old": (rows.where("k = 'a'"), rows.select("k"), ["k"])})  # a whole table takes layers, too
    assert [r.k for r in store.read("old").collect()] == ["a"]


def test_ingest_writes_its_texts_once(spark):
    store = Store(spark, new_path(spark, "once-store"))
    docs = spark.createDataFrame([("d1", "s1", "## A\n\nmusic one\n\n---\n## B\n\nmusic two\n\ntwo"), ("d2", "s1", "## C\n\nnone")], "document_ref string, source_version string, markdown string")
    flows.ingest(store, docs, ports.FakeEmbedder(), ports.FakeTagger(["music"]))
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(store.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("chunks", "paragraphs", "relations", "observations", "index"):
        assert len(fs.listStatus(jvm.Path(f"{store.root}/{name}"))) == 1, name
    assert store.read("paragraphs").count() == 4 and "header" not in store.read("relations").columns
    assert [(e.header, e.excerpt) for e in store.read("catalog").first().examples] == [("A", "music one"), ("B", "music two")]
    flows.ingest(store, docs.where("document_ref = 'd1'").withColumn("markdown", F.lit("## A\n\nmusic three")), ports.FakeEmbedder(), ports.FakeTagger(["music"]))
    assert sorted(r.text for r in store.read("paragraphs").collect()) == ["music three", "none"] and store.read("index").count() == 2 and store.read("states").count() == 2


def test_topk_sends_vectors_as_they_are_to_few_blocks_of_queries(spark):
    index = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1).cast("float"), (F.col("id") % 7).cast("float")).alias("embedding"))
    out = search.batch_topk(index, index.select(F.col("vec_id").alias("query_id"), "embedding"), 2, exclude_self=True)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "array<double>" not in plan and "sequence(0, 7" in plan  # eight blocks of 20,000 queries, not ten
    assert {r.vec_id for r in out.where("query_id = 0").collect()} == {7, 14}


def test_refs_are_joined_in_order_over_ranges(spark):
    met = spark.createDataFrame([(s, f"{i}-{j}") for s in ("a/x", "b/y") for i in range(300) for j in range(3)] + [("c", "only")], "selection string, paragraph_id string").repartition(5)
    got = {r.selection: r.paragraph_refs for r in concepts.joined_refs(met, most=100).collect()}
    want = ",".join(sorted(f"{i}-{j}" for i in range(300) for j in range(3)))
    assert got == {"a/x": want, "b/y": want, "c": "only"}


def test_label_keys_are_found_where_the_rows_lie(spark):
    labels = ["Jazz", " jazz  Ｘ ", "STRASSE\x1c b", "Straße", "été", "  ", "", None]
    rows = spark.createDataFrame([(i, labels[i % 8]) for i in range(80)], "n int, label string")
    keyed = T.with_key(rows, "label", "key")
    assert "Join" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    want = {r.n: r.key for r in rows.select("n", T.concept_key(F.col("label")).alias("key")).collect()}
    assert {r.n: r.key for r in keyed.collect()} == want and len(set(want.values())) == 6


def test_oversized_rows_are_packed_once(spark):
    rows = spark.createDataFrame([("a", "one two three four five\n\nsix"), ("b", "one two"), ("c", ""), ("d", None)], "k string, content string")
    out = segment.split_oversized(rows, limit=3, target=2)
    got = [(r.k, r.part, r.parts, r.content) for r in out.orderBy("k", "part").collect()]
    assert got == [("a", 1, 3, "one two"), ("a", 2, 3, "three four"), ("a", 3, 3, "five\n\nsix"), ("b", 1, 1, "one two"), ("c", 1, 1, ""), ("d", 1, 1, None)]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_cache_is_not_sent_to_all_tasks(spark):
    paras = spark.createDataFrame([("p1", "x", 1), ("p2", "x", 2), ("p3", "y", 1)], "paragraph_id string, content_sha string, ordinal int")
    out = records.remapped(spark.createDataFrame([("x", 1, "l")], "content_sha string, ordinal int, label string"), paras)
    assert {r.paragraph_id: r.label for r in out.collect()} == {"p1": "l", "p2": None, "p3": None}
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_segmenting_deals_no_lines(spark):
    """Chunks and paragraphs are found inside the row of their text: no shuffle, window or sort over lines."""
    docs = spark.createDataFrame([(1, "## A\n\nx\n\nx ![i](i.png)\n\n![j](j.png)")], "doc int, markdown string")
    chunks = segment.header_chunks(docs, ["doc"])
    named = chunks.select("doc", F.concat(F.col("doc").cast("string"), F.lit("c")).alias("chunk_id"), "content")
    found = segment.identified_paragraphs(named, ["chunk_id"], "content")
    for df in (chunks, found, segment.paragraphs(chunks, ["doc"], "content")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Exchange", "Window", "Sort "))
    assert [(r.ordinal, r.text, r.occurrence, r.image_refs) for r in found.orderBy("ordinal").collect()] == [(0, "x", 1, []), (1, "x ![i](i.png)", 1, ["i.png", "j.png"])]


def test_a_first_ingest_takes_no_keys_away(spark):
    """Layers of a first ingest and of its applied events name no keys, so that reading them joins nothing."""
    store = Store(spark, new_path(spark, "no-keys"))
    docs = spark.createDataFrame([(f"d{i}", "s1", f"## S\n\nsame\n\n## T\n\nown {i}") for i in range(6)], "document_ref string, source_version string, markdown string")
    incremental.ingest(store, docs, ports.FakeEmbedder(), None, "r", batches=2)
    assert incremental.apply_pending(store) == (12, 0)
    tables = store.manifest()["tables"]
    assert {n: any(x["gone"] for x in tables[n]["layers"]) for n in ("chunks", "paragraphs", "outbox", "index")} == dict.fromkeys(("chunks", "paragraphs", "outbox", "index"), False)
    assert store.read("outbox").where("status = 'done'").count() == store.read("outbox").count() == store.read("index").count() == 12


def test_new_events_take_one_aggregate(spark):
    """One shuffle by id before anything is counted, and no join; nulls and known ids as before."""
    from docquarry.operators import state

    known = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 9.0)], "event_id long, value double")
    given = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 4.0), (3, 4.0), (4, 1.0), (4, None), (5, None), (None, 1.0), (None, 2.0)], "event_id long, value double")
    fresh, conflicts = state.enqueue(known, given, ["value"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(r.event_id or 0 for r in fresh.collect()) == [0, 3, 5]
    assert sorted(r.event_id or 0 for r in conflicts.collect()) == [0, 2, 4]


def test_timers_are_kept_by_bucket(spark):
    """Keys of a bucket share one call and one state, which holds no key that is free."""
    from docquarry.streaming import timers

    requests = spark.createDataFrame([("a", 1, "start"), ("b", 2, "start")], "key string, request_id long, kind string").selectExpr("*", "timestamp'2026-01-01' AS ts", "cast(null AS long) AS token")
    plan = timers.timed(requests, 60, buckets=1)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan.split("FlatMapGroupsInPandasWithState", 1)[1].split("\n", 1)[0]
    assert timers._unpacked(timers._packed({"a": [1, 2, True]})) == {"a": [1, 2, True]}


def test_texts_are_cut_at_once_as_line_by_line(spark):
    """White space is trimmed without patterns, and what is cut at once is what is read line by line."""
    row = spark.createDataFrame([("x",)], "t string")
    for c in (T.strip(F.col("t")), T.rstrip(F.col("t")), T.is_blank(F.col("t"))):
        assert "regexp" not in row.select(c)._jdf.queryExecution().executedPlan().toString()
    bits = ["## A\n", "\n## B ##\r\n", "\n# T\n", "\n## Page 3\n", "\n##  \n", "\n## \n", "\n#tag\n", "\n### deep\n", "a b", "\n\n", " \n", "\n\xa0\n", "---\n", "\n --- \n", "ß x", "  in", "![i](p.png)", "\n\n\n\n", "<b", "\x0b"]
    texts = ["".join(bits[(i * k + i // 7 + k * k) % len(bits)] for k in range(1, 3 + i % 9)) for i in range(600)] + ["", "## A", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    both = df.select(segment._sections(F.col("t"), 2).alias("a"), F.filter(segment._paged_sections(T.plain_ends(F.col("t")), 2), lambda c: F.length(c["content"]) > 0).alias("b"), segment._paragraphs(F.col("t")).alias("c"), segment._lined_paragraphs(T.plain_ends(F.col("t"))).alias("d")).collect()
    assert len(both) == 603 and all(r.a == r.b and r.c == r.d for r in both)
    assert sum(len(r.a) for r in both) > 100 and sum(len(r.c) for r in both) > 600


def test_an_identity_ends_before_any_white_space(spark):
    rows = spark.createDataFrame([("Abc  d\x85",), ("Abc ",), ("Ünï\x85",), (None,)], "t string")
    got = rows.select(T.identity_text(F.col("t")).alias("one"), T.identity_texts(F.array("t", F.lit("X  y"))).alias("all")).collect()
    assert [r.one for r in got] == ["abc d", "abc", "ünï", None] and [r.all for r in got] == [[r.one, "x y"] for r in got]
    assert spark.createDataFrame([(1, None), (2, []), (3, ["A"])], "i int, t array<string>").select(T.identity_texts(F.col("t"))).collect() == [(None,), ([],), (["a"],)]
