from pyspark.sql import functions as F

from docquarry import ports
from docquarry.operators import concepts, evidence
from docquarry.plans import flows
from docquarry.session import saved


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_told_where_facts_lie(spark):
    """Few labels stand in very many facts: these are not dealt by label to find its key."""
    rows = [("d1", "s", "c1", i, f"p{i}", label, "H", f"x{i}") for i, label in enumerate(["Straße", "STRASSE", " ", "A  b", "a B", None, "Straße"])]
    facts = spark.createDataFrame(rows, "document_ref string, source_version string, chunk_id string, ordinal int, paragraph_id string, concept string, header string, excerpt string")
    found = concepts.document_catalog(facts, ["document_ref", "source_version"])
    assert plan(found).count("Join") == 1  # usage and examples, by label of a document
    got = {(r.normalized_label, r.canonical_label, r.usage_count, tuple(e.excerpt for e in r.examples)) for r in found.collect()}
    assert got == {("strasse", "STRASSE", 3, ("x0", "x1", "x6")), ("a b", "A  b", 2, ("x3", "x4"))}


def test_ports_count_hashes(spark, monkeypatch):
    """Digests and texts that stand once are not moved, whatever number of hashes is sent to all tasks."""
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else f"text {i % 40}" if i % 2 else f"own {i}") for i in range(200)], "id int, text string")
    seen = []

    def keep(df, name, path=None, codec=None):
        seen.append((name, [f.dataType.simpleString() for f in df.schema], plan(df)))
        return saved(df, name, path, codec)

    monkeypatch.setattr(ports, "saved", keep)
    want = {r.id: r.text and [r.text.upper()] for r in rows.collect()}
    for most in (10, 0):
        monkeypatch.setattr(ports, "MOST", most)
        got = ports.tag(rows, "text", lambda texts: [[] if t is None else [t.upper()] for t in texts])
        assert {r.id: r.labels or None for r in got.collect()} == want and got.count() == 200
    assert all(n == "repeated-texts" and kinds == ["bigint"] and "sha2" not in p for n, kinds, p in seen) and len(seen) == 2


def test_texts_are_dealt_only_where_files_are_few(spark, tmp_path):
    docs = spark.range(64).select(F.col("id").cast("string").alias("document_ref"), F.lit("s").alias("source_version"), F.lit("## A\n\nx").alias("markdown"))
    cores = spark.sparkContext.defaultParallelism
    for n, dealt in ((1, True), (cores, False)):
        docs.repartition(n).write.parquet(f"{tmp_path}/{n}")
        chunks = flows.chunked(spark.read.parquet(f"{tmp_path}/{n}"))
        assert ("Repartition" in plan(chunks)) == dealt and chunks.count() == 64


def test_chunks_that_are_not_hit_are_not_dealt(spark):
    hits = spark.createDataFrame([(0, "c1", 1)], "query_id int, chunk_id string, rank int")
    paras = spark.createDataFrame([(f"c{i % 3}", i, f"p{i}") for i in range(9)], "chunk_id string, ordinal int, paragraph_id string")
    chunks = spark.createDataFrame([(f"c{i}", f"h{i}") for i in range(3)], "chunk_id string, header string")
    found = evidence.hydrate(hits, paras, chunks, ["chunk_id"])
    assert [(r.place, r.paragraph_id, r.header) for r in found.orderBy("place").collect()] == [(1, "p1", "h1"), (2, "p4", "h1"), (3, "p7", "h1")]
    assert "LeftSemi" in plan(found)
