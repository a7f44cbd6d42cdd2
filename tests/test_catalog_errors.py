"""Times of a rebuilt catalog, errors of traversal and of the image gate, on worked examples."""

import datetime as dt

from pyspark.sql import functions as F

from docquarry.operators import concepts, records


def test_created_at_survives_a_rebuild(spark):
    schema = "document_ref string, source_version string, normalized_label string, canonical_label string, usage_count long, examples array<struct<header:string,excerpt:string>>"
    seen = spark.createDataFrame([("b", "1", "tone", "tone", 2, [("h", "e")]), ("a", "2", "tone", "Tone", 3, []), ("b", "1", "reed", "Reed", 1, [])], schema)
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    previous = spark.createDataFrame([("tone", old), ("gone", old), ("tone", new)], "normalized_label string, created_at timestamp")
    got = {r.normalized_label: r for r in concepts.rebuilt_catalog(seen, previous, F.lit(new)).collect()}
    assert {k: (r.usage_count, r.first_seen_source, r.created_at, r.updated_at) for k, r in got.items()} == {"tone": (5, "a", old, new), "reed": (1, "b", new, new)}


def test_traversal_errors(spark):
    f = spark.createDataFrame([("p1", "c", "Tone", "r"), ("p1", "c", "TONE", "r"), ("p2", "c", "Reed", "r"), ("p3", "d", "Reed", "r")], "paragraph_id string, chunk_id string, concept string, role string")
    chosen = spark.createDataFrame([("s1", "tone", "r", "c"), ("s2", "reed", "r", "x"), ("s2", "reed", "r", "d"), ("s3", "reed", "r", "x"), ("s4", None, "r", "c")], "selection string, concept string, role string, chunk_id string")
    paras = spark.createDataFrame([("p1",), ("p3",)], "paragraph_id string")
    assert sorted((r.key, r.rule) for r in concepts.traversal_violations(chosen, f, paras).collect()) == [("p1/tone/r", "relation given twice"), ("p2", "relation of a missing paragraph"), ("s3", "pair without paragraph"), ("s4", "pair without paragraph")]


def test_strict_image_gate(spark):
    rows = spark.createDataFrame([(1, ["a.png", "../b.png", "../b.png", None]), (2, ["café.png", "/x", "x/"]), (3, None), (4, []), (5, ["a/b.png"])], "k int, refs array<string>")
    got = sorted((r.k, str(r.ref)) for r in records.unsafe_images(rows, "k", "refs").collect())
    assert got == [(1, "../b.png"), (1, "None"), (2, "/x"), (2, "café.png"), (2, "x/")]
