import random

from pyspark.sql import functions as F

from docquarry.operators import answers


def test_bundles_tell_what_is_wrong(spark):
    hits = spark.createDataFrame([(1, 2, "b", "v1", "t", ["y", "x"]), (1, 1, "a", "v1", "t", ["x"]), (2, 1, "a", "v1", "t", None), (2, 2, "b", "v2", "t", None), (3, 1, "a", "v1", " ", [])], "query_id int, rank int, chunk_ref string, version string, text string, image_refs array<string>")
    got = {r.query_id: (r.status, r.selected_refs, r.image_refs) for r in answers.evidence_bundles(hits, spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")).collect()}
    assert got == {1: ("ready", ["a", "b"], ["x", "y"]), 2: ("several versions", ["a", "b"], []), 3: ("missing text", ["a"], []), 4: ("no matching evidence", [], [])}


def test_role_violations(spark):
    facts = spark.createDataFrame([("Harmony", "Definition"), ("Theory", "Example")], "concept string, role string")
    chosen = spark.createDataFrame([("s1", " harmony", "Definition", 1), ("s2", "Harmony", "Example", 2), ("s3", "Unknown", "Example", 3), ("s4", "Theory", "Example", 1)], "selection string, concept string, role string, rank int")
    assert sorted((r.selection, r.rule) for r in answers.role_violations(chosen, facts).collect()) == [("s1", "rank given twice"), ("s2", "unknown role"), ("s3", "unknown concept"), ("s4", "rank given twice")]


def test_answer_context_with_roles(spark):
    p = spark.createDataFrame([(1, 5, "S", "H", ["n1", "n2"], ["4", "5"], [], ["a.png"], "Text")], "query_id int, place int, source string, header string, nested array<string>, pages array<string>, labels array<string>, image_refs array<string>, text string")
    r = spark.createDataFrame([(1, 1, "Harmony", "Definition", [1], [("c1", 1)])], "query_id int, n int, concept string, role string, places array<int>, parents array<struct<chunk_id:string,rank:int>>")
    text = answers.answer_context("Why?", p, r).first().markdown
    assert text == "# Retrieval Context\n\n## User question\n\nWhy?\n\n## Concept-role map\n\n### Concept: Harmony\n\n- Selected role: Definition\n- Paragraphs: [1]\n- Parent chunks: c1 (rank 1)\n\n## Source paragraphs\n\n### [1]\n\n- Source: S\n- Parent header: H\n- Nested heading: n1; n2\n- Pages: 4–5\n- Concepts and roles: \n- Images: a.png\n\nText\n"


def test_used_refs(spark):
    context = spark.createDataFrame([(1, 1, "r1"), (1, 2, "r2"), (1, 3, "2")], "query_id int, place int, paragraph_ref string")
    used = spark.createDataFrame([(1, 0, "1"), (1, 1, "r2"), (1, 2, "2"), (1, 3, "9"), (1, 4, "r1")], "query_id int, pos int, value string")
    good, bad = answers.used_refs(used, context)
    assert sorted((r.place, r.paragraph_ref) for r in good.collect()) == [(1, "r1"), (2, "r2"), (3, "2")]
    assert sorted((r.value, r.rule) for r in bad.collect()) == [("9", "not in the context"), ("r1", "used twice")]


def test_pages_and_web(spark):
    df = spark.createDataFrame([(["x", " 4", "7"],), (["x"],)], "p array<string>")
    first, last = answers.source_pages(F.col("p"))
    assert [tuple(r) for r in df.select(first, last).collect()] == [(4, 7), (None, None)]
    web = spark.createDataFrame([(1, "T", "u", "s", None), (1, "Other", "u", "s", "c"), (1, "N", None, "s", "c")], "run_id int, title string, url string, snippet string, content string")
    assert answers.web_evidence(web).count() == 1
    plans = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", " a "]), (3, ["a"]), (4, ["a", "b", "c"])], "run_id int, queries array<string>")
    assert sorted(r.run_id for r in answers.plan_violations(plans).collect()) == [2, 3, 4]


def test_denied_calls_use_nothing(spark):
    rng = random.Random(1)
    calls = [(run, i, rng.choice(["docs", "web", "other"]), rng.choice([5, 20, 60])) for run in range(10) for i in range(12)]

    def plain(run):
        left, used, out = {"docs": 3, "web": 2}, 0, []
        for _, _, tool, n in (c for c in calls if c[0] == run):
            ok = left.get(tool, 1) > 0 and used + n <= 120
            if ok:
                used += n
                if tool in left:
                    left[tool] -= 1
            out.append(ok)
        return out

    df = spark.createDataFrame(calls, "run int, n int, tool string, tokens long")
    got = {}
    for r in answers.admitted_calls(df, "run", "n", {"docs": 3, "web": 2}, 120).orderBy("run", "n").collect():
        got.setdefault(r.run, []).append(r.admitted)
    assert got == {run: plain(run) for run in range(10)}


def test_captions(spark):
    p = spark.createDataFrame([("p1", ["a.png", "b.png"]), ("p2", [])], "paragraph_id string, image_refs array<string>")
    c = spark.createDataFrame([("a.png", " A "), ("z.png", "Z")], "asset string, caption string")
    assert {r.paragraph_id: r.image_captions for r in answers.with_captions(p, c).collect()} == {"p1": {"a.png": "A"}, "p2": {}}
