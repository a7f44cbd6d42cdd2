"""The question flow for many questions at once, on worked examples."""

import pytest

from docquarry.operators import answers, questions, records

PARAS = "paragraph_id string, chunk_id string, ordinal int, source string, header string, nested array<string>, pages array<string>, image_refs array<string>, text string"


def _paras(spark):
    rows = [
        ("p1", "a", 0, "doc", "A", ["Sub"], ["4", "5"], [], "one two"),
        ("p2", "a", 1, "doc", "A", [], [], ["images/x.png"], "three four five"),
        ("p3", "b", 0, "doc", "B", [], [], [], None),
        ("p4", "b", 1, "doc", "B", [], [], [], " ".join(["long"] * 40)),
    ]
    return spark.createDataFrame(rows, PARAS)


def _run(spark, asks, selections, hits=(("a", 2), ("b", 1)), relations=None, most=10, words=20):
    q = spark.createDataFrame(asks, "query_id int, question string")
    h = spark.createDataFrame([(i, c, r) for i, _ in asks for c, r in hits if i != 9], "query_id int, chunk_id string, rank int")
    r = spark.createDataFrame(relations or [("p1", " Tone ", "definition"), ("p3", "tone", "example"), ("p4", "Reed", "definition"), ("zz", "Tone", "definition")], "paragraph_id string, concept string, role string")
    s = spark.createDataFrame(selections, "query_id int, pos int, concept string, roles array<string>, selection_rank int")
    return questions.bundles(q, h, r, _paras(spark), s, most, words)


def test_selected_paragraphs_images_and_rendering(spark):
    got = _run(spark, [(1, "Show a figure of tone"), (2, "What is tone?")], [(1, 0, "Tone", ["definition"], 2), (2, 0, "tone", ["example"], 1), (2, 1, "Tone", ["definition"], 2), (7, 0, "Tone", ["definition"], 1)])
    assert {r.query_id: (r.status, r.rules) for r in got.status.collect()} == {1: ("ready", []), 2: ("ready", [])}
    assert sorted((r.query_id, r.place, r.paragraph_id, r.attached) for r in got.context.collect()) == [(1, 1, "p1", False), (1, 2, "p2", True), (2, 1, "p3", False), (2, 2, "p1", False)]
    text = {r.query_id: r.markdown for r in got.markdown.collect()}
    assert text[1] == "\n".join(
        ["# Retrieval Context", "", "## User question", "", "Show a figure of tone", "", "## Concept-role map", "", "### Concept: Tone", "", "- Selected role: definition", "- Paragraphs: [1]", "- Parent chunks: a (rank 2)", "", "## Source paragraphs", ""]
        + ["### [1]", "", "- Source: doc", "- Parent header: A", "- Nested heading: Sub", "- Pages: 4–5", "- Concepts and roles: Tone -> definition", "- Images: none", "", "one two", ""]
    )
    assert text[2].count("### [") == 2 and "\n\n\n" in text[2]  # the null text is an empty one


def test_statuses_and_rules(spark):
    asks = [(1, "q"), (2, "q"), (3, "q"), (4, "q"), (5, "q"), (6, "q"), (9, "q")]
    wrong = [(2, 0, "Drum", ["definition"], 1), (3, 0, "Tone", ["example"], 1), (3, 1, "Reed", ["definition"], 1), (4, 0, "Reed", ["definition"], 1), (5, 0, "Tone", [], 0), (6, 0, "Tone", ["definition"], 1), (6, 1, "Tone ", ["definition", "definition"], 2), (9, 0, "Tone", ["definition"], 1)]
    got = {r.query_id: (r.status, r.rules) for r in _run(spark, asks, wrong).status.collect()}
    assert got == {
        1: ("no_relevant_concept_role", []),
        2: ("refused", ["concept is not offered"]),
        3: ("refused", ["rank given twice", "role is not offered"]),
        4: ("refused", ["first paragraph exceeds the limit"]),
        5: ("refused", ["rank must be positive", "roles must not be empty"]),
        6: ("refused", ["concept selected twice", "roles must be distinct"]),
        9: ("no_retrieval_context", []),
    }
    twice = _run(spark, [(1, "q")], [(1, 0, "Tone", ["definition"], 1)], relations=[("p1", "Tone", "definition"), ("p1", "TONE", "definition")])
    assert twice.status.first().rules == ["relation given twice"] and twice.context.count() == 0


def test_limits_cut_citations(spark):
    relations = [("p1", "Tone", "definition"), ("p2", "Tone", "definition"), ("p4", "Reed", "definition")]
    got = _run(spark, [(1, "q")], [(1, 0, "Tone", ["definition"], 1), (1, 1, "Reed", ["definition"], 2)], relations=relations, words=10)
    assert [r.paragraph_id for r in got.context.orderBy("place").collect()] == ["p1", "p2"]
    assert [(r.concept, r.places) for r in got.roles.collect()] == [("Tone", [1, 2])]
    one = _run(spark, [(1, "q")], [(1, 0, "Tone", ["definition"], 1)], relations=relations, most=1)
    assert [r.places for r in one.roles.collect()] == [[1]]
    with pytest.raises(ValueError):
        _run(spark, [(1, "q")], [(1, 0, "Tone", ["definition"], 1)], most=0)


def test_no_rows(spark):
    got = _run(spark, [(1, "q")], [], hits=())
    assert [r.status for r in got.status.collect()] == ["no_retrieval_context"] and got.markdown.count() == 0


def test_fused_keeps_the_first_lists_metadata(spark):
    schema = "query_id int, chunk_ref string, source_ref string, rank int, score double, metadata struct<n: int>"
    a = spark.createDataFrame([(1, "x", "sem", 1, 0.9, (1,)), (1, "y", "sem", 2, None, (2,))], schema)
    b = spark.createDataFrame([(1, "y", "lex", 1, 0.5, (3,)), (1, "z", "lex", 2, 0.4, (4,)), (2, "z", "lex", 1, 0.4, (5,))], schema)
    got = [(r.query_id, r.chunk_ref, r.source_ref, r.metadata.n, r.semantic_score, r.keyword_score, r["rank"]) for r in questions.fused(a, b, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "y", "sem", 2, None, 0.5, 1), (1, "x", "sem", 1, 0.9, None, 2), (2, "z", "lex", 5, None, 0.4, 1)]


def test_synthesis_is_held_against_the_evidence(spark):
    evidence = spark.createDataFrame([(1, "a", ["x.png"]), (1, "b", None), (2, "c", [])], "run_id int, evidence_id string, image_refs array<string>")
    results = spark.createDataFrame([(1, "Yes", ["a", "b"], ["a", "a"], ["a"]), (2, " ", ["a", "a"], None, ["c", "d"]), (3, None, [], [], [])], "run_id int, answer string, used array<string>, cited array<string>, images array<string>")
    got = sorted((r.run_id, r.evidence_id or "", r.rule) for r in answers.synthesis_violations(results, evidence).collect())
    assert got == [(2, "", "answer is empty"), (2, "a", "used twice"), (2, "a", "used unknown"), (2, "c", "images without a picture"), (2, "d", "images unknown"), (3, "", "answer is empty")]


def test_index_inputs_without_tags(spark):
    tags = spark.createDataFrame([("c1", ["t"], ["p"])], "chunk_id string, tags array<string>, tagged_paragraphs array<string>")
    got = records.index_inputs(spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"), tags, "m", "v")
    assert {r.chunk_id: (r.tags, r.tagged_paragraphs, r.embedding_profile) for r in got.collect()} == {"c1": (["t"], ["p"], "m"), "c2": ([], [], "m")}
