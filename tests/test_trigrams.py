import random

from pyspark.sql import functions as F

from docquarry.operators import search
from docquarry.operators.trigrams import TrigramIndex
from docquarry.session import new_path


def rows(spark, n=200):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["Überall", "ISTANBUL", "aaa", "aaaa"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(n)] + [(n, None), (n + 1, "")], words


def test_search_equals_a_scan_for_many_queries(spark):
    data, words = rows(spark)
    df = spark.createDataFrame(data, "chunk_ref long, text string").repartition(3)
    index = TrigramIndex.build(df, F.col("text"), "chunk_ref", new_path(spark, "trigrams"), 4)
    rng = random.Random(3)
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(90, "zzzz nowhere"), (91, "a"), (92, ""), (93, "aaaa aaa aa"), (94, "überall")]
    got = {}
    for r in index.search(spark.createDataFrame(asked, "query_id int, query string"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, round(r.keyword_score, 9)))
    for i, q in rng.sample(asked[:40], 4) + asked[40:]:
        want = [(r["rank"], r.chunk_ref, round(r.keyword_score, 9)) for r in search.lexical_search(df, q, F.coalesce("text", F.lit("")), 7).collect()]
        assert sorted(got.get(i, [])) == want, q


def test_few_texts_are_verified(spark):
    data = [(i, f"common words in every text and number{i:05d}x") for i in range(500)]
    index = TrigramIndex.build(spark.createDataFrame(data, "id long, text string"), F.col("text"), "id", new_path(spark, "trigrams-few"))
    word = spark.createDataFrame([("number00123x",), ("missing",)], "word string")
    assert [tuple(r) for r in index.candidates(word).collect()] != [] and index.candidates(word).count() <= 10


def test_an_empty_index_finds_nothing(spark):
    df = spark.createDataFrame([(1, "")], "id long, text string")
    index = TrigramIndex.build(df, F.col("text"), "id", new_path(spark, "trigrams-empty"))
    assert index.search(spark.createDataFrame([(1, "some words a")], "query_id int, query string"), 5).count() == 0


def test_pairs_of_queries_and_texts_stay_in_their_pack(spark, tmp_path):
    """Twice the texts and queries send twice the rows, not four times: what a pack sends is k rows for each query."""
    data = [(i, f"the 𝒜bc same words for all {i % 7}") for i in range(600)]
    df = spark.createDataFrame(data, "id long, text string").coalesce(1)
    index = TrigramIndex.build(df, F.col("text"), "id", new_path(spark, "trigrams-packs"))
    asked = spark.createDataFrame([(f"q{i}", "the 𝒜bc same 3") for i in range(200)], "query_id string, query string")
    found = index.search(asked, 2)
    assert {(r.query_id, r["rank"], r.key) for r in found.collect()} == {(f"q{i}", n + 1, 3 + 7 * n) for i in range(200) for n in range(2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and plan.count("Join") == 2  # pieces to lists, queries to packs; none of queries with texts
