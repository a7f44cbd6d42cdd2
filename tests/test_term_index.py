import re

import numpy as np
from pyspark.sql import functions as F

from docquarry.operators import term_index
from docquarry.operators.term_index import TermIndex
from docquarry.session import new_path


def test_terms_are_looked_for_in_words_and_sets_are_asked_once(spark):
    """Texts are kept as their different words alone, and a pack answers queries with the same terms once."""
    texts = ["Le café, naïve:the", "the theatre-x_1", None, "x" * 50 + "the", "日本the語", "t h e", ""]
    df = spark.createDataFrame([(f"k{i:04d}", texts[i % 7]) for i in range(700)], "key string, text string").coalesce(1)
    index = TermIndex.build(df, F.col("text"), "key", new_path(spark, "term-index"))
    pack = index.packs.collect()
    assert len(pack) == 1 and "low" not in index.packs.columns
    assert len(pack[0]["ends"]) // 8 == 10  # le café naïve the theatre-x_1 x..the 日本the語 t h e
    def best(q: str, k: int) -> list:
        terms = set(re.findall(r"[\w-]+", q.lower()))
        low = [((texts[i % 7] or "").lower(), f"k{i:04d}") for i in range(700)]
        scored = sorted((-sum(t in x for t in terms) / len(terms), key) for x, key in low if any(t in x for t in terms))
        return [(key, round(-s, 6), n + 1) for n, (s, key) in enumerate(scored[:k])]

    queries = ["the é", "É the", "本t", "e_", "-x_1 heat", "th e", "語 h", "x", "?"]
    several = spark.createDataFrame([(i, queries[i % 9]) for i in range(900)], "query_id int, query string")
    found = index.search(several, 3)
    got = sorted((r.query_id, r.key, round(r.keyword_score, 6), r["rank"]) for r in found.collect())
    assert got == sorted((i, *x) for q in range(9) for x in best(queries[q], 3) for i in range(q, 900, 9))
    assert "__query" not in found._jdf.queryExecution().optimizedPlan().toString().split("CoGroup")[1]  # packs are met by sets alone


def test_packs_and_parts_change_no_result(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 31}é" for j in range(i % 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    asked = spark.createDataFrame([(i, f"w{i % 31} w{i % 7}é é w3") for i in range(40)], "query_id int, query string")
    whole = sorted(map(tuple, TermIndex.build(df, F.col("text"), "id", new_path(spark, "t")).search(asked, 4).collect()))
    monkeypatch.setattr(term_index, "SETS", 9)
    assert sorted(map(tuple, TermIndex.build(df, F.col("text"), "id", new_path(spark, "t")).search(asked, 4).collect())) == whole and len(whole) == 160


def test_small_arrays_change_no_result(monkeypatch):
    words = [w.encode() for w in ("theatre", "the", "aaaa", "é", "caféé", "x")]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    asked = [t.encode() for t in ("the", "atre", "aa", "aaa", "é", "fé", "x", "ex", "zzz", "theatre")]
    want = {(i, j) for i, t in enumerate(asked) for j, w in enumerate(words) if t in w}
    for most in (1 << 22, 1):
        monkeypatch.setattr(term_index, "AT_ONCE", most)
        assert set(zip(*(x.tolist() for x in term_index._held(asked, data, ends)), strict=True)) == want
