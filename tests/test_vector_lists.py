import numpy as np

from docquarry.operators import search
from docquarry.operators.vector_lists import VectorLists
from docquarry.session import new_path


def vectors(spark, n=600, groups=12, dim=16):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(groups, dim))
    x = c[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * 0.15
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(n + i, x[3].tolist(), "copy") for i in range(20)] + [(n + 20, [0.0] * dim, "zero"), (n + 21, None, "none")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string").repartition(4), x


def test_lists_give_what_a_scan_gives_and_skip_most(spark):
    index, x = vectors(spark)
    lists = VectorLists.build(index, new_path(spark, "lists"), 24)
    whole = index.where("embedding IS NOT NULL")
    read = []
    for q in [x[0], x[3], -x[5], np.ones(16), np.zeros(16)]:
        for k in (1, 15, 40):
            found = lists.topk(q.tolist(), k)
            want = search.vector_topk(whole, q.tolist(), k)
            assert [(r.vec_id, round(r.distance, 9)) for r in found.rows.collect()] == [(r.vec_id, round(r.distance, 9)) for r in want.collect()]
            read.append(found.lists_read / found.lists)
    assert np.mean(read[:6]) < 0.4
    assert lists.topk(x[0].tolist(), 10_000).rows.count() == whole.count() and lists.topk(x[0].tolist(), 0).rows.count() == 0


def test_an_empty_index(spark):
    index, x = vectors(spark)
    lists = VectorLists.build(index.limit(0), new_path(spark, "no-lists"))
    assert lists.topk(x[0].tolist(), 3).rows.count() == 0


def test_every_row_as_a_query_in_small_blocks(spark):
    index, x = vectors(spark, 150)
    queries = index.selectExpr("vec_id AS query_id", "embedding")
    plain = search.batch_topk(index, queries, 4, exclude_self=True)
    small = search.batch_topk(index, queries, 4, exclude_self=True, query_rows=20, index_rows=33)
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())
    got = rows(small)
    assert got == rows(plain) and len(got) == 4 * 171
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mine = [g for g in got if g[0] == 7]
    d = sorted((round(1 - float(np.clip(u[7] @ v, -1, 1)), 9), i) for i, v in enumerate([*u, *[u[3]] * 20]) if i != 7)
    assert [(g[3], g[2]) for g in mine] == d[:4]
    assert search.batch_topk(index, queries.limit(0), 4).count() == 0 == search.batch_topk(index, queries, 0).count()
