import hashlib
import re

from docquarry.llm.exact_dedup import DigestIndex, deduplicate, digested, length_bands, winners
from docquarry.session import new_path

SCHEMA = "doc_id long, text string, digest string, n int"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d))
    keep = {k: min(v, key=lambda x: (x[0], x[1] is None, x[1] or 0))[1] for k, v in groups.items()}
    return sorted(((d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows), key=str)


ROWS = [(i, f"text {i % 40}" + " " * (i % 3) + "\n\t"[: i % 2], "clash", 0) for i in range(300)]
ROWS += [(400, None, None, None), (401, "", None, None), (402, " \r\n", None, None), (403, "a b", None, None), (404, "a b", None, None), (405, "é" * 50000, None, None), (403, "ab", None, None), (None, "x y", None, None), (500, "xy", None, None)]
ROWS += [(1000 + i, "hot", None, None) for i in range(500)]


def test_equals_brute_force(spark):
    got = deduplicate(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_persists_and_takes_only_new_digests(spark):
    path = new_path(spark, "index-test")
    index = DigestIndex(spark, path, 4)
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    deduplicate(df, index)
    again = DigestIndex(spark, path, 4)
    more = spark.createDataFrame([(3, "a  b"), (4, "d"), (5, "d ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(more, again).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert again.table().count() == 3
    plan = again.unseen(winners(digested(more)))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 2


def test_bands_of_length_keep_the_longest_and_meet_the_index(spark):
    rows = [(i, "a b c" + " " * (i % 50), "x", 0) for i in range(200)] + [(300 + i, f"t{i}" * (i + 1), "x", 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bands in (1, 3, 7):
        got = deduplicate(df, bands=bands).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    digests = digested(df)
    index = DigestIndex(spark, new_path(spark, "index-test"), 4)
    fresh = []
    for band in length_bands(digests, 4):
        unseen = index.unseen(winners(digests.where(band)))
        fresh.append((winners(digests.where(band)).count(), unseen.count()))
        index.append(unseen)
    assert sum(n for _, n in fresh) == 51 and any(n < all_ for all_, n in fresh[1:])
    index.close()
    assert not spark.catalog.tableExists(index.name)
    assert sum(df.count() for df in (digests.where(b) for b in length_bands(digests, 4))) == 250


def test_any_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "a ", 1, 2, 3)], "doc_id long, text string, `a.b` int, Keep_id int, __n int")
    assert sorted((r.doc_id, r.keep_id) for r in deduplicate(df).collect()) == [(1, 2), (2, 2)]
