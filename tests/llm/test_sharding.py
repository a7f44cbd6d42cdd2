import random
import zlib

import xxhash

from docquarry.llm.sharding import shard, splitters

SCHEMA = "doc_id long, text string, shard string, slot int, __n int"


def check(rows, got, n):
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return {s: sum(r["size"] for r in got if r.shard == s) for s in range(n)}


def test_sizes_are_near_equal_with_hot_texts_and_long_ones(spark):
    rows = [(i, f"text {i} " * (i % 9 + 1), "x", 1, 2) for i in range(2000)]
    rows += [(5000 + i, "one hot text " * 4, "x", 1, 2) for i in range(1500)]
    rows += [(9000, "long " * 1500, None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (None, "no id", None, None, None), (9003, "ä🙂" * 5, None, None, None)]
    rows += [(7, "again", "x", 1, 2)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = check(rows, shard(df).collect(), 16)
    share, longest = sum(sizes.values()) / 16, 5 * 1500 + 1
    assert all(abs(s - share) <= longest + share / 32 for s in sizes.values())
    assert sorted(map(tuple, shard(df).collect()), key=str) == sorted(map(tuple, shard(df.repartition(7)).collect()), key=str)


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text number {i // 2}", "", 0, 0) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, SCHEMA), 8).collect()
    check(rows, got, 8)
    homes = {}
    for r in got:
        homes.setdefault(r.text, set()).add(r.shard)
    assert max(map(len, homes.values())) == 1


def test_small_and_empty_tables(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None)]
    check(rows, shard(spark.createDataFrame(rows, SCHEMA)).collect(), 16)


def brute(rows, n, slack=1 / 64):
    """All rows in order of (hash, id): each group of equal texts, or row of a hot group, goes where its middle lies."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    keyed = sorted((42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42)), "" if d is None else str(d), len((t or "").encode()) + 1, t) for d, t, *_ in rows)
    share = sum(x[2] for x in keyed) / n
    weight = {}
    for h, _, size, _ in keyed:
        weight[h] = weight.get(h, 0) + size
    out, at, begin, slots = [], 0, {}, [0] * n
    for h, k, size, t in keyed:
        begin.setdefault(h, at)
        middle = begin[h] + weight[h] / 2 if weight[h] <= slack * share else at + size / 2
        s = min(int(middle // share), n - 1)
        out.append((k, str(t), size, s, slots[s]))
        slots[s] += 1
        at += size
    return sorted(out)


def test_equals_brute_force_on_one_and_two_levels(spark):
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(1500)} " * rng.choice([1, 2, 9]), "x", 1, 2) for i in range(3000)]
    rows += [(i, "ä hot text " * 3, "x", 1, 2) for i in range(3000, 3900)] + [(4000, None, "x", 1, 2), (None, "z", "x", 1, 2), (4001, "", "x", 1, 2), (4002, "l" * 3_000_000, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n, options in ((16, {}), (5, {"coarse": 4, "range_bytes": 1 << 12}), (3, {"ranges_per_shard": 40})):
        got = sorted(("" if r.doc_id is None else str(r.doc_id), str(r.text), r["size"], r.shard, r.slot) for r in shard(df, n, **options).collect())
        assert got == brute(rows, n)


def test_splitters_do_not_cut_small_groups(spark):
    df = spark.createDataFrame([(i, f"text {i // 25}") for i in range(4000)], "doc_id long, text string")
    narrow = df.selectExpr("xxhash64(text) AS hash", "cast(doc_id AS string) AS key", "cast(10 AS bigint) AS size")
    hot = narrow.first().hash
    cuts = splitters(narrow, 40000, 300, {hot}, coarse=50)
    assert len(cuts) > 50 and {h for h, k in cuts if k} <= {hot}
    assert shard(df, 4).groupBy("text").agg({"shard": "max"}).count() == 160


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", 2, 3, 4, 5)], "doc_id long, text string, Shard int, `a.b` string, SIZE int, hash int, `rec` int, __n int")
    out = shard(df)
    assert out.columns == ["doc_id", "text", "a.b", "hash", "rec", "__n", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert tuple(out.first())[:6] == (1, "a b", "x", 3, 4, 5)
