import numpy as np
import pytest

from docquarry.llm.mixing import mix, mixed_texts, permuted, repeated, shard_draws, source_targets


def test_targets():
    t = source_targets({"b": 100, "a": 1000, None: 50, "c": 0})
    assert sum(t.values()) == pytest.approx(1.5 * 1150) and list(source_targets({"a": 1, "é": 1, "b": 1})) != [] and t["c"] == 0
    assert all(t[s] <= 2 * z + 1e-9 for s, z in {"b": 100, "a": 1000, None: 50, "c": 0}.items())
    assert t["b"] == 200 or t["b"] < 200
    assert source_targets({}) == {}


def test_permutations_are_onto():
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 2, -5):
            out = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out) == list(range(n))
    assert permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()


def test_draws_sum_to_slots():
    slots = np.array([1000, 3, 0, 40])
    d = shard_draws(slots, 7, 1)
    assert d.sum(0).tolist() == slots.tolist() and (d >= 0).all() and d.sum(1).max() - d.sum(1).min() <= 1


ROWS = [(i, " ".join(f"w{i}_{j}" for j in range(i % 37)), ["a", "b", "é", None][i % 4], "clash", 1) for i in range(300)]
ROWS += [(1000, None, "a", None, None), (1001, " \n", None, None, None), (1002, "x " * 5000, "z", None, None), (5, "five again", "b", None, None), (None, "no id here", "b", None, None)]
SCHEMA = "doc_id long, text string, source string, taken string, size int"


def test_taken_meets_targets(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = mix(df, block=16).documents.collect()
    assert len(got) == len(ROWS)
    words = sorted((str(r[0]), len((r[1] or "").split())) for r in ROWS)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == words
    total = sum(w for _, w in words)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 17
    again = mix(df.repartition(5), block=16).documents.collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_texts_of_the_mix_hold_the_taken_words(spark):
    rows = [r for r in ROWS if r[0] not in (5, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = mix(df, block=16, n_shards=5)
    taken = {r.source: 0 for r in m.documents.collect()}
    for r in m.documents.collect():
        taken[r.source] += r.taken
    words = dict.fromkeys(taken, 0)
    for r in mixed_texts(df, m).collect():
        words[r.source] += len(r.text.split())
        assert 0 <= r.shard < 5
    assert words == taken


def test_repeated_documents_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = repeated(df)
    assert out.columns == df.columns and out.where("doc_id = 1001").count() == 1
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in ROWS}
    assert mix(df.limit(0)).documents.count() == 0 and repeated(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix(df, max_sources=2)


def brute_targets(sizes, weights=(3, 1, 2)):
    """Pour 150% of all sizes by weight in small steps, into sources that are not full."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s))) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    got, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in order if got[s] < 2 * sizes[s] - 1e-9]
        step = min([left / sum(weight[s] for s in free), *((2 * sizes[s] - got[s]) / weight[s] for s in free)])
        for s in free:
            got[s] += step * weight[s]
        left -= step * sum(weight[s] for s in free)
    return got


def test_mix_equals_brute_force(spark):
    """Targets by pouring; pieces tile documents and blocks; slots visit each block once a pass; what each
    document gives is counted word by word."""
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA)
    m = mix(df, block=16, n_shards=7)
    docs = {r.doc_id: r for r in m.documents.where("doc_id <> 5").collect()}
    sizes = {r.source: r.source_size for r in docs.values()}
    assert {s: pytest.approx(t) for s, t in brute_targets(sizes).items()} == {r.source: r.target for r in docs.values()}
    name = {r.sid: r.source for r in m.sources.collect()}
    words, owner = {}, {}
    for p in m.pieces.collect():
        for j in range(p.n):
            place = (p.sid, p.block, p.offset + j)
            assert place not in owner
            owner[place] = p.doc_id
            words.setdefault(p.doc_id, []).append(p.start + j)
    assert all(sorted(words.get(d, [])) == list(range(r["size"])) for d, r in docs.items())
    taken, visits = {}, {}
    for s in m.slots.collect():
        visits.setdefault(s.sid, {}).setdefault(s.slot, s.block)
        for j in range(s.words):
            if (s.sid, s.block, j) in owner:
                d = owner[s.sid, s.block, j]
                taken[d] = taken.get(d, 0) + 1
    assert all(taken.get(d, 0) == r.taken for d, r in docs.items())
    for sid, by_slot in visits.items():
        n = -(-sizes[name[sid]] // 16)
        order = [by_slot[i] for i in range(len(by_slot))]
        for a in range(0, len(order), n):
            part = order[a : a + n]
            assert len(set(part)) == len(part) and (len(part) < n or sorted(part) == list(range(n)))


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4), (2, "c d e f", "t", 1, 2, 3, 4), (None, "g h", "t", 1, 2, 3, 4), (None, "i j", "t", 1, 2, 3, 4)], "doc_id long, text string, source string, `a.b` int, __n int, N int, Rec int")
    out = repeated(df)
    assert out.columns == df.columns and out.count() >= 4
    assert sum(r["size"] for r in mix(df).documents.collect()) == 10
