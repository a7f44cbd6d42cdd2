import random
import re

import numpy as np

from docquarry.llm.components import components
from docquarry.llm.near_dedup import block_links, deduplicated, near_duplicates, shingle_sets
from docquarry.llm.skewed import hot_keys, joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed, groups=12):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 40])):
            base = edited(rng, base, rng.choice([0, 0, 1, 2])) if rng.random() < 0.5 else base
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, len(base) // 60, len(base) // 40]))))
    star = [f"s{i}" for i in range(400)]
    texts += [" ".join(edited(rng, star, 5)) for _ in range(60)] + [" ".join(star)]
    texts += ["", None, " \n\t", "One TWO", "one two", "one  two\n", "É a b c d e", "é a b c d e", "x " * 4000, "x " * 3999]
    rng.shuffle(texts)
    return [(1000 + 3 * i, t) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    for seed, options in ((1, {}), (2, {"block": 8, "neighbours": 1, "rows_per_range": 40})):
        rows = corpus(seed)
        d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, component long")
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d, **options).collect())
        assert got == brute(rows)
    want = {r[0] for r in brute(rows) if r[3]}
    assert sorted(r.doc_id for r in deduplicated(d).collect()) == sorted(want)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h"
    d = spark.createDataFrame([(1, text), (1, text), (2, text.upper()), (None, text), (3, None), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(d).collect())
    assert got == [("1", 4, "1", True), ("1", 4, "1", True), ("2", 4, "1", False), ("3", 0, "3", True), ("None", 0, "None", True), ("None", 4, "None", True)]
    assert near_duplicates(d.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 180)} | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_links_join_all_similar_members():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(10**9, 100, replace=False)).astype(np.uint64)
    sets = [(i, i, np.sort(np.concatenate([base[: 100 - i], rng.integers(10**10, 10**11, i, dtype=np.uint64)]))) for i in range(20)]
    links = block_links(sets[:10], sets[10:], 85)
    same = {(a, b) for a in range(10, 20) for b in range(10) if 100 * (100 - a) >= 85 * (100 + a)}
    assert all((a, b) in same for a, b in links) and {a for a, _ in links} == {a for a, _ in same}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rng = random.Random(4)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    near_a, near_b, again = ([*w[:-1], "other"] for w in (a, b, a))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near_a)), (3, " ".join(near_b)), (4, " ".join(again)), (1, " ".join(a))]
    d = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, `Node` int, `a.b` string, kept boolean")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(d).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False)]
    left = deduplicated(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 1, 1]


def test_texts_that_share_a_template_do_not_meet(spark):
    """0.7 similar to each other, linked with nothing, but for two pairs: no comparison of all with all."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base + [f"u{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(1500)]
    texts[1400], texts[77] = texts[3] + " more", texts[76] + " more"
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {d: c for d, c in got.items() if c != d} == {1400: 3, 77: 76}


def test_word_keys_tell_long_words_apart():
    word = "a"
    while len(word) < 2048:  # sums of powers of one number do not tell these apart
        word += word.translate({97: "b", 98: "a"})
    x, y = shingle_sets([word, word.translate({97: "b", 98: "a"})])
    assert len(x) == len(y) == 1 and x[0] != y[0]


def test_texts_that_are_very_long_or_made_of_common_parts(spark):
    rng = random.Random(6)
    parts = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(6)]
    texts = [" ".join(rng.sample(parts, 4)) for _ in range(150)] + ["w " * 300_000 + "x" * 3_000_000, "w " * 200_000 + "x" * 3_000_000]
    rows = list(enumerate(texts))
    for options in ({}, {"block": 4}):
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()) == brute(rows)


def test_joins_of_hot_keys(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60_000)] + [(None, 1)], "k long, v int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (99999, "c")], "k long, w string")
    assert hot_keys(left, "k").collect()[0].k == 1
    for how in ("inner", "left", "left_semi"):
        for r in (right, right.where("k > 1")):
            assert sorted(map(str, joined(left, r, "k", how).collect())) == sorted(map(str, left.join(r, "k", how).collect()))
