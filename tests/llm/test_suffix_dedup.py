import hashlib
import random

import numpy as np
import pytest

from docquarry.llm.suffix_dedup import least_of_equals, remove_repeats, suffix_order


def brute(rows, width):
    """Rows by a dictionary of all strings of that width."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            first[b[p : p + width]] = min(i, first.get(b[p : p + width], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("width", [1, 3, 4, 10, 50, 1000])
def test_suffixes_come_in_order(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 100, 101, 102, 999):
        for most in (2, 5, 300):
            s = rng.integers(1, most, n)
            if n > 60:
                s[n // 2 :] = s[: n - n // 2]
            order = suffix_order(s, width)
            assert sorted(order.tolist()) == list(range(n))
            heads = [tuple(s[i : i + width]) for i in order]
            assert heads == sorted(heads)


def test_equal_strings_get_the_least_owner():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\x00\xff") for _ in range(rng.randrange(5, 40))).encode("latin-1") for _ in range(60)]
    owner = np.array([rng.randrange(1000) for _ in texts])
    want = {}
    for t, o in zip(texts, owner.tolist(), strict=True):
        for p in range(len(t) - 5):
            want[t[p : p + 6]] = min(o, want.get(t[p : p + 6], o))
    assert least_of_equals(texts, owner, 6).tolist() == [want[t[p : p + 6]] for t in texts for p in range(len(t) - 5)]


def cases():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(n) for n in (8, 12, 60, 200)]
    rows = []
    for i in range(150):
        t = prose(rng.randrange(60))
        if rng.random() < 0.5:
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t = t + p[a : a + rng.randrange(len(p))] + prose(rng.randrange(20))
        rows.append((rng.randrange(1000), t))
    copies = prose(80)
    rows += [(i, copies) for i in range(2000, 2040)] + [(i, copies[:-1] + "!") for i in range(2040, 2050)]
    rows += [(3000, "a" * 300), (3001, "b" + "a" * 120), (3002, "ab" * 200), (3003, "x" * 49), (3004, "x" * 49), (3005, "y" * 50), (3006, "y" * 50), (3007, None), (3008, ""), (None, copies), (None, None), (2001, passages[3]), (2001, passages[3])]
    return rows


@pytest.mark.parametrize("width, pack", [(50, 4000), (50, 1 << 21), (12, 3000)])
def test_rows_equal_brute_force(spark, width, pack):
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, pack int, `kept.x` string").repartition(5)
    got = remove_repeats(df, width, bytes_per_pack=pack, with_kept=True).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got))) == sorted(map(repr, brute(rows, width)))


def test_empty_tables(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sorted(tuple(r)[:4] for r in remove_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
