import hashlib
import random
import re

from docquarry.llm.decontam import clean, decontaminate, summary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, w=10):
    windows = {}
    for i, t in items:
        words = WORD.findall(lower(t))
        for a in range(max(1, len(words) - w + 1)) if words else ():
            windows.setdefault(tuple(words[a : a + w]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        words = WORD.findall(lower(t))
        hit, ids = set(), set()
        for win, own in windows.items():
            for a in range(len(words) - len(win) + 1):
                if tuple(words[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    ids |= own
        out.append((d, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "ça", "des", "x9", "im", "the"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 14, 25])))) for i in range(25)]
    items += [(None, "one of no name here"), (7, "Seven again; SEVEN! again"), (100, None), (101, "  ,, ")]
    docs = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(90 + i, f"pre fix {items[i][1].upper()} ... and {items[(i + 3) % 25][1]} end") for i in range(25)]
    docs += [(200, None), (201, ""), (202, "one, of no-name here"), (203, "seven again seven again"), (90, docs[40][1]), (None, "seven again seven again"), (204, "the " * 3000 + items[5][1])]
    return docs, items


def test_equals_brute_force_for_one_and_for_many_blocks(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, __items_n string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (1 << 24, 200):
        assert sorted((tuple(r) for r in summary(decontaminate(d, b, block_bytes=size)).collect()), key=str) == want


def test_empty_tables_and_clean(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert summary(decontaminate(d.limit(0), b)).count() == 0
    none = summary(decontaminate(d, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert sorted((r.doc_id, r.n_words) for r in none if r.doc_id is not None) == sorted((x[0], x[1]) for x in brute(docs, []) if x[0] is not None)
    assert sorted(map(str, clean(d, b).collect())) == sorted(f"Row(doc_id={x[0]!r}, text={t!r})" for x, t in ((next(y for y in brute([q], items)), q[1]) for q in docs) if not x[5])


def test_columns_of_any_name_and_a_long_text(spark):
    text = "word " * 400_000 + "seven again seven again " + "z" * 2_000_000
    d = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, "clean", 1, 2, 3, 4)], "doc_id long, text string, `a.b` int, __hits int, Hits int, rec int")
    b = spark.createDataFrame([(7, "Seven again; SEVEN! again", 1)], "item_id long, text string, `x.y` int")
    got = clean(d, b)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "clean", 1, 2, 3, 4)]
    assert clean(d, b.limit(0)).columns == d.columns and clean(d, b.limit(0)).count() == 2
    assert [(r.doc_id, r.n_words, r.n_hit) for r in summary(decontaminate(d, b)).orderBy("doc_id").collect()] == [(1, 400_005, 4), (2, 1, 0)]
