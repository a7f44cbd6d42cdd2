import random
import re

from docquarry.llm.licenses import NOTICES, TEMPLATES, scan, shingles_of, words_of


def shingles(t):
    w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def found_in(t, notices, share=0.8):
    """Every window of every notice's length with its share, and the words from its first shingle to its last."""
    h, out = shingles(t), set()
    for name, text in notices:
        own = shingles(text)
        for a in range(len(h)) if own else ():
            at = [i for i in range(a, min(len(h), a + len(own))) if h[i] in own]
            part = len({h[i] for i in at}) / len(set(own))
            if part >= share:
                out.add((-part, a, name, at[0], at[-1] + 5))
    return out


def brute(rows, notices=NOTICES):
    out = set()
    for d, t in rows:
        kept = []
        for x in sorted(found_in(t, notices)):
            if not any(k[0] < x[0] and k[3] < x[4] and x[3] < k[4] for k in kept):
                kept.append(x)
        out |= {(d, n, a, round(-v, 9)) for v, a, n, _, _ in kept}
    return out


def texts(rng, notices, count, words):
    for i in range(count):
        body = [f"word{rng.randrange(50)}" for _ in range(rng.randrange(words))]
        for _ in range(rng.randrange(3)):
            n = rng.choice(notices)[1].split()
            if rng.random() < 0.4:
                n = n[rng.randrange(2) : len(n) - rng.randrange(2)]
            if rng.random() < 0.4:
                for _ in range(1 + len(n) // 40):
                    n[rng.randrange(len(n))] = "altered"
            at = rng.randrange(len(body) + 1)
            body[at:at] = n
        yield i, " ".join(body)


def test_equals_brute_force(spark):
    rows = list(texts(random.Random(4), NOTICES, 120, 60))
    rows += [(200, None), (201, ""), (202, "MIT License"), (203, NOTICES[10][1].upper() + " " + " ".join(["x"] * 9000) + " " + NOTICES[12][1]), (204, NOTICES[12][1] * 3), (205, "x " * 300_000 + NOTICES[3][1] + "y" * 2_000_000)]
    d = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, license string, word int, `a.b` int")
    assert {(r.doc_id, r.license, r.word, round(r.share, 9)) for r in scan(d).collect()} == brute(rows)


def test_recall_of_the_bands_on_production_templates(spark):
    """Windows with a share of 0.8 or more, of all templates, that the bands retrieve: all of them here."""
    rows = list(texts(random.Random(8), TEMPLATES, 150, 30))
    got = {(r.doc_id, r.license, r.word, round(r.share, 9)) for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES).collect()}
    want = brute(rows, TEMPLATES)
    assert len(want) > 60 and len(got & want) >= 0.999 * len(want)
    assert len({d for d, *_ in want}) == len({d for d, *_ in got})


def test_texts_made_of_licenses(spark):
    """Windows that reach into the next copy, ties, and better matches beside worse ones: as brute force, whatever the rounds."""
    rng = random.Random(5)

    def many(size):
        out = []
        while sum(map(len, out)) < size:
            w = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(2) * (1 + len(w) // 60)):
                w[rng.randrange(len(w))] = "altered"
            out += ["copyright"] * rng.randrange(3) + w
        return " ".join(out)

    rows = [(1, many(500)), (2, " ".join([NOTICES[0][1]] * 40)), (3, TEMPLATES[15][1] + " " + TEMPLATES[15][1]), (None, many(300)), (5, " ".join([NOTICES[3][1], NOTICES[2][1]] * 20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, TEMPLATES)
    for rounds in (0, 3):
        got = {(r.doc_id, r.license, r.word, round(r.share, 9)) for r in scan(d, TEMPLATES, rounds=rounds).collect()}
        assert got == want


def test_bands_alone_retrieve(spark):
    """One band of one template: a window meets it if the template's least shingle is the window's least."""
    text = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, text), (2, f"zero {text} eleven"), (3, "one two three four five six seven eight other ten")], "doc_id long, text string")
    assert {(r.doc_id, r.word, r.share) for r in scan(d, [("T", text)], bands=1).collect()} >= {(1, 0, 1.0), (2, 1, 1.0)}
    assert scan(d, [("T", text)], share=0.5, bands=40).where("doc_id = 3").count() > 0
    assert len(d.select(shingles_of(words_of(d.text)).alias("h")).first().h) == 6


def test_empty_inputs_and_rows_without_or_with_the_same_id(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert scan(d.limit(0)).count() == 0
    assert scan(d, notices=[("short", "two words")]).count() == 0
    rows = [(None, "Released under the MIT License."), (None, "x Released under the ISC License."), (1, "Released under the MIT License."), (1, "Released under the MIT License.")]
    got = sorted((str(r.doc_id), r.license, r.word) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "MIT", 0), ("None", "ISC", 1), ("None", "MIT", 0)]
