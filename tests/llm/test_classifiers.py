import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import quality, toxicity
from docquarry.llm.labelled import fold, training_ids


def held_out(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_folds_and_sample(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(5, 0, 1), (None, 1, 1), (7, None, 0)], "doc_id long, toxic int, quality int")
    got = labels.where("doc_id is not null").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()
    assert all((r.f == 1) == held_out(r.doc_id) for r in got)
    ids, total = training_ids(labels, "toxic", {1: 10, 0: 1000})
    rows = {r.doc_id: r.y for r in ids.collect()}
    assert not any(held_out(d) for d in rows) and sum(rows.values()) == 10 and total[0] + total[1] == sum(not held_out(i) for i in range(300))


def brute_marginals(model, u):
    n, z, out = len(u), 0.0, np.zeros(len(u))
    for path in itertools.product((0, 1), repeat=n):
        s = -4.0 * path[0]
        for i, y in enumerate(path):
            s += u[i] * y + (model.move[path[i - 1], y] if i else 0.0)
        z += math.exp(s)
        out += math.exp(s) * np.array(path)
    return out / z


def test_runs_of_plain_tokens_are_exact():
    rng = np.random.default_rng(0)
    for trial in range(20):
        model = toxicity.Crf({}, np.zeros(0), float(rng.normal()), rng.normal(size=(2, 2)))
        model.prepare()
        n = int(rng.integers(1, 11))
        places = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
        scores = rng.normal(0, 3, len(places)).tolist()
        u = np.full(n, model.bias)
        u[places] = scores
        assert np.allclose(model.marginals(places, scores, n), brute_marginals(model, u)[places], atol=1e-9), trial


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"wort{rng.randrange(900)}" for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Schuft", "villain", "knave!"]))
        bad = rng.random() < 0.3
        docs.append((i, " ".join(w + ("$$$" if bad else "") for w in words), "clash", 0.0))
        labels.append((i, int(not bad), toxic))
    return docs, labels


EDGE = [(9000, None, None, None), (9001, "", None, None), (9002, " \n", None, None), (9003, "x " * 40000 + "villain knave", None, None), (None, "villain knave villain", None, None), (3, "same id", None, None)]


def tagged(d, model):
    return toxicity.tag(d, model).select("rec.doc_id", "rec.text", "score", "spans").collect()


def scored(d, model):
    return quality.score(d, model).select("rec.doc_id", "rec.text", "score").collect()


def test_toxicity_is_learnt_and_spans_are_in_place(spark):
    docs, labels = corpus(500)
    d = spark.createDataFrame([(*x, 1, 2) for x in docs + EDGE], "doc_id long, text string, label string, score double, `a.b` int, Spans int")
    l = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, l)
    rows = tagged(d, model)
    assert len(rows) == len(docs) + len(EDGE)
    truth = {i: t for i, _, t in labels}
    tested = [(r["score"] >= 0.7, truth[r.doc_id]) for r in rows if r.doc_id in truth and held_out(r.doc_id) and r.text != "same id"]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)
    for r in rows:
        assert 0 <= r["score"] <= 1
        for s in r["spans"]:
            assert any(w in r.text[s.start : s.end].lower() for w in ("schuft", "villain", "knave"))
    again = {str(r.doc_id) + str(r.text): r["score"] for r in tagged(d.repartition(3), toxicity.train(d.repartition(2), l))}
    assert all(abs(again[str(r.doc_id) + str(r.text)] - r["score"]) < 1e-9 for r in rows)
    assert toxicity.accepted(d, l).columns == d.columns


def test_document_scores_equal_a_plain_forward_backward(spark):
    """Every token a step, in log space; features, emissions and the document's fit from the model's numbers."""
    docs, labels = corpus(300, 4)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r["score"] for r in tagged(d, model)}
    for i, text, *_ in docs[:60]:
        words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
        sets = [[model.features[f] for f in toxicity.word_features(w) if f in model.features] for w in words]
        u = [model.bias + sum(model.weights[f] for f in fs) for fs in sets]
        a = [np.array([0.0, -4.0 + u[0]])]
        for x in u[1:]:
            a.append(np.array([np.logaddexp(a[-1][0] + model.move[0, y], a[-1][1] + model.move[1, y]) + x * y for y in (0, 1)]))
        b = [np.zeros(2)]
        for x in u[:0:-1]:
            b.append(np.array([np.logaddexp(model.move[y, 0] + b[-1][0], model.move[y, 1] + x + b[-1][1]) for y in (0, 1)]))
        p = [1 / (1 + math.exp((f + g)[0] - (f + g)[1])) for f, g in zip(a, b[::-1], strict=True)]
        some = [v for v, fs in zip(p, sets, strict=True) if fs]
        z = np.dot(model.calibration, [1.0, math.log1p(sum(some)), math.log(sum(some) / len(words) + 1e-4), max(some, default=0.0)])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_copies_share_a_weight():
    text = " ".join(f"w{i}" for i in range(60))
    assert toxicity.copy_weights([text, "other words here", text + " more", "", text]) == [1 / 3, 1, 1 / 3, 1, 1 / 3]


def test_the_sample_is_bounded_by_bytes(spark):
    docs, labels = corpus(200, 7)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.train(d, l, most_bytes=1).constant is None
    assert toxicity.train(d, l, most_bytes=5000).calibration.tolist() != toxicity.train(d, l).calibration.tolist()


def plain_statistics(t):
    t = t or ""
    w, lines = re.split(r"[\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
    w = [x for x in w if x]
    over = lambda a, b: a / b if b else 0.0
    kinds = [unicodedata.category(c) for c in t]
    symbols = sum(k[0] not in "LN" and c not in " \t\n\v\f\r" for c, k in zip(t, kinds, strict=True))
    return [
        math.log1p(len(w)), over(len(t), len(w)), over(symbols, len(t)), over(kinds.count("Lu"), len(t)), over(sum(k[0] == "N" for k in kinds), len(t)), over(len(set(w)), len(w)),
        over(len(set(lines)), len(lines)), over(len(w), len(lines)), over(len(re.findall(r"[.!?](?=[ \t\n\v\f\r]|$)", t)), len(w)), over(t.count("|"), len(w)),
    ]


def test_quality_rules_are_learnt_and_equal_plain_ones(spark):
    docs, labels = corpus(500, 2)
    odd = [(9100, "É!! 12 | ab. cd?\nx\n\nx 😀|", None, None), (9101, "a.\t\u00a0b", None, None)]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs + EDGE + odd], "doc_id long, text string, q_bars string, score double, `a.b` int, Q int, __n int")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(d, l)
    assert 0 < len(model.rules) < 60
    rows = scored(d, model)
    truth = {i: q for i, q, _ in labels}
    tested = [((r["score"] >= 0.5), truth[r.doc_id]) for r in rows if r.doc_id in truth and held_out(r.doc_id) and r.text != "same id"]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        x = plain_statistics(r.text)
        z = model.constant + sum(w for rule, w in model.rules if all((x[j] > cut) == above for j, above, cut in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9, r.text
    assert [f.name for f in quality.score(d, model).schema["rec"].dataType] == d.columns
    got = d.select(quality.statistics(F.col("text")).alias("q"), "text").select("q.*", "text").collect()
    assert all(np.allclose([r[n] for n in quality.NAMES], plain_statistics(r.text)) for r in got)


def test_no_labels_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    for l in (none, one):
        assert all(0 <= r["score"] <= 1 for r in tagged(d, toxicity.train(d, l)))
        assert all(0 <= r["score"] <= 1 for r in scored(d, quality.train(d, l)))
    model = toxicity.train(d, none)
    assert toxicity.tag(d.limit(0), model).count() == 0
    assert toxicity.train(d.limit(0), one).constant is not None
