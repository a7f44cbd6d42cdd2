import math
import random
import shutil
from collections import Counter

import pytest

import corpus_pipeline
from docquarry.llm import toxicity
from docquarry.llm.mixing import mix
from docquarry.llm.near_dedup import near_duplicates
from tests.llm.test_decontam import brute as item_brute
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_sharding import brute as shard_brute

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given, and gave."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.saved(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs, calm, single, clean, mixed, sharded = stages
    gone = set(ids(docs)) - set(ids(calm))
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    assert gone and len(gone & toxic) >= 0.6 * len(toxic)
    assert ids(single) == sorted(r.doc_id for r in near_duplicates(calm).where("kept").collect())
    assert set(ids(clean)) < set(ids(single))
    assert set(ids(mixed)) <= set(ids(clean))
    assert ids(sharded) == ids(mixed)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    assert key(got) == key(stages[-1])


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path)


def odd_tables(spark, path):
    """Nulls, empties, ties, repeated rows and ids, a very long text, and columns whose names meet others."""
    rng = random.Random(9)
    words = [f"wort{i}" for i in range(900)]
    item = " ".join(f"bench{i}" for i in range(14))
    docs, labels = [], []
    for i in range(240):
        w = rng.choices(words, k=rng.randrange(20, 70))
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["schuft", "knave", "villain"]))
        docs.append([i, " ".join(w), ["a", "b", None][i % 3]])
        labels.append((i, None, int(toxic)))
    docs += [[300, docs[1][1], "a"], [301, docs[2][1] + " more", "b"], [302, f"begin {item} end", "a"], [303, "long " * 300_000 + "x" * 2_000_000, "b"]]
    docs += [[304, None, "a"], [305, "", None], [306, " \n", "b"], [None, "no id but words", "a"], [None, None, None], [5, docs[5][1], "b"], [6, "another text of the same id", "a"]]
    rows = [(*d, 7, "x", 1, 2, 3, 4, 5, 6) for d in docs]
    names = "doc_id long, text string, source string, Shard int, `a.b` string, __n int, __score int, q_bars int, Hits int, rec int, component_id int"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, f"Bench {item.upper()}"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_equal_brute_force_on_odd_tables(spark, tmp_path):
    odd_tables(spark, tmp_path)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    row = lambda r: (r.doc_id, r.text)
    pairs = lambda df: sorted(map(row, df.select("doc_id", "text").collect()), key=str)

    calm = corpus_pipeline.saved(stage["toxicity"](spark, given, str(tmp_path)), "test-odd")
    scores = toxicity.tag(given, toxicity.train(given, labels)).select("rec.doc_id", "rec.text", "score").collect()
    assert pairs(calm) == sorted((row(r) for r in scores if r.score < 0.7), key=str)
    gone = {r.doc_id for r in scores if r.score >= 0.7}
    assert len(gone & set(range(0, 240, 4))) >= 57 and len(gone - set(range(0, 240, 4))) <= 3

    single = corpus_pipeline.saved(stage["near_dedup"](spark, calm, str(tmp_path)), "test-odd")
    some = [x for x in pairs(calm) if x[0] not in (None, 6)]  # a row without id stays, an id with two texts too
    kept = {d for d, _, _, k in near_brute(list(dict.fromkeys(some))) if k}
    assert pairs(single) == sorted((x for x in pairs(calm) if x[0] in kept or x[0] in (None, 6)), key=str)

    clean = corpus_pipeline.saved(stage["decontamination"](spark, single, str(tmp_path)), "test-odd")
    bad = [hit for *_, hit in item_brute_rows(pairs(single), [tuple(r) for r in items.collect()])]
    assert pairs(clean) == [x for x, hit in zip(pairs(single), bad, strict=True) if not hit] and sum(bad) == 1

    mixed = corpus_pipeline.saved(stage["mixing"](spark, clean, str(tmp_path)), "test-odd")
    taken = {}
    for r in mix(clean).documents.collect():
        t, z = taken.get(r.doc_id, (0, 0))
        taken[r.doc_id] = (t + r.taken, z + r["size"])
    before, after = Counter(pairs(clean)), Counter(pairs(mixed))
    assert set(after) <= set(before)
    for x, n in before.items():
        t, z = taken[x[0]]
        assert after[x] in ({n * math.floor(t / z), n * math.ceil(t / z)} if z else {n}), x

    sharded = stage["sharding"](spark, mixed, str(tmp_path))
    got = sorted(("" if r.doc_id is None else str(r.doc_id), str(r.text), r["size"], r.shard, r.slot) for r in sharded.collect())
    assert got == shard_brute(pairs(mixed), 16)
    assert mixed.columns == given.columns
    assert sharded.columns == [c for c in given.columns if c != "Shard"] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def item_brute_rows(docs, items):
    return [next(iter(item_brute([d], items))) for d in docs]
