import random

from pyspark.sql import functions as F

from docquarry.operators.scan import Fold, numbered, running

FOLDS = {"s": Fold("sum", "v"), "x": Fold("xor", "v"), "lo": Fold("min", "v"), "hi": Fold("max", "v"), "prev": Fold("last", "w")}


def plain(rows):
    """Running values by one loop a key."""
    out = []
    for key in {r[0] for r in rows}:
        s = x = lo = hi = prev = None
        for k, o, v, w in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if v is not None:
                s, x, lo, hi = (v, v, v, v) if s is None else (s + v, x ^ v, min(lo, v), max(hi, v))
            prev = prev if w is None else w
            out.append((k, o, v, w, s, x, lo, hi, prev))
    return out


def test_running_values_of_runs_longer_than_a_partition(spark):
    rng = random.Random(5)
    keys = ["long"] * 600 + [rng.choice(["a", "b", None, "c"]) for _ in range(300)] + [f"k{i}" for i in range(50)]
    rows = [(k, i, rng.choice([None, *range(9)]), rng.choice([None, None, "p", "q"])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v long, w string")
    got = running(df, ["k"], [F.col("o")], FOLDS, partitions=7)
    key = repr
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_a_long_run_lies_in_even_parts(spark):
    df = spark.range(1000).select(F.lit("one").alias("k"), "id")
    parts = running(df, ["k"], [F.col("id")], {"n": Fold("sum", F.lit(1).cast("long"))}, partitions=8)
    assert [r.n for r in parts.orderBy("id").collect()] == list(range(1, 1001))
    from docquarry.operators.scan import ranged

    counts = [r["count"] for r in ranged(df, [F.col("k"), F.col("id")], 8).groupBy("__part").count().collect()]
    assert len(counts) == 8 and max(counts) < 3 * 125


def test_rows_that_tie_wholly_are_split(spark):
    from docquarry.operators.scan import ranged

    counts = [r["count"] for r in ranged(spark.range(1000).select(F.lit(1).alias("k")), [F.col("k")], 8).groupBy("__part").count().collect()]
    assert len(counts) > 3


def test_numbers_are_gapless_in_order(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"))
    assert [(r.v, r.number) for r in numbered(df, [F.col("v").desc()], partitions=6).collect()] != []
    assert sorted((r.number, r.v) for r in numbered(df, [F.col("v").desc()], partitions=6).collect()) == [(i, 499 - i) for i in range(500)]
    assert numbered(df.where("v < 0"), [F.col("v")]).count() == 0
