from pyspark.sql import functions as F

from docquarry.operators import state

COLUMNS = "entity_key string, record_id string, input_hash string, model string, dimensions int, sync_status string"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select("entity_key", "change", "input_hash").collect())))


def test_changes_equal_the_full_diff_and_read_few_buckets(spark):
    old = [(f"k{i}", f"r{i}", f"h{i}", "m", 2, "synced") for i in range(3000)]
    new = {r[0]: list(r) for r in old}
    new["k5"][2], new["k70"][3] = "other", None
    old[900] = (*old[900][:5], "pending")
    del new["k44"]
    new["k9999"] = ["k9999", "r", "h", "m", 2, "synced"]
    existing, desired = spark.createDataFrame(old, COLUMNS), spark.createDataFrame([tuple(r) for r in new.values()], COLUMNS).drop("sync_status")
    full = state.reconcile(existing, desired).where("change != 'unchanged'")
    kept = state.bucket_digests(existing)
    for digests in (None, kept):
        changes, read = state.changes_by_digest(existing, desired, digests)
        assert rows(changes) == rows(full) and 1 <= read <= 5
    assert {(r.entity_key, r.change) for r in full.collect()} == {("k5", "changed"), ("k70", "changed"), ("k900", "changed"), ("k44", "stale"), ("k9999", "new")}


def test_equal_and_empty_states_read_nothing(spark):
    existing = spark.range(100).select(*[F.concat(F.lit("x"), "id").alias(c) for c in ("entity_key", "record_id", "input_hash", "model")], F.lit(2).alias("dimensions"), F.lit("synced").alias("sync_status"))
    desired = existing.drop("sync_status")
    changes, read = state.changes_by_digest(existing, desired)
    assert read == 0 and changes.count() == 0
    changes, read = state.changes_by_digest(existing.limit(0), desired)
    assert changes.where("change = 'new'").count() == 100 and read > 0
    assert state.changes_by_digest(existing.limit(0), desired.limit(0))[1] == 0
