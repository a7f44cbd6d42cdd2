import os

import pytest

from docquarry.sources import artifacts


def rows(spark, *r):
    return spark.createDataFrame([*r], artifacts.SCHEMA)


def found(spark, root):
    return {r.path: bytes(r.content) for r in artifacts.contents(artifacts.listed(spark, root), root).collect() if r.intact}


def test_put_get_replace_and_delete(spark, tmp_path):
    root = str(tmp_path / "store")
    assert found(spark, root) == {}
    artifacts.put(rows(spark, ("a", b"one", None), ("b", b"two", None), ("copy", b"one", None), ("empty", b"", None)), root)
    assert found(spark, root) == {"a": b"one", "b": b"two", "copy": b"one", "empty": b""}
    assert sum(len(f) for _, _, f in os.walk(f"{root}/objects")) == 3 and artifacts.unreferenced(spark, root).count() == 0
    artifacts.put(rows(spark, ("b", b"three", None), ("a", None, None), ("unknown", None, None)), root)
    assert found(spark, root) == {"b": b"three", "copy": b"one", "empty": b""}
    assert artifacts.unreferenced(spark, root).count() == 1
    artifacts.put(rows(spark), root)
    assert len(os.listdir(f"{root}/commits")) == 2


def test_a_wrong_digest_fails_the_whole_commit(spark, tmp_path):
    root = str(tmp_path / "store")
    artifacts.put(rows(spark, ("a", b"one", None)), root)
    for bad in [("x", b"two", "0" * 64), (None, b"two", None)]:
        with pytest.raises(Exception, match="checksum of x differs|without a path"):
            artifacts.put(rows(spark, *[(f"p{i}", b"%d" % i, None) for i in range(50)], bad).repartition(5), root)
        assert found(spark, root) == {"a": b"one"} and os.listdir(f"{root}/commits") == ["1.json"]
    with pytest.raises(ValueError, match="several contents"):
        artifacts.put(rows(spark, ("a", b"x", None), ("a", b"y", None)), root)
    artifacts.put(rows(spark, ("a", b"x", None), ("a", b"x", None)), root)
    assert found(spark, root) == {"a": b"x"}


def test_a_damaged_content_is_told(spark, tmp_path):
    root = str(tmp_path / "store")
    artifacts.put(rows(spark, ("a", b"one", None), ("b", b"two", None)), root)
    sha = artifacts.listed(spark, root).where("path = 'a'").first().sha256
    place = f"{root}/objects/{sha[:2]}/{sha}"
    with open(place, "wb") as f:
        f.write(b"eno")
    crc = f"{root}/objects/{sha[:2]}/.{sha}.crc"
    assert not os.path.exists(crc)
    got = {r.path: r.intact for r in artifacts.contents(artifacts.listed(spark, root), root).collect()}
    assert got == {"a": False, "b": True}
