"""Versioned Parquet tables: upserts and several tables committed at once.

A table is a folder of version folders; a commit writes new versions and then one manifest that names the
current version of every table. Readers see the manifest's versions, so a commit over several tables shows
whole or not at all. A table that is upserted by key lies in buckets of its key, each with a version of its own,
so that a commit reads and writes only the buckets that its rows touch. A table in layers takes a commit's new rows
and the keys whose older rows go as one more layer, so that a commit writes what changed and nothing else; once the
layers from the first that takes keys away outweigh those before it, all become one. There is one writer at a time (the
driver); a commit that finds its number taken is an error, but two that begin at the same moment are told apart
only where the file system's rename refuses an existing target. All access is by Hadoop's file system, so the
root can be in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.operators.state import upserted


BUCKETS = 64
#: As many layers at most, however light the later ones are.
LAYERS = 24
#: Of the files of layers, which hold texts.
CODEC = "zstd"
#: The rows of the touched buckets, and the new ones, to what these buckets hold then.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: list[tuple[DataFrame, str, str, list[str], dict[str, str]]] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self) -> dict:
        """number, and for each table its version and schema."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{numbers[-1]:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str) -> DataFrame:
        entry = self.manifest()["tables"].get(name)
        if entry is None:
            raise KeyError(name)
        if "layers" in entry:
            return self._stacked(name, entry)
        return self._parts(name, entry, entry["parts"].keys()) if "parts" in entry else self._folders(name, entry, [entry["version"]])

    def _folders(self, name: str, entry: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    def _parts(self, name: str, entry: dict, buckets) -> DataFrame:
        return self._folders(name, entry, sorted(entry["parts"][b] for b in buckets if b in entry["parts"]))

    def _merged(self, name: str, entry: dict | None, rows: DataFrame, key: list[str], merge: Merge) -> dict:
        """The table's entry after ``rows`` were merged into the buckets that they touch."""
        bucketed = entry is not None and entry.get("key") == key
        if entry is not None:  # a key's bucket depends on its type
            kinds = StructType.fromJson(entry["schema"])
            rows = rows.withColumns({k: F.col(k).cast(kinds[k].dataType) for k in key})
        touched = [str(r[0]) for r in rows.select(_bucket(key)).distinct().collect()]  # at most BUCKETS
        if entry is None:
            old = rows.limit(0)
        else:
            old = self._parts(name, entry, touched) if bucketed else self.read(name)
        new, version = merge(old, rows), uuid.uuid4().hex
        folder = f"{self.root}/{name}/{version}"
        new.withColumn("_bucket", _bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        parts = {b: p for b, p in entry["parts"].items() if b not in touched} if bucketed else {}
        for f in self._fs.listStatus(self._path(folder)):
            if (leaf := f.getPath().getName()).startswith("_bucket="):
                parts[leaf.split("=")[1]] = f"{version}/{leaf}"
        return {"key": key, "parts": parts, "schema": json.loads(new.schema.json())}

    def _stacked(self, name: str, entry: dict) -> DataFrame:
        """The rows of all layers, without those whose key a later layer took away."""
        schema, layers = StructType.fromJson(entry["schema"]), entry["layers"]
        reads = [self._read(name, x["rows"], schema, entry.get("made", {})).withColumn("__layer", F.lit(i)) for i, x in enumerate(layers)]
        keys = StructType([schema[k] for k in entry["key"]])
        gone = [self.spark.read.schema(keys).parquet(f"{self.root}/{name}/{x['gone']}").withColumn("__upto", F.lit(i)) for i, x in enumerate(layers) if x["gone"]]
        rows = reduce(DataFrame.unionByName, reads)
        if not gone:
            return rows.drop("__layer")
        last = reduce(DataFrame.unionByName, gone).groupBy(*entry["key"]).agg(F.max("__upto").alias("__upto"))
        kept = rows.join(last, entry["key"], "left").where(F.col("__upto").isNull() | (F.col("__layer") >= F.col("__upto")))
        return kept.select(*schema.names)

    def _read(self, name: str, folder: str, schema: StructType, made: dict[str, str]) -> DataFrame:
        """A folder's rows; columns that are not in its files are made from the others."""
        rows = self.spark.read.schema(StructType([f for f in schema if f.name not in made])).parquet(f"{self.root}/{name}/{folder}")
        return rows.select(*(F.expr(made[f.name]).cast(f.dataType).alias(f.name) if f.name in made else f.name for f in schema))

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def _made(self, name: str, made: dict[str, str] | None) -> dict[str, str]:
        """What a layer of the table leaves out: as its other layers do."""
        entry = self.manifest()["tables"].get(name)
        return (made or {}) if entry is None else {c: x for c, x in (made or {}).items() if entry.get("made", {}).get(c) == x}

    def staged(self, name: str, rows: DataFrame, beside: list[str] | None = None, made: dict[str, str] | None = None) -> DataFrame:
        """``rows`` written where a layer of ``name`` lies: a commit that gets the result as a layer's rows takes the
        files as they are. Until then they are no part of the table. The columns ``beside`` are read by nobody later;
        those of ``made`` (column to its SQL over the others) are not written, but made whenever rows are read."""
        version, made = uuid.uuid4().hex, self._made(name, made)
        rows.drop(*made).write.parquet(f"{self.root}/{name}/{version}", compression=CODEC)
        return self._noted(name, version, rows, beside, made)

    def staged_parts(self, name: str, rows: DataFrame, part: Column, n: int, made: dict[str, str] | None = None) -> tuple[DataFrame, list[DataFrame | None]]:
        """As ``staged``, in ``n`` parts (numbers from 0) that are layers of their own: all rows, and each part's, or
        None for a part without rows."""
        version, made = uuid.uuid4().hex, self._made(name, made)
        rows.drop(*made).withColumn("__part", part).write.partitionBy("__part").parquet(f"{self.root}/{name}/{version}", compression=CODEC)
        folders = [f"{version}/__part={i}" for i in range(n)]
        parts = [self._noted(name, f, rows, None, made) if self._fs.exists(self._path(f"{self.root}/{name}/{f}")) else None for f in folders]
        return self._read(name, version, rows.schema, made), parts

    def _noted(self, name: str, version: str, rows: DataFrame, beside: list[str] | None, made: dict[str, str]) -> DataFrame:
        out = self._read(name, version, rows.schema, made)
        self._staged.append((out, name, version, [c for c in rows.columns if c not in (beside or [])], made))
        return out

    def _written(self, name: str, rows: DataFrame, schema: StructType | None, made: dict[str, str]) -> tuple[str, StructType, dict[str, str]]:
        """The folder with a layer's rows, their schema, and the columns that are made (those of the table, if there is one)."""
        kinds = lambda x: {f.name: f.dataType for f in x}
        for i, (df, table, version, columns, own_made) in enumerate(self._staged):
            if df is rows and table == name:
                own = StructType([df.schema[c] for c in columns])
                if schema is None or (kinds(own) == kinds(schema) and own_made == made):
                    del self._staged[i]
                    return version, own, own_made
        if schema is not None:
            rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        version = uuid.uuid4().hex
        rows.drop(*made).write.parquet(f"{self.root}/{name}/{version}", compression=CODEC)
        return version, rows.schema, made

    def _layered(self, name: str, entry: dict | None, rows: DataFrame, gone: DataFrame | None, key: list[str], afresh: bool = False) -> dict:
        """The table's entry with one more layer, or with one layer in all."""
        if entry is not None and "layers" not in entry:
            if "parts" in entry:
                raise ValueError(f"{name}: a table in buckets takes no layers")
            entry = {"schema": entry["schema"], "layers": [{"rows": entry["version"], "gone": None, "bytes": self._bytes(f"{self.root}/{name}/{entry['version']}")}]}
        schema = StructType.fromJson(entry["schema"]) if entry else None
        version, shape, made = self._written(name, rows, schema, entry.get("made", {}) if entry else {})
        layer: dict = {"rows": version, "gone": None}
        layer["bytes"] = self._bytes(f"{self.root}/{name}/{layer['rows']}")
        if entry is not None and gone is not None and not afresh:
            layer["gone"] = uuid.uuid4().hex
            gone.select(*(F.col(k).cast(schema[k].dataType).alias(k) for k in key)).distinct().write.parquet(f"{self.root}/{name}/{layer['gone']}", compression=CODEC)
            layer["bytes"] += self._bytes(f"{self.root}/{name}/{layer['gone']}")
        out = {"key": key, "layers": [*(entry["layers"] if entry and not afresh else []), layer], "schema": entry["schema"] if entry else json.loads(shape.json()), **({"made": made} if made else {})}
        first = next((i for i, x in enumerate(out["layers"]) if x["gone"]), len(out["layers"]))  # those before it hold nothing that went
        heavy = sum(x["bytes"] for x in out["layers"][first:]) > sum(x["bytes"] for x in out["layers"][:first])
        if len(out["layers"]) > LAYERS or heavy:
            whole = uuid.uuid4().hex
            self._stacked(name, out).drop(*made).write.parquet(f"{self.root}/{name}/{whole}", compression=CODEC)
            out["layers"] = [{"rows": whole, "gone": None, "bytes": self._bytes(f"{self.root}/{name}/{whole}")}]
        return out

    def commit(self, changes: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, merges: dict[str, tuple[DataFrame, list[str], Merge]] | None = None, layers: dict[str, tuple[DataFrame, DataFrame | None, list[str]]] | None = None, afresh: Collection[str] = ()) -> int:
        """Replace the tables of ``changes``, merge rows into those of ``merges`` (rows, key, merge), add layers to
        those of ``layers`` (rows, keys whose older rows go, key; keys are not null), which are the first ones of the
        tables in ``afresh`` (all older rows go); all others stay. The manifest is written last, by a rename."""
        before = self.manifest()
        tables = dict(before["tables"])
        for name, df in changes.items():
            version = uuid.uuid4().hex
            writer = df.write
            if cols := (partition_by or {}).get(name):
                writer = writer.partitionBy(*cols)
            writer.parquet(f"{self.root}/{name}/{version}")
            tables[name] = {"version": version, "schema": json.loads(df.schema.json())}
        for name, (rows, key, merge) in (merges or {}).items():
            tables[name] = self._merged(name, tables.get(name), rows, key, merge)
        for name, (rows, gone, key) in (layers or {}).items():
            tables[name] = self._layered(name, tables.get(name), rows, gone, key, name in afresh)
        number = before["number"] + 1
        text = json.dumps({"number": number, "tables": tables})
        folder = f"{self.root}/_manifests"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"commit {number} was taken by another writer")
        return number

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> int:
        """Rows win over the table's by key; keys must be unique in ``rows``."""
        if rows.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: keys of an upsert must be unique")
        return self.commit({}, merges={name: (rows, key, lambda old, new: upserted(old, new.select(*old.columns), key))})

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> int:
        """The table without the rows of ``keys``; of a table in buckets of ``on``, only those touched are written."""
        gone = keys.select(*on).distinct()
        if self.manifest()["tables"][name].get("key") == on:
            return self.commit({}, merges={name: (gone, on, lambda old, new: old.join(new, on, "left_anti"))})
        return self.commit({name: self.read(name).join(gone, on, "left_anti")})

    def vacuum(self) -> int:
        """Delete versions that the current manifest does not name; returns how many."""
        n = 0
        for name, entry in self.manifest()["tables"].items():
            if "layers" in entry:
                keep = {x[part].split("/")[0] for x in entry["layers"] for part in ("rows", "gone") if x[part]}
            else:
                keep = {p.split("/")[0] for p in entry["parts"].values()} if "parts" in entry else {entry["version"]}
            for f in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                if f.getPath().getName() not in keep:
                    self._fs.delete(f.getPath(), True)
                    n += 1
        return n
