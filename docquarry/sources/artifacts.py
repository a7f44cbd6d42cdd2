"""A store of artifacts by content: one file for each different content, and commits that say which path has which.

Tasks write contents under their digest and check them; a commit is one small file, renamed into place, that names
the entries which its tasks wrote. So readers see a whole commit or none, a task that runs again does no harm, and
nothing but the names of entry files goes through the driver. There is one writer at a time. Contents of a commit that
failed stay until ``unreferenced`` names them.

    put(df, root)        rows (path, content, sha256): stored; a null content deletes the path
    listed(spark, root)  path, sha256, length: what the commits leave
    contents(listed)     with the content, checked again

Defined results: a null sha256 is not compared; a null path or a wrong digest fails the commit; a path twice in one commit
must have one content, or the commit fails; an empty table commits nothing; deleting an unknown path does nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content binary, sha256 string"
ENTRY = "path string, sha256 string, length long, commit long"


def _filesystem(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root).rstrip("/"))


def _write(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """The file as a whole: written beside its place, then renamed."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(data)
    fs.move(beside, path)


@dataclass
class Written(WriterCommitMessage):
    entries: str | None


class ArtifactWriter(DataSourceWriter):
    def __init__(self, root: str, commit: int):
        self.root, self.number = root, commit

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _filesystem(self.root)
        name = f"entries/{self.number}-{uuid.uuid4().hex}.jsonl"
        fs.create_dir(f"{root}/entries", recursive=True)
        n = 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for path, content, expected in rows:
                if path is None:
                    raise ValueError("an artifact without a path")
                sha = None if content is None else hashlib.sha256(content).hexdigest()
                if expected is not None and sha is not None and expected != sha:
                    raise ValueError(f"checksum of {path} differs")
                if sha is not None:
                    place = f"{root}/objects/{sha[:2]}/{sha}"
                    if fs.get_file_info(place).size != len(content):
                        _write(fs, place, bytes(content))
                out.write((json.dumps({"path": path, "sha256": sha, "length": None if sha is None else len(content), "commit": self.number}) + "\n").encode())
                n += 1
        if not n:
            fs.delete_file(f"{root}/{name}")
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        names = sorted(m.entries for m in messages if m and m.entries)
        if names:
            fs, root = _filesystem(self.root)
            _write(fs, f"{root}/commits/{self.number}.json", json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.root)
        for m in messages:
            if m and m.entries:
                fs.delete_file(f"{root}/{m.entries}")


class ArtifactSource(DataSource):
    """``df.write.format("artifacts").option("path", root).option("commit", number).mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"], int(self.options["commit"]))


def _commits(root: str) -> dict[int, str]:
    fs, base = _filesystem(root)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/commits", allow_not_found=True))
    return {int(f.base_name.removesuffix(".json")): f.path for f in found if f.base_name.endswith(".json")}


def put(df: DataFrame, root: str) -> None:
    """Store the rows (path, content, sha256) in one commit, or nothing."""
    spark = df.sparkSession
    rows = df.select("path", "content", "sha256")
    digest = F.coalesce(F.sha2("content", 256), F.lit(""))
    if rows.groupBy("path").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").limit(1).count():
        raise ValueError("a path with several contents in one commit")
    spark.dataSource.register(ArtifactSource)
    number = max(_commits(root), default=0) + 1
    rows.write.format("artifacts").option("path", root).option("commit", number).mode("append").save()


def _entries(spark: SparkSession, root: str) -> DataFrame:
    fs, base = _filesystem(root)
    names: list[str] = []
    for path in _commits(root).values():
        with fs.open_input_stream(path) as f:
            names += json.loads(f.read())
    prefix = root.rstrip("/")
    return spark.read.schema(ENTRY).json([f"{prefix}/{n}" for n in names]) if names else spark.createDataFrame([], ENTRY)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256, length: the last commit of each path decides."""
    last = _entries(spark, root).groupBy("path").agg(F.max_by(F.struct("sha256", "length"), "commit").alias("e"))
    return last.select("path", "e.sha256", "e.length").where(F.col("sha256").isNotNull())


def contents(listing: DataFrame, root: str) -> DataFrame:
    """path, sha256, length, content, intact (whether the content has its digest and length); a lost content is null."""
    spark = listing.sparkSession
    fs, base = _filesystem(root)
    if fs.get_file_info(f"{base}/objects").type == pyarrow.fs.FileType.NotFound:
        return listing.select("path", "sha256", "length", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("intact"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "?" * 64).load(f"{root.rstrip('/')}/objects")
    held = files.select(F.substring_index("path", "/", -1).alias("sha256"), "content")
    intact = F.coalesce((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("length")), F.lit(False))
    # A scan of files passes over empty ones.
    listing = listing.join(held, "sha256", "left").withColumn("content", F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.col("content")))
    return listing.select("path", "sha256", "length", "content", intact.alias("intact"))


def unreferenced(spark: SparkSession, root: str) -> DataFrame:
    """sha256 of the contents that no path has now: what may be deleted while nobody writes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "?" * 64).load(f"{root.rstrip('/')}/objects")
    held = files.select(F.substring_index("path", "/", -1).alias("sha256"))
    return held.join(listed(spark, root), "sha256", "left_anti")
