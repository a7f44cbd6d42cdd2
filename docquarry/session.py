"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCRATCH: list[str] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docquarry")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    On a cluster that lacks the path it changes nothing; the package is then shipped as usual (``--py-files``).
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder, removed at exit.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="docquarry-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return _LOCAL[sc.applicationId]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docquarry-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return "/".join([_own_dir(spark), *_SCRATCH, f"{name}-{uuid.uuid4().hex}"])


def saved(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside goes in the end: for steps whose results are written by then."""
    name = f"scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(name)
    folder = "/".join([_own_dir(spark), *_SCRATCH])
    try:
        yield
    finally:
        _SCRATCH.pop()
        _delete(spark, folder)


def clear_saved(spark: SparkSession) -> None:
    """Delete all that this application saved, once no result that reads it is needed any more."""
    _delete(spark, _own_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
