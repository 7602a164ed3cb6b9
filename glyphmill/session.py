"""Sessions, and the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Settings that suit the engine on any cluster; sizes of shuffles are left to the caller and to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(app: str = "glyphmill", **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword names use two underscores for a dot."""
    b = SparkSession.builder.appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, as in tests, one is made on this machine, but only if all
    executors run on it; on a cluster it must be set, as a folder of one machine is lost to the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, made, True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_stored: list[str] = []  # paths of the tables there are


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored inside the block when it ends; results must have been written or read by then."""
    before = len(_stored)
    try:
        yield
    finally:
        while len(_stored) > before:
            _delete(spark, _stored.pop())


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URL, as Spark's workers reach it too, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, whatever executor is lost. The
    table is deleted when the session ends, or by releasing()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stored:
        atexit.register(lambda: [_delete(spark, p) for p in _stored])
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a file scan over all cores, where it has fewer parts than there are cores; other scans stay as they
    are. For work that costs far more for a row than moving it does."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
