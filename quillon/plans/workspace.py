"""Shared folder for tables and checkpoints that must outlive an executor."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.errors import NoSharedFolder

_SETTING = "spark.checkpoint.dir"
_scratch: list[str] = []
_checkpoints: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests, a laptop) a temporary folder is set as the checkpoint directory
    once; on a cluster this is an error, as all executors must share the folder.
    """
    configured = spark.sparkContext.getConf().get(_SETTING) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise NoSharedFolder(f"{_SETTING} is not set: a cluster needs a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; ``clean`` removes it, at the latest when the driver's interpreter ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean_quietly, spark)
    _scratch.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Removes all scratch paths and checkpoints of this driver. Frames that read from them can't be used any more."""
    for paths in (_scratch, _checkpoints):
        while paths:
            remove(spark, paths.pop())


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = filesystem(spark, path)
    fs.delete(hadoop_path, True)


def _clean_quietly(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # the JVM may be gone already
        pass


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch paths and checkpoints made inside are removed at its end; frames that read them are used up by then."""
    before, kept = set(_scratch), set(_checkpoints)
    try:
        yield
    finally:
        for path in [p for p in _scratch if p not in before]:
            _scratch.remove(path)
            remove(spark, path)
        for path in [p for p in _checkpoints if p not in kept]:
            _checkpoints.remove(path)
            remove(spark, path)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size of a frame, before it is run; None where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else None


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    made = df.checkpoint(eager=True)
    if (file := made._jdf.logicalPlan().rdd().getCheckpointFile()).isDefined():
        _checkpoints.append(file.get())
    return made


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, order: tuple[str, ...] = ()) -> None:
    """Stores ``df`` at ``path``, its rows spread over buckets by ``key`` and sorted in each."""
    spark, name = df.sparkSession, f"quillon_{uuid.uuid4().hex}"
    try:
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*(order or (key,))).option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_buckets(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """What ``write_buckets`` stored: grouping and joining by ``key`` needs no shuffle, filters on it read few buckets.

    The frame names its files; the catalog entry, which says how they are bucketed, is dropped at once.
    """
    name = f"quillon_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by ``key``."""
    path, n = scratch_path(df.sparkSession, label), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_buckets(df.repartition(n, key), path, key, n)
    return read_buckets(df.sparkSession, path, df.schema, key, n)
