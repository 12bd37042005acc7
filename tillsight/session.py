"""Spark session construction and lineage helpers.

Settings here are the ones every operator in the library assumes:
UTC session time, ANSI arithmetic (division goes through ``try_divide``),
adaptive execution with skew-join splitting, and a reliable checkpoint
directory taken from the cluster (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on. Shuffle-partition count and file split size are
# left to the caller / cluster: AQE coalesces small shuffles at runtime.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tillsight",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the reliable checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not fallback and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = fallback or tempfile.mkdtemp(prefix="tillsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run's files under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{name}-{uuid.uuid4().hex}"


@contextmanager
def compiled_methods(spark: SparkSession):
    """For what runs inside: a stage whose generated method has more than 8,000 bytes of code, which the JVM would
    interpret and not compile, runs operator by operator in short methods. For plans over dozens of computed columns."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """For writes inside: shuffle files go at the end of the write, not when the driver next collects garbage, which on long
    runs is after many further steps."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_to_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table of this run under the shared checkpoint folder: columns compressed and a single copy, where
    ``cut_lineage`` holds rows as they are, twice while it writes. Rows are not read back in the partitions they had."""
    path = run_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_to_table`` and ``llm.common.stored`` that nothing reads any more; other frames are left alone."""
    for t in tables:
        path = t.__dict__.pop("_stored_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint dir (survives executor loss).

    The frame is persisted while the checkpoint is written, so the plan runs once
    (an unpersisted eager checkpoint computes it twice), then released."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out
