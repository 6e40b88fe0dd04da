"""Tables on the way: the shared folder, written intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent in local mode (tests) a temporary folder is set in its place; with
    executors of their own that is an error, as they would not see it. The folder is removed when the
    application ends normally.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark.sparkContext.master):
            raise PySparkRuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glossweave-")
        spark.sparkContext.setCheckpointDir(base)
    fs, p = filesystem(spark, base)
    base = fs.makeQualified(p).toString()  # a path without a scheme is the default file system's
    path = f"{base.rstrip('/')}/glossweave-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(remove, spark, path)
    return path


_CLEANED: set[str] = set()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's own type (driver side only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours if the session still lives."""
    try:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # at exit the JVM may be gone; nothing to do then
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(*tables: DataFrame | None) -> None:
    """Deletes the files of materialised tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = _WRITTEN.pop(df, None) if df is not None else None
        if path:
            remove(df.sparkSession, path)


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place by a rename that does not overwrite: of several writers one wins. False if the file
    is there already."""
    fs, final = filesystem(spark, path)
    if fs.exists(final):
        return False
    tmp = filesystem(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
    jvm = spark.sparkContext._jvm
    stream = fs.create(tmp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(final), none)
    except Exception:
        fs.delete(tmp, False)
        if fs.exists(final):
            return False
        raise
    return True
