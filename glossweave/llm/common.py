"""What the operators of this folder share: tables, the shared folder, word rules, folds."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import filesystem, fresh_path, materialize, release, shared_dir, table  # noqa: F401

#: The white space that separates words, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
HEAVY = 1 << 16  # keys that heavy() gives at most


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def to_local(uri: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for Python workers; file, hdfs, s3 and gs URIs."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def trim() -> None:
    """Gives memory that a finished task has freed back to the machine; Python workers live on and their
    next task may be another operator's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, for columns on the way."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy(weights: DataFrame, weight: str, at_least: int) -> DataFrame:
    """The rows of weights (a written table, one row a key) that weigh more than at_least and more than one HEAVY-th of
    all. There are fewer than HEAVY of them, whatever the input, so they may be broadcast; what any other
    key brings is a small share of an exchange."""
    total = weights.agg(F.sum(weight)).first()[0] or 0
    return weights.where(F.col(weight) > max(at_least, total / HEAVY))


def dealt_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """rows joined with one (a row a key) by the key. hot (key, parts; from heavy()) names the keys whose rows are
    dealt over so many parts by a hash of the column by, before the exchange; each part has a copy of one's row."""
    parts = F.broadcast(hot.select(key, F.col("parts").alias("__parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0))
    left = rows.join(parts, key, "left").withColumn("__part", part.cast("int")).drop("__parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)).cast("int") - 1))
    right = one.join(parts, key, "left").withColumn("__part", each).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")
