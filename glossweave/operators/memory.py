"""A translation memory: answers kept between runs and through failures, so that no text is asked for twice.

Answers live in immutable folders; a version is a small file that names the folders it consists of, put in place
by a rename that does not overwrite. A run joins its texts with the last version, asks for the rest only, and
commits their answers as a further version. While it asks, every request's answers go into a journal, a file a
request named by the digest of what was sent, written beside and renamed: a task that is tried again, or a run
begun anew after a failure, finds them there. (A task that is lost between the answer and the rename asks that
one request again, as does a speculative copy of a task that runs at the same time.)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import commit_text, filesystem, materialize, remove
from . import frequency, providers

ANSWERS = "scope string, text_en string, answer string"


def scope_of(options: providers.Options) -> str:
    """What an answer depends on beside its text."""
    return json.dumps([options.provider, options.source_lang, options.target_lang, options.model], ensure_ascii=False)


class Journal:
    """Answers of single requests, written by the tasks that asked."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self, name: str):
        from pyarrow import fs

        uri = "file:///" + self.uri[len("file:") :].lstrip("/") if self.uri.startswith("file:") else self.uri
        files, folder = fs.FileSystem.from_uri(uri)
        files.create_dir(folder, recursive=True)
        return files, f"{folder}/{name}"

    def answers(self, scope: str, texts: list[str], ask: Callable[[], list[str]]) -> tuple[list[str], bool]:
        """The answers to a request, and whether they had to be asked for now."""
        from pyarrow import fs

        files, path = self._at(hashlib.sha256(json.dumps([scope, texts]).encode()).hexdigest())
        if files.get_file_info(path).type == fs.FileType.File:
            with files.open_input_stream(path) as f:
                return json.loads(f.read()), False
        got = ask()
        tmp = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(tmp) as f:
            f.write(json.dumps(got).encode())
        files.move(tmp, path)
        return got, True


class Memory:
    """Answers below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = filesystem(spark, path)
        self.spark, self.path = spark, fs.makeQualified(p).toString().rstrip("/")

    def version(self) -> int:
        fs, p = filesystem(self.spark, f"{self.path}/versions")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0

    def folders(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:010d}", wholetext=True).first()[0]) if version else []

    def answers(self, scope: str) -> DataFrame:
        """text_en, answer: one row a text, of the earliest commit that has it."""
        held = self.folders()
        if not held:
            return self.spark.createDataFrame([], "text_en string, answer string")
        rows = self.spark.read.schema(ANSWERS).parquet(*(f"{self.path}/answers/{f}" for f in held))
        place = F.regexp_extract(F.col("_metadata.file_path"), "/answers/([0-9]+)-", 1).cast("long")
        rows = rows.where(F.col("scope") == scope).select("text_en", "answer", place.alias("place"))
        return rows.groupBy("text_en").agg(F.min_by("answer", F.struct("place", "answer")).alias("answer"))

    def commit(self, answers: DataFrame) -> int:
        """Adds answers (scope, text_en, answer) as a new version; another writer's version is kept."""
        while True:
            last = self.version()
            folder = f"{last + 1:010d}-{uuid.uuid4().hex}"
            answers.write.option("compression", "zstd").parquet(f"{self.path}/answers/{folder}")
            if commit_text(self.spark, f"{self.path}/versions/{last + 1:010d}", json.dumps([*self.folders(last), folder])):
                return last + 1
            remove(self.spark, f"{self.path}/answers/{folder}")  # another one was faster

    def write(self, answers: DataFrame) -> str:
        """Answers (scope, text_en, answer and any more) beside the others, in no version yet; their folder's path."""
        path = f"{self.path}/answers/new-{uuid.uuid4().hex}"
        answers.write.option("compression", "zstd").parquet(path)
        return path

    def commit_written(self, path: str) -> str:
        """Adds the answers of write() as a new version by renaming their folder; their path from now on."""
        fs, at = filesystem(self.spark, path)
        while True:
            last = self.version()
            folder = f"{last + 1:010d}-{uuid.uuid4().hex}"
            to = filesystem(self.spark, f"{self.path}/answers/{folder}")[1]
            if not fs.rename(at, to):
                raise PySparkRuntimeError(f"the answers cannot be moved to {to.toString()}")
            at = to
            if commit_text(self.spark, f"{self.path}/versions/{last + 1:010d}", json.dumps([*self.folders(last), folder])):
                return f"{self.path}/answers/{folder}"


def translate(keys: DataFrame, options: providers.Options, memory: Memory, batch: int = 512, build: Callable[[providers.Options], providers.Translate] | None = None) -> DataFrame:
    """keys: rn, text_en (distinct). rn, text_en, text_ru and requested: whether the text was sent to the provider now.
    Without rn the texts are sent in their own order, and the result has none.

    As providers.translate(), with answers from the memory where it has them; the others are asked for and kept. build
    makes the provider (providers.build by default). An empty table asks for nothing and commits nothing."""
    scope, journal = scope_of(options), Journal(f"{memory.path}/journal")
    own = ["rn"] if "rn" in keys.columns else []
    known = materialize(keys.select(*own, "text_en").join(memory.answers(scope), "text_en", "left"), "memory-known")
    asked = known.where("answer is null").select(*(F.col(c).alias("own") for c in own), "text_en")
    asked = frequency.batches(frequency.dense(asked, "own" if own else "text_en"), batch)
    asked = asked.select("own" if own else F.col("rn").alias("own"), "batch", "text_en")
    make = build or providers.build

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, rest = None, None

        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal provider
            prepared, originals = list(rows["prepared"]), list(rows["text_en"])

            def ask() -> list[str]:
                nonlocal provider
                provider = provider or make(options)
                got = provider(prepared, originals)
                if len(got) < len(prepared):
                    raise PySparkRuntimeError(f"{len(prepared)} texts were sent, {len(got)} came back")
                return list(got[: len(prepared)])

            got, now = journal.answers(scope, prepared, ask)
            return pd.DataFrame({"own": rows["own"], "text_en": rows["text_en"], "answer": pd.Series(got, dtype=object, index=rows.index), "now": now})

        for pdf in parts:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            last = rest["batch"].iloc[-1] if len(rest) else None
            for _, rows in rest[rest["batch"] != last].groupby("batch", sort=False):
                yield answered(rows)
            rest = rest[rest["batch"] == last]
        if rest is not None and len(rest):
            yield answered(rest)

    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = asked.repartition(n, "batch").sortWithinPartitions("batch", "own").withColumn("prepared", T.prepare("text_en"))
    got = sent.mapInPandas(run, "own long, text_en string, answer string, now boolean")
    path, kept = memory.write(got.select(F.lit(scope).alias("scope"), "text_en", F.coalesce("answer", F.lit("")).alias("answer"), "own", "now")), f"{ANSWERS}, own long, now boolean"
    if memory.spark.read.schema(kept).parquet(path).isEmpty():
        remove(memory.spark, path)
        got = memory.spark.createDataFrame([], kept)
    else:
        got = memory.spark.read.schema(kept).parquet(memory.commit_written(path))  # the answers are written once
        remove(memory.spark, journal.uri)  # the version holds them now
    both = known.where("answer is not null").select(*own, "text_en", "answer", F.lit(False).alias("requested"))
    both = both.unionByName(got.select(*(F.col("own").alias(c) for c in own), "text_en", "answer", F.col("now").alias("requested")))
    return both.select(*own, "text_en", T.recover("text_en", T.fallback("answer", "text_en")).alias("text_ru"), "requested")
