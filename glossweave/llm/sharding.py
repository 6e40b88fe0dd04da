"""Size-tiered sharding, with DataFrame operations and Hadoop's file system only.

A store is a folder with data/<run>/ (immutable parquet shards), manifests/ (parquet tables of the live
shards: file, bytes, docs, sealed, and how many files their run was written with) and versions/<number> (a
line naming the manifest and the columns). Arrivals are appended as small shards, bounded in rows and in
bytes. Compaction sorts the live shards into tiers by size (a tier is FANOUT times the one below), packs
the shards of a tier into groups of about the target size and rewrites a group as one shard; a shard near
the target, or merged from a group near it, is sealed and left alone, and a tier of few small shards waits,
so each document is rewritten about once a tier. A shard of several documents over SPLIT targets is cut
into shards of about the target. A new manifest becomes visible by the atomic rename of its version file,
which fails if another writer was first; files no version names are invisible.

Groups are numbered and each number is a partition of its own, so no task holds more than a group. A wave
of compaction reads at most WAVE_SHARDS shards, whose lines are what the driver holds; readers name runs,
not files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators.frequency import dense
from .common import filesystem, fresh_path, unused

TARGET_BYTES = 64 << 20
BASE_BYTES = 1 << 20
FANOUT = 4
FULL = 0.5  # share of the target from which a shard is left alone
SPLIT = 2.0  # targets beyond which a shard is cut
ARRIVAL_DOCS = 4096
ROW_GROUP_BYTES = 16 << 20  # so that readers can split a shard
WAVE_SHARDS = 20_000  # merged by one job; bounds what is broadcast to a line for each of them
SLOT_SHARDS = 10_000  # shards of a tier that are packed together, about

PARQUET = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)}
MANIFEST = "file string, bytes long, docs long, sealed boolean, of long"


def plain(path: Column) -> Column:
    """A path as both listings and file metadata name it; one of them writes an empty authority."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def run_of(file: Column) -> Column:
    return F.regexp_extract(file, "/data/([^/]+)/", 1)


def row_bytes(schema: t.StructType) -> Column:
    """About what a row holds: the bytes of texts and binaries, nested values as JSON, eight for others."""
    of = lambda f: (
        F.octet_length(f"`{f.name}`") if isinstance(f.dataType, (t.StringType, t.BinaryType))
        else F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) if isinstance(f.dataType, (t.ArrayType, t.MapType, t.StructType))
        else F.lit(8)
    )
    return sum((F.coalesce(of(f).cast("long"), F.lit(0)) for f in schema.fields), F.lit(0).cast("long"))


def free(schema: t.StructType, name: str) -> str:
    """A column name that the schema does not have."""
    while name.lower() in map(str.lower, schema.names):
        name += "_"
    return name


class ShardStore:
    """A versioned store of shards below a path."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes

    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _line(self, version: int | None = None) -> dict:
        """The line of a version (the last one); empty before the first commit."""
        found = self.versions()
        if not found:
            return {}
        version = found[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:010d}").first()[0])

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """The live shards of a version (the last one); None before the first commit."""
        line = self._line(version)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{line['manifest']}") if line else None

    def schema(self, version: int | None = None) -> t.StructType | None:
        kept = self._line(version).get("schema")
        return t.StructType.fromJson(kept) if kept else None

    def _commit(self, manifest: DataFrame, version: int, schema: t.StructType | None = None) -> int:
        """Writes the manifest, then renames its version file into place; raises if that version exists."""
        name = f"m-{version:010d}-{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.path}/manifests/{name}")
        fs, tmp = filesystem(self.spark, f"{self.path}/versions/.{name}")
        final = filesystem(self.spark, f"{self.path}/versions/{version:010d}")[1]
        jvm = self.spark.sparkContext._jvm
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema and schema.jsonValue()}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(tmp), fs.makeQualified(final), none)  # without OVERWRITE: one writer wins
        return version

    def _files(self, *folders: str) -> DataFrame:
        """file and bytes of the parquet files below folders."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(folders))
        return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))

    def _rows(self, schema: t.StructType, *folders: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)

    def _written(self, folder: str, schema: t.StructType, sealed: DataFrame | None = None) -> DataFrame:
        """The manifest rows of a folder of parquet files; sizes come from the listing, counts from footers.
        sealed: numbers of groups that are sealed whatever they compress to together."""
        files = self._files(folder)
        rows = self._rows(schema, folder)
        docs = rows.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("docs"))
        both = files.join(docs, plain(files["file"]) == plain(docs["f"]), "left")
        full = F.col("bytes") >= FULL * self.target
        if sealed is not None:  # Spark names a file by the partition that wrote it
            both = both.withColumn("number", F.regexp_extract("file", "/part-([0-9]+)-[^/]*$", 1).cast("int")).join(sealed, "number", "left")
            full = full | F.coalesce("near", F.lit(False))
        return both.select("file", "bytes", F.coalesce("docs", F.lit(0)).alias("docs"), full.alias("sealed"), F.lit(files.count()).cast("long").alias("of"))

    def append(self, docs: DataFrame) -> int:
        """Adds docs as small shards of at most ARRIVAL_DOCS rows and, unless a single document is longer, at
        most the target's bytes uncompressed, as Spark's tasks find them; no shuffle. Gives the new version.

        A task sorts its rows by classes of length, so that longer ones come fewer to a file. An empty table
        commits a version without new shards.
        """
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        unit = self.target / ARRIVAL_DOCS
        kind = F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(row_bytes(docs.schema), F.lit(1)) / unit) / 2))).cast("int")
        by_kind, by_part = unused(docs, "__sh_kind"), unused(docs, "__sh_part")
        rows = docs.withColumn(by_kind, kind).sortWithinPartitions(by_kind)
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        each = F.greatest(F.lit(1), F.floor(F.lit(ARRIVAL_DOCS) / F.pow(F.lit(4), by_kind)))
        rows = rows.withColumn(by_part, F.concat_ws("-", by_kind, F.floor(at / each).cast("string"))).drop(by_kind)
        filesystem(self.spark, folder)[0].mkdirs(filesystem(self.spark, folder)[1])
        rows.write.mode("append").options(**PARQUET).partitionBy(by_part).parquet(folder)
        last, old, known = self.versions(), self.manifest(), self.schema()
        new = self._written(folder, docs.schema)
        schema = t.StructType([*known.fields, *(f for f in docs.schema.fields if f.name not in known.names)]) if known else docs.schema
        return self._commit(new if old is None else old.unionByName(new), last[-1] + 1 if last else 1, schema)

    def plan(self, force: bool = False) -> DataFrame:
        """file, bytes, docs, size, group and parts: shards of similar sizes to merge into one of about the
        target, and shards to cut into parts. A group of fewer than FANOUT shards waits until it fills the
        target, unless force."""
        live = self.manifest().where("docs > 0")
        over = (F.col("bytes") > SPLIT * self.target) & (F.col("docs") > 1)
        cut = live.where(over).select("file", "bytes", "docs", F.col("bytes").alias("size"), F.concat(F.lit("cut-"), "file").alias("group"), F.least("docs", F.ceil(F.col("bytes") / self.target)).cast("int").alias("parts"))
        small = live.where(~over & ~F.col("sealed"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / BASE_BYTES) / F.log(F.lit(float(FANOUT))))).cast("int")
        small = small.withColumn("tier", F.lit(0) if force else tier)
        slots = small.groupBy("tier").agg(F.ceil(F.count(F.lit(1)) / SLOT_SHARDS).alias("slots"))  # a row a tier
        small = small.join(slots, "tier").withColumn("slot", F.pmod(F.xxhash64("file"), F.col("slots")))
        order = Window.partitionBy("tier", "slot").orderBy("bytes", "file").rowsBetween(Window.unboundedPreceding, -1)  # some SLOT_SHARDS rows
        small = small.withColumn("group", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / self.target))
        each = Window.partitionBy("tier", "slot", "group")
        small = small.withColumns({"n": F.count(F.lit(1)).over(each), "size": F.sum("bytes").over(each)})
        due = (F.col("n") > 1) & (F.lit(force) | (F.col("n") >= FANOUT) | (F.col("size") >= FULL * self.target))
        merge = small.where(due).select("file", "bytes", "docs", "size", F.concat_ws("-", "tier", "slot", "group").alias("group"), F.lit(1).alias("parts"))
        return merge.unionByName(cut)

    def compact(self, force: bool = False) -> int | None:
        """Carries out the planned groups and commits; None if there is nothing to do. A plan of more than
        WAVE_SHARDS shards is carried out in several calls."""
        version = self.versions()[-1]
        lines = self.plan(force).orderBy("group", "file").limit(WAVE_SHARDS + 1).collect()
        if not lines:
            return None
        if len(lines) > WAVE_SHARDS:  # the last group may be cut short; alone it is merged in parts
            lines = [r for r in lines if r["group"] != lines[-1]["group"]] or lines
        first, n, near = {}, 0, []
        for r in lines:
            if r["group"] not in first:
                first[r["group"]] = n
                near += [(n + i, r["parts"] == 1 and r["size"] >= FULL * self.target) for i in range(r["parts"])]
                n += r["parts"]
        groups = self.spark.createDataFrame([(r["file"], first[r["group"]], r["parts"]) for r in lines], "file string, first int, parts int")
        schema = self.schema()
        rows = self.spark.read.schema(schema).parquet(*(r["file"] for r in lines))
        rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in schema.names)).alias("row"), plain(F.col("_metadata.file_path")).alias("name"), F.col("_metadata.row_index").alias("at"))
        dealt = rows.join(F.broadcast(groups), rows["name"] == plain(groups["file"]))
        number = (F.col("first") + F.pmod(F.col("at"), F.col("parts"))).cast("int")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt.repartitionById(n, number).select("row.*").write.options(**PARQUET).parquet(folder)
        sealed = self.spark.createDataFrame(near, "number int, near boolean")
        kept = self.manifest(version).join(groups.select("file"), "file", "left_anti")
        return self._commit(kept.unionByName(self._written(folder, schema, sealed)), version + 1, schema)

    def compact_all(self) -> int:
        """Compacts until nothing is due; each round has fewer small shards, or fewer large ones. Gives the
        last version."""
        while self.compact() is not None:
            pass
        return self.versions()[-1]

    def _runs(self, live: DataFrame) -> tuple[list[str], list[str]]:
        """The folders of runs that are live as a whole, and of those live in part. A line a run."""
        rows = live.groupBy(run_of(F.col("file")).alias("run")).agg((F.count(F.lit(1)) == F.max("of")).alias("whole")).collect()
        return tuple([f"{self.path}/data/{r['run']}" for r in rows if r["whole"] is is_whole] for is_whole in (True, False))

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version with the columns they had and, last, the file's name: the column __sh_shard, with
        underscores added if the documents have one of that name. Runs that are live as a whole are read as
        folders; of the others Spark joins the live files by name."""
        live, schema = self.manifest(version), self.schema(version)
        if schema is None:
            raise PySparkException("the store has no shards")
        whole, partly = self._runs(live)
        name = F.col("_metadata.file_path")
        at, file = (free(schema, c) for c in ("__sh_shard", "__sh_name"))
        shard, own = F.regexp_extract(name, "([^/]+)/?([^/]+)$", 0).alias(at), [F.col(f"`{c}`") for c in schema.names]
        parts = [self._rows(schema, *whole).select(*own, shard)] if whole else []
        if partly:
            rows = self._rows(schema, *partly).select(*own, shard, plain(name).alias(file))
            parts.append(rows.join(live.select(plain(F.col("file")).alias(file)), file, "left_semi").drop(file))
        out = parts[0] if parts else self.spark.createDataFrame([], t.StructType([*schema.fields, t.StructField(at, t.StringType())]))
        return out.unionByName(parts[1]) if len(parts) > 1 else out

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data that none of the last keep versions names, and older versions; gives how many files."""
        versions = self.versions()
        live = self.manifest(versions[-1])
        for v in versions[-keep:-1]:
            live = live.unionByName(self.manifest(v))
        whole, partly = self._runs(live.dropDuplicates(["file"]))
        fs, root = filesystem(self.spark, f"{self.path}/data")
        used = {p.rsplit("/", 1)[1] for p in (*whole, *partly)}
        gone = 0
        for status in fs.listStatus(root):  # a line a run
            if status.getPath().getName() not in used:
                gone += self._files(status.getPath().toString()).count()
                fs.delete(status.getPath(), True)
        if partly:
            names = live.select(plain(F.col("file")).alias("f"))
            files = self._files(*partly)
            for r in files.join(names, plain(files["file"]) == names["f"], "left_anti").toLocalIterator():
                fs.delete(filesystem(self.spark, r["file"])[1], False)
                gone += 1
        for v in versions[:-keep]:
            fs.delete(filesystem(self.spark, f"{self.path}/versions/{v:010d}")[1], False)
        return gone


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """docs through a new store: appended, compacted, read back from the last manifest. One row a row of
    docs: doc_id, n_bytes and text_sha256 of the text as read, shard (numbered by file name),
    shard_bytes, shard_docs, version.

    Null text has no bytes and a null digest; null ids, repeated rows and ties are rows like others. All
    columns of docs are kept in the shards, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"), target_bytes)
    store.append(docs)
    version = store.compact_all()
    name = lambda c: F.regexp_extract(c, "([^/]+)/?([^/]+)$", 0)
    live = store.manifest(version).select(name(F.col("file")).alias("__sh_name"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs")).where("shard_docs > 0")
    live = dense(live, "__sh_name").withColumnRenamed("rn", "shard")
    rows = store.read(version)
    own = rows.select(rows[id_col].cast("long").alias("doc_id"), F.octet_length(rows[text_col]).cast("long").alias("n_bytes"), F.sha2(rows[text_col].cast("binary"), 256).alias("text_sha256"), F.col(rows.columns[-1]).alias("__sh_shard"))
    return own.join(live, own["__sh_shard"] == live["__sh_name"]).select("doc_id", "n_bytes", "text_sha256", "shard", "shard_bytes", "shard_docs", F.lit(version).alias("version"))
