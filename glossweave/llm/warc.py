"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: payloads are compared by their SHA-256; of equal payloads of at least MIN_REVISIT bytes the
smallest page_id becomes a response, the others revisits of it. Every task appends gzip members, one a
record, to archives of its own of at most ARCHIVE_BYTES, and returns the index: offset, length, URL and
digest of each record. The index is written beside the archives in the same job, so it names exactly
the archives of the attempts that succeeded; files of lost attempts are named by no index. Revisits carry no
payload: the copies of a payload that weighs much (at most HEAVY payloads, so their list is broadcast) drop it
where they were read, and meet their response by keys alone, HOT rows a part.

Reading: the selected index rows are dealt out by archive and RANGE_BYTES of offset (so no archive is
one task's work), sorted, and neighbouring ranges with gaps of at most GAP bytes are read at once.

Archives go through pyarrow's file systems (file, hdfs, s3, gs URIs) in the workers.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, filesystem, fresh_path, heavy, materialize, release, shuffle_partitions, to_local

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES, GAP, READ_BYTES = 16 << 20, 64 << 10, 8 << 20
GZIP_LEVEL = 1
HOT_BYTES, HOT = 16 << 20, 16_384  # bytes of equal payloads that stay together; rows of one digest in one part
ROW_BYTES = 256  # what a row weighs besides its payload, about
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date
INDEX_FOLDER = "index"
INDEX = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, archive string, offset long, length long"


def record_id(page_id: int | None, url: str | None, row: int) -> str:
    """row tells rows of one page_id and URL apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {row} {url}')}>"


def one_line(value: str | None) -> str:
    return " ".join((value or "").splitlines())


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, row: int = 0, original: tuple[int, str | None, int] | None = None) -> bytes:
    """A response record, or a revisit record, which needs no payload, if the original (page_id, url, row) is given;
    size is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if original else http + payload
    head = {
        "WARC-Type": "revisit" if original else "response",
        "WARC-Record-ID": record_id(page_id, url, row),
        "WARC-Date": DATE,
        "WARC-Target-URI": one_line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if original:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*original[:2], original[2]), "WARC-Refers-To-Target-URI": one_line(original[1]), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": str(original[0])}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; the payload of a revisit is empty."""
    if not raw.startswith(VERSION):
        raise ValueError("no WARC record starts here")
    head, _, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n"))
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("a record is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out: str | None = None) -> DataFrame:
    """Writes archives and their index below the folder out, which must be new, and returns the index (INDEX);
    read_index() opens it again. Without out a folder of the shared one is used, which goes with the
    application.

    Null html is an empty payload; null url an empty one. A null id is larger than all others: it is
    referred to by nothing, and its page revisits if another page has the payload. Rows that repeat the
    smallest id of a payload are responses all, and a revisit names the first of them. Other columns are
    ignored. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    out = fresh_path(spark, "warc") if out is None else out.rstrip("/")
    fs_of, at = filesystem(spark, out)
    out = fs_of.makeQualified(at).toString()
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    own = own.withColumn("n", F.octet_length("payload"))
    known = own.select("page_id", "digest", "url", "row", "n").where(F.col("n") >= MIN_REVISIT)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first")
    shared = known.groupBy("digest").agg(first, F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + F.lit(ROW_BYTES).cast("long")).alias("weight"))
    shared = materialize(shared.where("c > 1 and first is not null"), "warc-shared")
    hot = heavy(shared, "weight", HOT_BYTES).select("digest", F.ceil(F.col("c") / HOT).alias("parts"), F.col("first.page_id").alias("head"))
    rows = own.join(F.broadcast(hot.select("digest", "head")), "digest", "left")
    bare = F.when(F.col("head").isNull() | F.col("page_id").eqNullSafe(F.col("head")), F.col("payload"))  # a copy's payload goes no further
    rows = dealt_join(rows.withColumn("payload", bare).drop("head"), shared.select("digest", "first"), "digest", hot, "row", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    payload = F.when(F.col("ref").isNull(), F.col("payload")).alias("payload")
    rows = rows.withColumn("ref", refers).select("page_id", "url", payload, "n", "digest", "row", F.col("ref.page_id").alias("refers_to"), F.col("ref.url").alias("ref_url"), F.col("ref.row").alias("ref_row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = to_local(out)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        stream, name, offset, n = None, "", 0, 0
        if not out.startswith(("s3:", "gs:")):
            fs.create_dir(folder, recursive=True)
        try:
            for pdf in batches:
                index = []
                ids, refs = (pdf[c].astype("Int64").to_numpy(dtype=object, na_value=None) for c in ("page_id", "refers_to"))
                ref_rows = pdf["ref_row"].astype("Int64").to_numpy(dtype=object, na_value=None)
                for page_id, url, body, size, digest, row, ref, ref_url, ref_row in zip(ids, pdf["url"], pdf["payload"], pdf["n"].tolist(), pdf["digest"], pdf["row"].tolist(), refs, pdf["ref_url"], ref_rows, strict=True):
                    if stream is None or offset >= ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, offset, n = f"{stem}-{n:04d}.warc.gz", 0, n + 1
                        stream = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    raw = pack.compress(record(page_id, url, None if body is None else bytes(body), size, digest, row, None if ref is None else (ref, ref_url, ref_row))) + pack.flush()
                    stream.write(raw)
                    index.append((page_id, url, "response" if ref is None else "revisit", ref, digest, size, f"{out}/{name}", offset, len(raw)))
                    offset += len(raw)
                frame = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": object, "refers_to": object})
        finally:
            if stream is not None:
                stream.close()

    rows.mapInPandas(run, INDEX).write.option("compression", "zstd").parquet(f"{out}/{INDEX_FOLDER}")
    release(shared)
    return read_index(spark, out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The index of the archives below a folder."""
    return spark.read.schema(INDEX).parquet(f"{out.rstrip('/')}/{INDEX_FOLDER}")


def ranges(wanted: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) to (start, end, positions): neighbours with small gaps are one read of at
    most READ_BYTES, unless a single record is longer."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(wanted):
        if out and offset - out[-1][1] <= GAP and offset + length - out[-1][0] <= READ_BYTES:
            start, end, own = out[-1]
            out[-1] = (start, max(end, offset + length), [*own, i])
        else:
            out.append((offset, offset + length, [i]))
    return out


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that rows of an index name: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if asked, payload, all taken from the archives. A revisit's digest is the one it
    declares, its payload_bytes null. A payload that does not have its record's digest is an error."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["archive", "offset"])
            for archive, part in pdf.groupby("archive", sort=False):
                fs, path = to_local(archive)
                with fs.open_input_file(path) as f:
                    for start, end, own in ranges(list(zip(part["offset"], part["length"], strict=True))):
                        raw, rows = f.read_at(end - start, start), []
                        for i in own:
                            at = part["offset"].iat[i] - start
                            head, payload = parse(zlib.decompress(raw[at : at + part["length"].iat[i]], 31))
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            response = head["WARC-Type"] == "response"
                            if response and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its digest says")
                            page, ref = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                            row = (int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], int(ref) if ref else None, len(payload) if response else None, digest, payload)
                            rows.append(row[: len(names)])
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    part = F.floor(F.col("offset") / RANGE_BYTES)
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(shuffle_partitions(index.sparkSession), -(-total // RANGE_BYTES))  # by the bytes to read, not the index's own
    dealt = index.select("archive", "offset", "length", part.alias("part")).repartition(n, "archive", "part").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInPandas(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to archives, reads every record back and resolves revisits to the payload read for
    their digest. One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = materialize(read(write(pages, id_col, url_col, html_col), with_payload=False), "warc-read")
    sizes = found.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("n"))
    revisits = found.where("record_type = 'revisit'").withColumn("d", F.col("payload_digest"))
    counts = materialize(revisits.groupBy("d").agg(F.count(F.lit(1)).alias("c")), "warc-counts")
    hot = heavy(counts, "c", HOT).select("d", F.ceil(F.col("c") / HOT).alias("parts"))
    revisits = dealt_join(revisits, sizes, "d", hot, "page_id")
    cols = ["page_id", "payload_digest", "record_type", "refers_to"]
    out = found.where("record_type = 'response'").select("payload_bytes", *cols).unionByName(revisits.select(F.col("n").alias("payload_bytes"), *cols))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
