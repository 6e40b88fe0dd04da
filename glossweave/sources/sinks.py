"""Outputs. Each is a folder of files that hold the rows in the order of rn, one after the other by name:
one file for a few keys, ranges of rn for many."""

from __future__ import annotations

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import filesystem, materialize, release

CSV_OUT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("rn").sortWithinPartitions("rn")  # few rows are coalesced at run time


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...], mode: str = "overwrite") -> None:
    """rows: rn and the columns."""
    _in_order(rows).select(*columns).write.mode(mode).options(**CSV_OUT).csv(path)


def write_frequency_csv(ranked: DataFrame, path: str) -> None:
    write_csv(ranked, path, ("count", "text_en"))


def write_map_csv(pairs: DataFrame, path: str) -> None:
    """pairs: rn, text_en, text_ru; rows in the order of the keys, repeated ones kept."""
    write_csv(pairs, path, ("text_en", "text_ru"))


def write_enriched_csv(rows: DataFrame, path: str) -> None:
    """rows: rn, count, text_en, text_ru. The path may be the one that rows were read from: the new file is
    written beside it, the old one moves aside, the new one takes its place, and the old one goes last, so a
    crash leaves the input as path or path.old."""
    spark, path = rows.sparkSession, path.rstrip("/")
    written = materialize(rows, "enriched")
    write_csv(written, f"{path}.new", ("count", "text_en", "text_ru"))
    fs, here = filesystem(spark, path)
    beside, aside = (filesystem(spark, f"{path}.{x}")[1] for x in ("new", "old"))
    if fs.exists(here):
        fs.delete(aside, True)
        if not fs.rename(here, aside):
            raise PySparkRuntimeError(f"{path} can't be moved")
    if not fs.rename(beside, here):
        raise PySparkRuntimeError(f"{path}.new can't take the place of {path}; the input is {path}.old")
    fs.delete(aside, True)
    release(written)


def json_lines(ranked: DataFrame) -> DataFrame:
    """rn, value: the lines of {"items": [{"text_en", "count"}]}, an item a line, brackets before and after."""
    last = ranked.agg(F.coalesce(F.max("rn"), F.lit(0)).alias("last"))
    edges = last.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("rn"), F.lit('{"items": [').alias("value")), F.struct((F.col("last") + 1).alias("rn"), F.lit("]}").alias("value")))).alias("e")).select("e.*")
    item = F.to_json(F.struct("text_en", "count"))
    # a comma before all but the first, so that no row needs to know whether it is the last
    return ranked.select("rn", F.concat(F.when(F.col("rn") == 1, "  ").otherwise(", "), item).alias("value")).unionByName(edges)


def json_items(lines: DataFrame) -> DataFrame:
    """count, text_en of json_lines(): brackets are no items."""
    item = F.from_json(F.regexp_replace("value", r"\A[ ,]+", ""), "text_en string, count bigint")
    return lines.where(F.col("value").rlike(r'\A[ ,]+\{"text_en"')).select(item.alias("i")).select("i.count", "i.text_en")


def write_frequency_json(ranked: DataFrame, path: str) -> None:
    _in_order(json_lines(ranked)).select("value").write.mode("overwrite").text(path)


def txt_lines(rows: DataFrame, text: str = "text_en") -> DataFrame:
    """rn, value: [count] text; line feeds in texts are not escaped."""
    return rows.select("rn", T.with_count("count", text).alias("value"))


def write_frequency_txt(ranked: DataFrame, path: str) -> None:
    _in_order(txt_lines(ranked)).select("value").write.mode("overwrite").text(path)


def write_translated_txt(ranked: DataFrame, translated: DataFrame, path: str) -> None:
    """ranked: rn, count; translated: rn, text_ru. The longer side's rest is cut."""
    rows = ranked.select("rn", "count").join(translated.select("rn", "text_ru"), "rn")
    _in_order(txt_lines(rows, "text_ru")).select("value").write.mode("overwrite").text(path)


def write_if(wanted: bool, path: str | None, write) -> bool:
    """Runs write(path) if the output is wanted and has a path; tells whether it did."""
    if wanted and path:
        write(path)
        return True
    return False
