"""Dictionary and extract files as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dictionary import from_lines, normalised
from ..plans.tables import filesystem, materialize
from .sinks import json_items

#: CSV as the standard writer makes it: quotes doubled, line feeds inside quotes, edge spaces kept.
CSV = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
}


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows, just read from a file or a folder, with rn from 1 in the order of the files' names (part numbers by value),
    the blocks of a file and the rows of a block.

    Spark packs files into tasks by size and splits large ones, so the order of partitions is no order of rows. Each
    row therefore keeps its file and block, a running number of its task tells the place in the block, and
    blocks start where the rows of all earlier ones end: a prefix sum over a row a block."""
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    placed = materialize(rows.select("*", *at), "file-rows")
    part = F.regexp_extract(F.element_at(F.split("__file", "/"), -1), r"\Apart-(\d+)", 1)
    blocks = placed.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.expr("try_cast(nullif(__part, '') as bigint)"), "__file", "__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = blocks.withColumn("__part", part).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = placed.join(starts.select("__file", "__block", "__first", "__before"), ["__file", "__block"])
    return numbered.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("rn"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty values as empty texts."""
    rows = _csv(spark, path)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


def dictionary_columns(names: list[str]) -> tuple[str, str]:
    """The header's columns for en and ru. A name found in any case is then looked up in small letters; a
    missing text_en falls back to the first column, a missing text_ru to the second."""
    low = [n.lower() for n in names]
    en = "text_en" if "text_en" in low else (names[0] if names else None)
    ru = "text_ru" if "text_ru" in low else (names[1] if len(names) > 1 else None)
    if not en or not ru:
        raise PySparkValueError("the dictionary needs two columns: text_en, text_ru")
    return en, ru


def read_csv_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """pos (the place in the file or folder), en, ru: stripped, blank en left out, blank ru and repeated keys kept. A header that has the names
    in capitals only yields no pairs, as its lookup is by the small-letter name."""
    rows = _csv(spark, path)
    en, ru = dictionary_columns(rows.columns)
    has = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")
    placed = in_file_order(rows)
    return normalised(placed.select(F.col("rn").alias("pos"), has(en).alias("en"), has(ru).alias("ru")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ix from 0, value: the lines of a file or of a folder's files, in order. Undecodable bytes are left out (and with
    them, in such a line, replacement characters)."""
    valid = F.make_valid_utf8("value")
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
    return in_file_order(spark.read.text(path)).select((F.col("rn") - 1).alias("ix"), value.alias("value"))


def read_text_pair_dictionary(spark: SparkSession, en_path: str, ru_path: str) -> DataFrame:
    """pos, en, ru from two files with a text a line each, count prefixes allowed. Texts of several lines are
    several keys there; CSV keeps them whole."""
    return from_lines(read_lines(spark, en_path), read_lines(spark, ru_path))


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """text_en, text_ru from a flat JSON object; the last of a repeated key wins."""
    whole = spark.read.text(path, wholetext=True)

    def pairs(batches):
        for pdf in batches:
            for raw in pdf["value"]:
                found = json.loads(raw)
                texts = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in found.values()]
                yield pd.DataFrame({"text_en": list(found), "text_ru": pd.Series(texts, dtype=object)})

    return whole.mapInPandas(pairs, "text_en string, text_ru string")


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """count, text_en of a frequency CSV."""
    return read_csv(spark, path).select(F.col("count").cast("long").alias("count"), "text_en")


def read_extract_in_order(spark: SparkSession, path: str) -> DataFrame:
    """rn, count, text_en of a frequency CSV; rn is the place of a row."""
    rows = in_file_order(_csv(spark, path))
    return rows.select("rn", F.col("count").cast("long").alias("count"), F.coalesce("text_en", F.lit("")).alias("text_en"))


def read_frequency_json(spark: SparkSession, path: str) -> DataFrame:
    """count, text_en of a frequency JSON: a folder that write_frequency_json() made, or a file of any layout."""
    fs, p = filesystem(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return json_items(spark.read.text(path))
    items = F.from_json("value", "items array<struct<text_en:string,count:bigint>>")["items"]
    return spark.read.text(path, wholetext=True).select(F.inline(items)).select("count", "text_en")


def read_frequency_txt(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a frequency TXT with the prefix split off: ix, count (null on continuation lines), text."""
    lines = read_lines(spark, path)
    count = F.regexp_extract("value", r"\A\[(\d+)\] ", 1)
    return lines.select("ix", F.nullif(count, F.lit("")).cast("long").alias("count"), T.strip_count_prefix("value").alias("text"))
