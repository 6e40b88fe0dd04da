"""Dictionaries: (pos, en, ru) tables and what is done with them before they are applied.

Positions are explicit columns. Dictionaries and key lists are joined by key or position, without
broadcast hints: Spark broadcasts a side by its measured size.
"""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Ordered = list[tuple[str, str]]
LIST_PAIRS = 500


def zip_by_position(left: DataFrame, right: DataFrame, pos: str = "rn") -> DataFrame:
    """Rows of the same position; the longer side's rest is cut."""
    return left.join(right, pos)


def zip_longest(chunk: DataFrame, translated: DataFrame) -> DataFrame:
    """chunk: rn, original; translated: rn, translated. A missing translation is the original; a surplus one
    stays, with a null original."""
    both = chunk.join(translated, "rn", "full_outer")
    return both.select("rn", "original", F.coalesce("translated", "original").alias("translated"))


def first_wins(pairs: DataFrame) -> DataFrame:
    """One row an en: its first pos and that row's ru."""
    first = pairs.groupBy("en").agg(F.min(F.struct("pos", "ru")).alias("f"))
    return first.select(F.col("f.pos").alias("pos"), "en", F.col("f.ru").alias("ru"))


def last_wins(items: DataFrame) -> DataFrame:
    """items: pos, id, text. The text of the last row of an id, even if it is empty."""
    return items.groupBy("id").agg(F.max_by("text", "pos").alias("text"))


def first_non_empty(items: DataFrame) -> DataFrame:
    """items: pos, id, text. The first text of an id that is not empty; null if there is none."""
    some = F.when(F.col("text") != "", F.col("pos"))
    return items.groupBy("id").agg(F.min_by("text", some).alias("text"))


def resolved(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """requested: id, prepared; answers: id, text (one row an id). Missing and empty answers fall back."""
    return requested.join(answers, "id", "left").select(*requested.columns, T.fallback("text", "prepared").alias("translated"))


def padded(keys: DataFrame, output: DataFrame) -> DataFrame:
    """keys: rn, en; output: rn, ru. Output past the keys is cut, keys past the output stand for themselves."""
    return keys.join(output, "rn", "left").select("rn", "en", F.coalesce("ru", "en").alias("ru"))


def by_length(pairs: DataFrame) -> DataFrame:
    """rn from 1: longest en first in code points, ties by pos. A dictionary's keys, not a corpus, are ranked."""
    from .frequency import ranked

    keyed = pairs.withColumns({"count": F.length("en").cast("long"), "text_en": F.format_string("%019d", "pos")})
    return ranked(keyed).select("rn", *pairs.columns)


def missing(extract: DataFrame, mapping: DataFrame, key: str = "text_en") -> DataFrame:
    """Rows of extract, repeated ones too, whose key the mapping lacks; a null key is missing."""
    return extract.join(mapping.select(key).distinct(), key, "left_anti")


def blank_values(mapping: DataFrame, value: str = "text_ru") -> DataFrame:
    return mapping.where(F.col(value).isNull() | (F.col(value) == ""))


def enriched(extract: DataFrame, mapping: DataFrame, key: str = "text_en") -> DataFrame:
    """extract with the mapping's value; every key must be there (see check_coverage)."""
    return extract.join(mapping, key)


def check_coverage(extract: DataFrame, mapping: DataFrame, key: str = "text_en", value: str = "text_ru") -> None:
    """Raises with the number of missing rows, or with the first key that has an empty value."""
    n = missing(extract, mapping, key).count()
    if n:
        raise PySparkValueError(f"{n} texts have no translation")
    blank = blank_values(mapping, value).limit(1).collect()
    if blank:
        raise PySparkValueError(f"empty translation of {blank[0][key]!r}")


def check_not_empty(pairs: DataFrame) -> None:
    if pairs.isEmpty():
        raise PySparkValueError("the dictionary is empty")


def dead_keys(pairs: DataFrame) -> DataFrame:
    """Keys that can never match a plain token: they hold the placeholder or a control code."""
    return pairs.where(F.contains("en", F.lit(T.DIM)) | F.col("en").rlike(r"\\[A-Za-z]"))


def normalised(pairs: DataFrame) -> DataFrame:
    """Stripped on both sides; blank en goes, blank ru (which deletes the text) stays."""
    return pairs.select("pos", T.strip(T.text_or_empty("en")).alias("en"), T.strip(T.text_or_empty("ru")).alias("ru")).where("en <> ''")


def from_lines(en: DataFrame, ru: DataFrame) -> DataFrame:
    """en, ru: ix, value (lines of two files). Blank lines go on each side on its own, count prefixes are
    stripped, the rest is paired by position, the first value of a key wins."""
    from .frequency import dense

    left = dense(en.where(T.non_blank("value")), "ix").select("rn", T.strip_count_prefix("value").alias("en"))
    right = dense(ru.where(T.non_blank("value")), "ix").select("rn", T.strip_count_prefix("value").alias("ru"))
    return first_wins(zip_by_position(left, right).withColumnRenamed("rn", "pos"))


def ordered_or_table(pairs: DataFrame, most: int | None = None) -> Ordered | DataFrame:
    """A dictionary of up to most (LIST_PAIRS) pairs as a driver list, longest key first, ties by pos; a larger one as
    it is, for the appliers that join. At most most + 1 rows reach the driver."""
    most = LIST_PAIRS if most is None else most
    rows = pairs.select("pos", "en", "ru").where("en <> ''").limit(most + 1).collect()
    if len(rows) > most:
        return pairs
    return [(r["en"], r["ru"]) for r in sorted(rows, key=lambda r: (-len(r["en"]), r["pos"]))]
