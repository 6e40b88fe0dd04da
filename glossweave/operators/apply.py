"""Ordered replacement of dictionary keys in texts and entities.

Pairs apply one after the other, longest key first, so later pairs see earlier output; no single
pattern can do that. Up to NATIVE_PAIRS pairs are folded inside the JVM, up to dictionary.LIST_PAIRS by an Arrow
UDF that holds the ordered list once a worker; a dictionary that is a table is applied by joins (see large),
whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import materialize
from . import large
from .dictionary import Ordered
from .flatten import dimension_override
from .schema import ATTRIBUTES, LEADERS, STYLED, TARGETS

NATIVE_PAIRS = 50
STYLE_NAME = "RU"
_CODE = re.compile(r"\\[A-Za-z][^\\]*")


def ordered(pairs: Ordered) -> Ordered:
    """Longest key first in code points, ties in the order given; empty keys go."""
    return sorted(((en, ru) for en, ru in pairs if en), key=lambda p: -len(p[0]))


def fold(text: str, pairs: Ordered) -> str:
    for en, ru in pairs:
        if en in text:
            text = text.replace(en, ru)
    return text


def fold_protected(text: str, pairs: Ordered) -> str:
    """fold() between placeholders and outside control codes with what follows them."""
    done = []
    for piece in text.split(T.DIM):
        out, at = [], 0
        for code in _CODE.finditer(piece):
            out += [fold(piece[at : code.start()], pairs), code.group()]
            at = code.end()
        done.append("".join([*out, fold(piece[at:], pairs)]))
    return T.DIM.join(done)


def replacer(spark: SparkSession, pairs: Ordered, protect: bool = True):
    """A function from a text column to the replaced one. Null stays null."""
    if len(pairs) <= NATIVE_PAIRS:
        plain = lambda c: T.replace_literals(c, pairs)
        return (lambda c: F.when(c.isNotNull(), T.replace_protected(c, plain))) if protect else plain
    held = spark.sparkContext.broadcast(pairs)
    one = fold_protected if protect else fold

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for s in texts:
            yield pd.Series([None if t is None else one(t, own) for t in s], dtype=object)

    return F.pandas_udf(run, "string")


def apply_to_texts(rows: DataFrame, pairs: Ordered | DataFrame, text: str = "text", out: str = "text", protect: bool = True) -> DataFrame:
    """pairs: a list in order, or a table of pos, en, ru."""
    if isinstance(pairs, DataFrame):
        done = large.replaced(rows.select(F.col(text).alias("text")), pairs, protect).select(F.col("text").alias("__from"), F.col("out").alias("__to"))
        both = rows.join(done, F.col(text) == F.col("__from"), "left").withColumn(out, F.col("__to"))
        return both.drop("__from", "__to")
    return rows.withColumn(out, replacer(rows.sparkSession, pairs, protect)(F.col(text)))


def _by_table(entities: DataFrame, pairs: DataFrame, apply_attribs: bool):
    """entities with the column __map of their texts as replaced, and a function from a text column to the
    replaced one. Every distinct text is folded once."""
    kept = materialize(entities.withColumn("__id", F.monotonically_increasing_id()), "entities")
    texts = [F.array(F.when(F.col("dxftype").isin(*TARGETS), F.col("text")))]
    texts += [F.when(F.col("dxftype") == "TABLE", F.flatten("cells"))] if "cells" in entities.columns else []
    texts += [F.transform("attribs", lambda a: a["text"])] if apply_attribs else []
    none = F.array().cast("array<string>")
    each = kept.select("__id", F.explode(F.array_distinct(F.concat(*(F.coalesce(t, none) for t in texts)))).alias("text")).where("text is not null")
    done = each.join(large.replaced(each, pairs), "text").where("text <> out")
    maps = done.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("text", "out"))).alias("__map"))  # the texts of an entity
    return kept.join(maps, "__id", "left").drop("__id"), lambda c: F.coalesce(F.try_element_at("__map", c), c)


def apply_to_entities(entities: DataFrame, pairs: Ordered | DataFrame, style: str | None = STYLE_NAME, apply_attribs: bool = False) -> DataFrame:
    """entities with their texts replaced, and the style set on TEXT, MTEXT, ATTRIB and ATTDEF.

    A dimension changes only if it has a text of its own and the new one is not blank; leaders and cells
    only if not blank. Attributes attached to an insert stay, as does every other type, unless
    apply_attribs. pairs: a list in order, or a table of pos, en, ru.
    """
    if isinstance(pairs, DataFrame):
        entities, replace = _by_table(entities, pairs, apply_attribs)
    else:
        replace = replacer(entities.sparkSession, pairs)
    kind, text = F.col("dxftype"), F.col("text")
    own = dimension_override(text)
    new = replace(F.when(kind.isin(*TARGETS), text))
    keeps = F.when(kind == "DIMENSION", T.non_blank(own) & T.non_blank(new)).when(kind.isin(*LEADERS), T.non_blank(text)).otherwise(kind.isin("TEXT", "MTEXT", *ATTRIBUTES))
    out = entities.withColumn("__new", new).withColumn("text", F.when(F.coalesce(keeps, F.lit(False)), F.col("__new")).otherwise(text)).drop("__new")
    out = _cells(out, replace, entities.columns)
    if style and "style" in out.columns:
        out = out.withColumn("style", F.when(kind.isin(*STYLED), F.lit(style)).otherwise(F.col("style")))
    return (_attribs(out, replace) if apply_attribs else out).drop("__map")


def _cells(rows: DataFrame, replace, columns: list[str]) -> DataFrame:
    """Non-blank cells of tables, replaced; blank ones stay as they are."""
    if "cells" not in columns:
        return rows
    if not _is_udf(replace):
        new = F.transform("cells", lambda r: F.transform(r, lambda t: F.when(T.non_blank(t), replace(t)).otherwise(t)))
        return rows.withColumn("cells", F.when(F.col("dxftype") == "TABLE", new).otherwise(F.col("cells")))
    of_arrays = _array_replacer(replace)
    return rows.withColumn("cells", F.when(F.col("dxftype") == "TABLE", of_arrays(F.col("cells"))).otherwise(F.col("cells")))


def _is_udf(replace) -> bool:
    return hasattr(replace, "evalType")


def _array_replacer(replace):
    texts = replace.func

    def run(tables: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in tables:
            flat = [c for t in s if t is not None for row in t if row is not None for c in row]
            new = iter(next(texts(iter([pd.Series(flat, dtype=object)])))) if flat else iter(())
            done = []
            for t in s:
                done.append(None if t is None else [None if r is None else [(lambda n, o: n if o is not None and o.strip() else o)(next(new), c) for c in r] for r in t])
            yield pd.Series(done, dtype=object)

    return F.pandas_udf(run, "array<array<string>>")


def _attribs(rows: DataFrame, replace) -> DataFrame:
    """The repaired form: attached attributes are written back too."""
    if _is_udf(replace):
        texts = _array_replacer(replace)(F.array(F.transform("attribs", lambda a: a["text"])))[0]
    else:
        texts = F.transform("attribs", lambda a: replace(a["text"]))
    return rows.withColumn("attribs", F.zip_with("attribs", texts, lambda a, t: F.struct(a["tag"].alias("tag"), t.alias("text"))))
