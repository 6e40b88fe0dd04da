"""From entities to the bag of texts: one narrow pass, an explode and a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .schema import ATTRIBUTES, INSERTS, LEADERS

ITEM = "array<struct<kind:string,detail:string,text:string>>"


def prefix_of() -> Column:
    """BLOCK:{name} inside blocks (BLOCK if unnamed), null in layouts."""
    name = T.text_or_empty("container")
    return F.when(F.col("space") == "block", F.when(name != "", F.concat(F.lit("BLOCK:"), name)).otherwise("BLOCK"))


def dimension_override(c: Column) -> Column:
    """A dimension's own text; empty where it is only the placeholder."""
    t = T.text_or_empty(c)
    return F.when(T.strip(t) == T.DIM, "").otherwise(t)


def items() -> Column:
    """All (kind, detail, text) of an entity, in reading order, blank ones included."""
    kind = F.col("dxftype")
    named = F.coalesce(prefix_of(), kind)

    def one(detail: Column, text: Column) -> Column:
        return F.array(F.struct(named.alias("kind"), detail.alias("detail"), text.alias("text")))

    accessors = F.concat(F.array(T.text_or_empty("text")), F.coalesce("alternatives", F.array().cast("array<string>")))
    first = F.coalesce(F.filter(accessors, T.non_blank)[0], F.lit(""))
    tag = T.text_or_empty("tag")
    cell_kind = F.coalesce(F.concat(prefix_of(), F.lit(":TABLE")), F.lit("TABLE"))
    cells = F.flatten(
        F.transform(
            F.coalesce("cells", F.array().cast("array<array<string>>")),
            lambda row, r: F.transform(
                row, lambda v, c: F.struct(cell_kind.alias("kind"), F.concat(F.lit("r"), r.cast("string"), F.lit("c"), c.cast("string")).alias("detail"), v.alias("text"))
            ),
        )
    )
    attribs = F.transform(
        F.coalesce("attribs", F.array().cast("array<struct<tag:string,text:string>>")),
        lambda a: F.struct(F.concat(named, F.lit(":ATTRIB")).alias("kind"), F.coalesce(a["tag"], F.lit("")).alias("detail"), a["text"].alias("text")),
    )
    empty = F.array().cast(ITEM)
    return (
        F.when(kind == "TEXT", one(F.lit(""), T.text_or_empty("text")))
        .when(kind.isin("MTEXT", *LEADERS), one(F.lit(""), first))
        .when(kind.isin(*ATTRIBUTES), one(tag, T.text_or_empty("text")))
        .when(kind == "DIMENSION", one(F.lit(""), dimension_override(F.col("text"))))
        .when(kind == "TABLE", cells)
        .when(kind.isin(*INSERTS), attribs)
        .otherwise(empty)
        .cast(ITEM)
    )


def text_bag(entities: DataFrame) -> DataFrame:
    """kind, detail, text (unstripped) of every text that is not blank; duplicates stay. Unknown types and
    nulls yield nothing."""
    return entities.select(F.explode(items()).alias("i")).select("i.kind", "i.detail", "i.text").where(T.non_blank("text"))


def bag_of(texts: DataFrame, kind: Column, detail: Column, text: Column) -> DataFrame:
    """A bag from any table."""
    return texts.select(kind.cast("string").alias("kind"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"), text.alias("text")).where(T.non_blank("text"))


def union_bags(*bags: DataFrame) -> DataFrame:
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out
