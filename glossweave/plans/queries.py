"""Queries over the driver tables, one for each operator, and their SQL.

documents stands for layouts (a text a line, kind source, detail lang), conversations for more layouts,
benchmark for blocks; entities, control codes and white space are composed from part and lineitem.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import apply, dictionary, flatten, frequency, memory, providers, table_functions
from ..operators.schema import TARGETS
from ..sources import dxf, files, sinks
from . import localise
from .tables import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WS = T.WS.replace("'", "''")
LIT = lambda s: "'" + s.replace("'", "''") + "'"
#: A literal dictionary whose output cascades: later keys match what earlier ones made.
CASCADE = [("the and", "und the"), ("und", "UN D"), ("tion", "ZION"), ("the", "der"), ("ZI", "zy"), ("of", ""), ("D", "d_"), ("", "never")]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.explode(F.split("text", "\n")).alias("line"))
    return flatten.bag_of(docs, F.col("source"), F.col("lang"), F.col("line"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.text_frequency(lines(spark, sf_dir))


BAG_SQL = f"SELECT source AS kind, coalesce(lang, '') AS detail, line AS text FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, '{WS}') <> ''"
FREQ_SQL = f"SELECT trim(text, '{WS}') AS text_en, count(*) AS count FROM ({BAG_SQL}) GROUP BY 1"
RANK_SQL = f"SELECT text_en, count, row_number() OVER (ORDER BY count DESC, text_en) AS rn FROM ({FREQ_SQL})"


@query("text_bag", BAG_SQL)
def text_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@query(
    "text_bag_union",
    f"{BAG_SQL} UNION ALL SELECT role, '', text FROM conversations WHERE trim(text, '{WS}') <> '' UNION ALL SELECT 'BLOCK:' || item_id, '', text FROM benchmark WHERE trim(text, '{WS}') <> ''",
)
def text_bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = flatten.bag_of(table(spark, sf_dir, "conversations"), F.col("role"), F.lit(""), F.col("text"))
    blocks = flatten.bag_of(table(spark, sf_dir, "benchmark"), F.concat(F.lit("BLOCK:"), F.col("item_id")), F.lit(""), F.col("text"))
    return flatten.union_bags(lines(spark, sf_dir), talks, blocks)


@query("text_frequency", FREQ_SQL)
def text_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir)


@query("ranked_frequency", RANK_SQL)
def ranked_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.ranked(keys(spark, sf_dir))


@query("frequency_txt_lines", f"SELECT rn, '[' || count || '] ' || text_en AS value FROM ({RANK_SQL})")
def frequency_txt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.txt_lines(frequency.ranked(keys(spark, sf_dir)))


@query("frequency_json_items", FREQ_SQL)
def frequency_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_items(sinks.json_lines(frequency.ranked(keys(spark, sf_dir)))).select("text_en", "count")


@query("strip_prefix", rf"SELECT value, regexp_replace(trim(value, '{WS}'), '^\[\d+\]\s*', '') AS text FROM (SELECT '[' || count || '] ' || text_en AS value FROM ({FREQ_SQL}))")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = T.with_count("count", "text_en").alias("value")
    return keys(spark, sf_dir).select(value).withColumn("text", T.strip_count_prefix("value"))


KINDS = [*TARGETS, "INSERT", "MINSERT", "LINE"]
KINDS_SQL = "[" + ", ".join(LIT(k) for k in KINDS) + "]"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity a part, its type by the key; texts with codes, placeholders and white space."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS)).cast("int") + 1)
    text = F.when(F.col("p_size") % 7 == 0, " <> ").when(F.col("p_size") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("<>"), "p_type", F.lit("\\P"), "p_brand"))
    return p.select(
        F.lit("d").alias("doc_id"),
        F.when(F.col("p_size") % 3 == 0, "block").otherwise("layout").alias("space"),
        F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).when(F.col("p_size") % 2 == 0, "Model").otherwise("Sheet").alias("container"),
        F.col("p_partkey").alias("entity_ix"), kind.alias("dxftype"), text.alias("text"), F.col("p_brand").alias("tag"),
        F.array(F.struct(F.col("p_brand").alias("tag"), F.col("p_name").alias("text")), F.struct(F.lit(None).cast("string").alias("tag"), F.lit(" ").alias("text"))).alias("attribs"),
        F.array(F.array(F.col("p_name"), F.lit("")), F.array(F.col("p_type"), F.col("p_brand"))).alias("cells"),
        F.array(F.lit(" "), F.col("p_type")).alias("alternatives"), F.lit("Standard").alias("style"),
    )


ENTITIES_SQL = f"""SELECT p_partkey AS entity_ix, p_name, p_type, p_brand, {KINDS_SQL}[(p_partkey % {len(KINDS)}) + 1] AS dxftype,
 CASE WHEN p_size % 7 = 0 THEN ' <> ' WHEN p_size % 11 = 0 THEN chr(160) ELSE ' ' || p_name || '<>' || p_type || '\\P' || p_brand END AS text,
 CASE WHEN p_size % 3 = 0 THEN 'block' ELSE 'layout' END AS space,
 CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END WHEN p_size % 2 = 0 THEN 'Model' ELSE 'Sheet' END AS container FROM part"""
PREFIX_SQL = "CASE WHEN space = 'block' THEN CASE WHEN container <> '' THEN 'BLOCK:' || container ELSE 'BLOCK' END END"
FLAT_SQL = f"""WITH e AS (SELECT *, {PREFIX_SQL} AS prefix FROM ({ENTITIES_SQL})), items AS (
 SELECT coalesce(prefix, dxftype) AS kind, '' AS detail, text FROM e WHERE dxftype = 'TEXT'
 UNION ALL SELECT coalesce(prefix, dxftype), '', CASE WHEN trim(text, '{WS}') <> '' THEN text ELSE p_type END FROM e WHERE dxftype IN ('MTEXT', 'MULTILEADER', 'MLEADER', 'LEADER')
 UNION ALL SELECT coalesce(prefix, dxftype), p_brand, text FROM e WHERE dxftype IN ('ATTRIB', 'ATTDEF')
 UNION ALL SELECT coalesce(prefix, dxftype), '', CASE WHEN trim(text, '{WS}') = '<>' THEN '' ELSE text END FROM e WHERE dxftype = 'DIMENSION'
 UNION ALL SELECT coalesce(prefix || ':TABLE', 'TABLE'), d, t FROM (SELECT prefix, unnest(['r0c0', 'r0c1', 'r1c0', 'r1c1']) AS d, unnest([p_name, '', p_type, p_brand]) AS t FROM e WHERE dxftype = 'TABLE')
 UNION ALL SELECT coalesce(prefix, dxftype) || ':ATTRIB', p_brand, p_name FROM e WHERE dxftype IN ('INSERT', 'MINSERT'))
 SELECT kind, detail, text FROM items WHERE trim(text, '{WS}') <> ''"""


@query("entity_flatten", FLAT_SQL)
def entity_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.text_bag(entities(spark, sf_dir))


@query("target_filter", f"SELECT entity_ix, dxftype, container FROM ({ENTITIES_SQL}) WHERE dxftype IN ({', '.join(map(LIT, TARGETS))}) AND container <> 'Model'")
def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).where(F.col("dxftype").isin(*TARGETS) & (F.col("container") != "Model")).select("entity_ix", "dxftype", "container")


VALUES_SQL = "SELECT DISTINCT v FROM (SELECT unnest([p_name, p_type, p_brand, upper(left(p_brand, 3)), left(p_name, 2), 'X' || p_size, p_size::VARCHAR, ' ' || left(upper(p_type), 3) || ' ']) AS v FROM part)"


@query(
    "translate_worthy",
    f"""SELECT v AS text, length(t) >= 3 AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^[A-Za-z][0-9]+$')
 AND NOT (upper(t) = t AND lower(t) <> t AND length(t) <= 3 AND instr(t, ' ') = 0) AS worth FROM (SELECT v, trim(v, '{WS}') AS t FROM ({VALUES_SQL}))""",
)
def translate_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = [F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.upper(F.left("p_brand", F.lit(3))), F.left("p_name", F.lit(2)), F.concat(F.lit("X"), size), size, F.concat(F.lit(" "), F.left(F.upper("p_type"), F.lit(3)), F.lit(" "))]
    values = table(spark, sf_dir, "part").select(F.explode(F.array(*forms)).alias("text")).distinct()
    return values.withColumn("worth", T.worth_translating("text"))


COMPOSED_SQL = "SELECT p_partkey AS id, ' ' || p_name || '<>' || p_type || '\\P' || p_brand || chr(160) AS text FROM part"


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "p_name", F.lit("<>"), "p_type", F.lit("\\P"), "p_brand", F.lit(" "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


@query("prepare_text", f"SELECT id, replace(replace(text, '\\P', chr(10)), '<>', '__DXF_DIM__') AS prepared FROM ({COMPOSED_SQL})")
def prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(spark, sf_dir).select("id", T.prepare("text").alias("prepared"))


@query(
    "recover_text",
    f"SELECT id, ' ' || replace(replace(replace(trim(answer, '{WS}'), '__DXF_DIM__', '<>'), chr(13) || chr(10), chr(10)), chr(10), '\\P') || chr(160) AS recovered"
    f" FROM (SELECT id, '  ' || replace(replace(text, '\\P', chr(13) || chr(10)), '<>', '__DXF_DIM__') || 'x' AS answer FROM ({COMPOSED_SQL}))",
)
def recover_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("  "), F.replace(T.prepare("text"), F.lit("\n"), F.lit("\r\n")), F.lit("x"))
    return composed(spark, sf_dir).select("id", T.recover("text", answer).alias("recovered"))


@query("edge_whitespace", "SELECT p_partkey AS id, chr(9) || ' ' || p_type || chr(8195) AS kept, p_type AS plain, '   ' AS blank FROM part")
def edge_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), "p_name", F.lit(" "))
    loose = F.concat(F.lit(" "), "p_type", F.lit("\n"))
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.edge_whitespace(padded, loose).alias("kept"), T.edge_whitespace("p_name", loose).alias("plain"), T.edge_whitespace("p_name", F.lit("   ")).alias("blank"))


PAIRS_SQL = "SELECT p_partkey AS pos, p_type AS en, upper(p_name) AS ru FROM part"


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("en"), F.upper("p_name").alias("ru"))


@query("dict_longest_first", f"SELECT row_number() OVER (ORDER BY length(en) DESC, pos) AS rn, pos, en, ru FROM ({PAIRS_SQL})")
def dict_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.by_length(part_pairs(spark, sf_dir))


@query("dict_first_wins", f"SELECT min(pos) AS pos, en, arg_min(ru, pos) AS ru FROM ({PAIRS_SQL}) GROUP BY en")
def dict_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.first_wins(part_pairs(spark, sf_dir))


NATION_SQL = "SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, n_name AS en FROM nation"
REGION_SQL = "SELECT row_number() OVER (ORDER BY r_regionkey) AS rn, r_name AS ru FROM region"


def positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    en = frequency.dense(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("en")), "n_nationkey").drop("n_nationkey")
    ru = frequency.dense(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("ru")), "r_regionkey").drop("r_regionkey")
    return en, ru


@query("dict_zip", f"SELECT rn, en, ru FROM ({NATION_SQL}) JOIN ({REGION_SQL}) USING (rn)")
def dict_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.zip_by_position(*positions(spark, sf_dir)).select("rn", "en", "ru")


@query("dict_zip_longest", f"SELECT rn, original, coalesce(translated, original) AS translated FROM (SELECT rn, ru AS original FROM ({REGION_SQL})) FULL JOIN (SELECT rn, nullif(en, 'BRAZIL') AS translated FROM ({NATION_SQL})) USING (rn)")
def dict_zip_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    en, ru = positions(spark, sf_dir)
    return dictionary.zip_longest(ru.withColumnRenamed("ru", "original"), en.select("rn", F.nullif("en", F.lit("BRAZIL")).alias("translated")))


@query("dict_pad", f"SELECT rn, en, coalesce(ru, en) AS ru FROM ({NATION_SQL}) LEFT JOIN ({REGION_SQL}) USING (rn)")
def dict_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.padded(*positions(spark, sf_dir))


ANSWERS_SQL = "SELECT turn AS pos, conv_id AS id, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS text FROM conversations"


def some_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("pos"), F.col("conv_id").alias("id"), text.alias("text"))


@query("response_last_wins", f"SELECT id, arg_max(text, pos) AS text FROM ({ANSWERS_SQL}) GROUP BY id")
def response_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.last_wins(some_answers(spark, sf_dir))


@query("response_first_nonempty", f"SELECT id, arg_min(text, pos) FILTER (WHERE text <> '') AS text FROM ({ANSWERS_SQL}) GROUP BY id")
def response_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.first_non_empty(some_answers(spark, sf_dir))


@query(
    "response_resolved",
    f"SELECT b.item_id AS id, b.text AS prepared, coalesce(nullif(a.text, ''), b.text) AS translated FROM benchmark b LEFT JOIN (SELECT id, arg_max(text, pos) AS text FROM ({ANSWERS_SQL}) GROUP BY id) a ON a.id = b.item_id",
)
def response_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prepared"))
    return dictionary.resolved(asked, dictionary.last_wins(some_answers(spark, sf_dir)))


MAP_SQL = f"SELECT text_en, CASE WHEN count % 5 = 0 THEN '' ELSE 'ru:' || text_en END AS text_ru FROM ({FREQ_SQL}) WHERE length(text_en) % 3 <> 0"


def some_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = keys(spark, sf_dir).where(F.length("text_en") % 3 != 0)
    return some.select("text_en", F.when(F.col("count") % 5 == 0, "").otherwise(F.concat(F.lit("ru:"), "text_en")).alias("text_ru"))


@query("missing_translations", f"SELECT f.text_en, f.count FROM ({FREQ_SQL}) f ANTI JOIN ({MAP_SQL}) m USING (text_en)")
def missing_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.missing(keys(spark, sf_dir), some_map(spark, sf_dir))


@query("empty_translations", f"SELECT text_en, text_ru FROM ({MAP_SQL}) WHERE text_ru = ''")
def empty_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.blank_values(some_map(spark, sf_dir))


@query("enriched_extract", f"SELECT f.text_en, f.count, m.text_ru FROM ({FREQ_SQL}) f JOIN ({MAP_SQL}) m USING (text_en)")
def enriched_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.enriched(keys(spark, sf_dir), some_map(spark, sf_dir))


@query(
    "dead_keys",
    f"SELECT pos, en, 'x' AS ru FROM (SELECT id AS pos, CASE id % 4 WHEN 0 THEN text WHEN 1 THEN 'no \\~code' WHEN 2 THEN replace(text, '<>', '') ELSE replace(replace(text, '<>', '< >'), '\\P', '\\5') END AS en FROM ({COMPOSED_SQL}))"
    " WHERE instr(en, '<>') > 0 OR regexp_matches(en, '\\\\[A-Za-z]')",
)
def dead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = composed(spark, sf_dir)
    bare = F.replace(F.replace("text", F.lit("<>"), F.lit("< >")), F.lit("\\P"), F.lit("\\5"))
    en = F.when(F.col("id") % 4 == 0, F.col("text")).when(F.col("id") % 4 == 1, "no \\~code").when(F.col("id") % 4 == 2, F.replace("text", F.lit("<>"), F.lit(""))).otherwise(bare)
    return dictionary.dead_keys(p.select(F.col("id").alias("pos"), en.alias("en"), F.lit("x").alias("ru")))


def nested(expr: str, pairs: list[tuple[str, str]]) -> str:
    for en, ru in pairs:
        if en:
            expr = f"replace({expr}, {LIT(en)}, {LIT(ru)})"
    return expr


@query("apply_cascade", f"SELECT doc_id, {nested('text', CASCADE)} AS text FROM documents")
def apply_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.apply_to_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), CASCADE, protect=False)


#: Sixty pairs, more than the native fold takes: letters of an alphabet doubled, rotated and capitalised.
LARGE = apply.ordered([(a + b, b.upper() + a) for a in "aeioun" for b in "bdfglmnrst"])


@query("apply_large_dictionary", f"SELECT doc_id, md5({nested('text', LARGE)}) AS digest FROM documents")
def apply_large_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply.apply_to_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), LARGE)
    return done.select("doc_id", F.md5("text").alias("digest"))


@query(
    "apply_joined_dictionary",
    """WITH t AS (SELECT *, 'L' || l_orderkey || '.' || l_linenumber AS l, 'Q' || l_orderkey || '.' || l_partkey AS q, 'P' || l_partkey || '-' AS p FROM lineitem),
 s AS (SELECT p, min(l_returnflag || l_linenumber) AS status FROM t GROUP BY p),
 a AS (SELECT l AS en, min(p || l_suppkey) AS made FROM t GROUP BY l UNION ALL SELECT q, min(p || l_linenumber) FROM t GROUP BY q),
 r AS (SELECT en, CASE WHEN length(s.p) <= length(en) THEN replace(made, s.p, status) ELSE made END AS ru FROM a JOIN s ON s.p = split_part(made, '-', 1) || '-')
 SELECT l_orderkey, l_linenumber, x.ru || ' of ' || y.ru || ', ' || l_returnflag || '<>' || x.ru || '\\P' || l AS text FROM t JOIN r x ON x.en = l JOIN r y ON y.en = q""",
)
def apply_joined_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of some two pairs a line item (over 100,000 at sf0.01), applied through the joined index to a text a
    line item: two kinds of keys make a part's mark, which a third replaces where its turn is later."""
    t = table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("P"), "l_partkey", F.lit("-"))
    line, quote = F.concat(F.lit("L"), "l_orderkey", F.lit("."), "l_linenumber"), F.concat(F.lit("Q"), "l_orderkey", F.lit("."), "l_partkey")
    of = lambda kind, by, pos, en, ru: t.groupBy(*by).agg(F.min(ru).alias("ru")).select((pos + (kind << 50)).alias("pos"), en.alias("en"), "ru")
    pairs = of(0, ["l_orderkey", "l_linenumber"], F.col("l_orderkey") * 8 + F.col("l_linenumber"), line, F.concat(part, "l_suppkey"))
    pairs = pairs.unionByName(of(1, ["l_orderkey", "l_partkey"], F.col("l_orderkey") * (1 << 24) + F.col("l_partkey"), quote, F.concat(part, "l_linenumber")))
    pairs = pairs.unionByName(of(2, ["l_partkey"], F.col("l_partkey"), part, F.concat("l_returnflag", "l_linenumber")))
    text = F.concat(line, F.lit(" of "), quote, F.lit(", "), "l_returnflag", F.lit("<>"), line, F.lit("\\P"), line)
    return apply.apply_to_texts(t.select("l_orderkey", "l_linenumber", text.alias("text")), pairs)


PART_PAIRS = [("Brand", "MARK"), ("ar", "AR"), ("e", "3"), ("3", "e3"), ("P", "q")]


@query("apply_protected", f"SELECT p_partkey AS id, {nested(chr(39) + ' ' + chr(39) + ' || p_name', PART_PAIRS)} || '<>' || {nested('p_type', PART_PAIRS)} || '\\P' || p_brand || chr(160) AS text FROM part")
def apply_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.apply_to_texts(composed(spark, sf_dir), PART_PAIRS)


def _applied_sql() -> str:
    whole = f"CASE WHEN text = ' <> ' OR text = chr(160) THEN text ELSE ' ' || {nested('p_name', PART_PAIRS)} || '<>' || {nested('p_type', PART_PAIRS)} || '\\P' || p_brand END"
    styled = "('TEXT', 'MTEXT', 'ATTRIB', 'ATTDEF')"
    return (
        f"SELECT entity_ix, dxftype, CASE WHEN dxftype IN ({', '.join(map(LIT, TARGETS))}) AND dxftype <> 'TABLE' THEN {whole} ELSE text END AS text, CASE WHEN dxftype IN {styled} THEN 'RU' ELSE 'Standard' END AS style,"
        f" CASE WHEN dxftype = 'TABLE' THEN {nested('p_name', PART_PAIRS)} || '||' || {nested('p_type', PART_PAIRS)} || '|' || {nested('p_brand', PART_PAIRS)} ELSE p_name || '||' || p_type || '|' || p_brand END AS cells FROM ({ENTITIES_SQL})"
    )


@query("apply_entities", _applied_sql())
def apply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply.apply_to_entities(entities(spark, sf_dir), PART_PAIRS)
    return done.select("entity_ix", "dxftype", "text", "style", F.array_join(F.flatten("cells"), "|").alias("cells"))


@query(
    "batch_plan",
    f"SELECT rn, text_en, floor((rn - 1) / greatest(1, n // 20))::BIGINT AS batch, least(100, floor(rn::DOUBLE / n * 100))::INTEGER AS percent FROM ({RANK_SQL}), (SELECT count(*) AS n FROM ({FREQ_SQL}))",
)
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = frequency.ranked(keys(spark, sf_dir))
    n = ranked.count()
    return frequency.batches(ranked, frequency.pipeline_batch_size(n)).select("rn", "text_en", "batch", T.percent("rn", F.lit(n)).alias("percent"))


@query(
    "strict_level",
    "SELECT v, c, CASE WHEN c <= 0.34 THEN 'low' WHEN c <= 0.67 THEN 'medium' ELSE 'high' END AS level FROM (SELECT v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(v, 0.5))) AS c FROM (SELECT DISTINCT CASE WHEN l_discount = 0.05::DOUBLE THEN NULL ELSE l_discount * 20 - 0.4::DOUBLE END AS v FROM lineitem))",
)
def strict_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_discount") != 0.05, F.col("l_discount") * 20 - F.lit(0.4))
    values = table(spark, sf_dir, "lineitem").select(v.alias("v")).distinct().withColumn("c", T.clamp("v"))
    return values.withColumn("level", T.strict_level("c"))


#: Fixed values, stated here on their own: the note that a request carries by mode and level.
NOTE_SQL = """CASE WHEN m = 'effort' AND lv = 'low' THEN 'Keep reasoning effort minimal to prioritise speed over exhaustive detail.'
 WHEN m = 'effort' AND lv = 'medium' THEN 'Balance reasoning effort to maintain accuracy without unnecessary verbosity.'
 WHEN m = 'effort' AND lv = 'high' THEN 'Apply high reasoning effort to maximise translation accuracy and nuance.'
 WHEN lv = 'low' THEN 'Keep the response concise while still delivering an accurate translation.'
 WHEN lv = 'medium' THEN 'Provide a balanced level of detail to ensure clarity and accuracy.'
 ELSE 'Provide exhaustive detail to ensure every nuance of the translation is captured.' END"""


@query(
    "request_settings",
    f"""SELECT s_suppkey, model, CASE WHEN model = 'GPT-5' THEN {NOTE_SQL} ELSE '' END AS note, CASE WHEN model <> 'GPT-5' THEN 0.2::DOUBLE END AS temperature
 FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'GPT-5' ELSE 'other' END AS model, CASE WHEN s_nationkey % 3 = 0 THEN 'effort' ELSE 'verbosity' END AS m,
 CASE WHEN s_suppkey % 3 = 0 THEN 'low' WHEN s_suppkey % 3 = 1 THEN 'medium' ELSE 'high' END AS lv FROM supplier)""",
)
def request_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    model = F.when(F.col("s_nationkey") % 2 == 0, "GPT-5").otherwise("other")
    mode = F.when(F.col("s_nationkey") % 3 == 0, " Effort ").otherwise("unknown")
    level = F.when(F.col("s_suppkey") % 3 == 0, "low").when(F.col("s_suppkey") % 3 == 1, "medium").otherwise("high")
    return s.select("s_suppkey", model.alias("model"), T.reasoning_note(model, mode, level).alias("note"), T.request_temperature(model, F.lit(0.2)).alias("temperature"))


@query("request_payload", "SELECT (rn - 1) // 16 AS batch, (rn - 1)::VARCHAR AS id, text FROM (SELECT row_number() OVER (ORDER BY item_id) AS rn, text FROM benchmark)")
def request_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frequency.dense(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    sent = providers.requests(rows.select("rn", "text"))
    items = F.from_json("payload", "items array<struct<id:string,text:string>>")["items"]
    return sent.select("batch", F.inline(items))


@query("request_batches", f"SELECT (rn - 1) // 16 AS batch, (rn - 1)::VARCHAR AS id, text_en AS text FROM ({RANK_SQL})")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of sixteen of the ranked keys each, made by the table function from a call in SQL."""
    table_functions.register(spark)
    ranked = frequency.ranked(keys(spark, sf_dir)).select("rn", F.col("text_en").alias("text"), F.floor((F.col("rn") - 1) / 16).cast("long").alias("batch"))
    sent = spark.sql("SELECT * FROM request_batches(TABLE({rows}) PARTITION BY batch ORDER BY rn)", rows=ranked)
    return sent.select("batch", F.inline(F.from_json("payload", "items array<struct<id:string,text:string>>")["items"]))


@query("response_parse", "SELECT turn AS pos, conv_id::VARCHAR AS id, text, rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank FROM conversations)")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    item = F.struct("turn", F.struct(F.concat_ws("/", "conv_id", "turn").alias("id"), "text").alias("i"))
    replies = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["i"]).alias("translations"))).alias("payload"))
    got = providers.parsed(replies)
    return got.select(F.split("id", "/")[1].cast("long").alias("pos"), F.split("id", "/")[0].alias("id"), "text", F.col("pos").alias("place"))


@query("attribs_flatten", "SELECT 'BLOCK:' || l_orderkey || ':ATTRIB' AS kind, l_returnflag AS detail, l_linestatus || l_linenumber AS text FROM lineitem")
def attribs_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("l_returnflag").alias("tag"), F.concat("l_linestatus", "l_linenumber").alias("text"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("attribs"))
    return flatten.text_bag(_block_entity(rows, "INSERT", "attribs"))


@query(
    "table_cells_flatten",
    "SELECT 'BLOCK:' || l_orderkey || ':TABLE' AS kind, 'r' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) || 'c0' AS detail, l_shipdate::DATE::VARCHAR AS text FROM lineitem",
)
def table_cells_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_shipdate").cast("date").cast("string"), F.lit(" ")).alias("row"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["row"]).alias("cells"))
    return flatten.text_bag(_block_entity(rows, "TABLE", "cells"))


def _block_entity(rows: DataFrame, kind: str, column: str) -> DataFrame:
    null: dict[str, Column] = {
        "attribs": F.lit(None).cast("array<struct<tag:string,text:string>>"),
        "cells": F.lit(None).cast("array<array<string>>"),
        "alternatives": F.lit(None).cast("array<string>"),
    }
    own = {c: F.col(c) if c == column else v for c, v in null.items()}
    return rows.select(F.lit("block").alias("space"), F.col("l_orderkey").cast("string").alias("container"), F.lit(kind).alias("dxftype"), F.lit("").alias("text"), F.lit("").alias("tag"), *(v.alias(c) for c, v in own.items()))


@query("output_settings", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'dwg' WHEN c_custkey % 3 = 1 THEN 'dxf' ELSE 'dwg' END AS format, c_name || '_ru.dwg' AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'EN' END AS deepl_lang FROM customer")
def output_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.when(F.col("c_custkey") % 3 == 0, "DWG")
    path = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 2, F.lit(".DWG")).otherwise(F.lit(".dxf")))
    lang = F.when(F.col("c_nationkey") % 2 == 0, "en").otherwise("auto")
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.output_format(fmt, path).alias("format"), F.concat(T.with_suffix(path, F.lit("")), F.lit("_ru.dwg")).alias("path"), T.provider_language(lang, "deepl").alias("deepl_lang"))


@query("pipeline_noop", f"SELECT rn, count, text_en, text_en AS text_ru FROM ({RANK_SQL})")
def pipeline_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localise.run_bag(lines(spark, sf_dir), providers.Options("noop")).translated


@query("pipeline_summary", f"SELECT NULL::VARCHAR AS output_path, 'noop' AS backend, false AS map_saved, false AS extracted_txt_saved, false AS translated_txt_saved, count(*) AS items_translated FROM ({FREQ_SQL})")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localise.run_bag(lines(spark, sf_dir), providers.Options("identity")).summary


@query(
    "pipeline_dictionary",
    f"WITH f AS (SELECT trim(p_type, '{WS}') AS text_en, count(*) AS count FROM part GROUP BY 1) SELECT row_number() OVER (ORDER BY count DESC, text_en) AS rn, count, text_en, CASE WHEN text_en = 'LARGE' THEN 'GROSS' WHEN text_en = 'SMALL' THEN 'KLEIN' ELSE text_en END AS text_ru FROM f",
)
def pipeline_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = flatten.bag_of(table(spark, sf_dir, "part"), F.col("p_brand"), F.lit(""), F.col("p_type"))
    return localise.run_bag(bag, providers.Options("dictionary", dictionary={"LARGE": "GROSS", "SMALL": "KLEIN"})).translated


def line_bag(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """kind, detail and text of the lines of some documents, stripped."""
    docs = table(spark, sf_dir, "documents").where(where).select("source", "lang", F.explode(F.split("text", "\n")).alias("line"))
    return flatten.bag_of(docs, F.col("source"), F.col("lang"), T.strip("line"))


def line_keys(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return frequency.text_frequency(line_bag(spark, sf_dir, where))


@query(
    "translation_memory",
    f"""WITH l AS (SELECT doc_id, trim(line, '{WS}') AS text_en FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, '{WS}') <> ''),
 f AS (SELECT text_en, min(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END) AS run FROM l GROUP BY 1)
 SELECT text_en, text_en AS text_ru, run, 1::BIGINT AS requests FROM f""",
)
def translation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over overlapping bags (documents of even ids, all, all again) with one memory: what each distinct text
    was translated to, the run that asked for it, and how often any did."""
    held = memory.Memory(spark, fresh_path(spark, "memory"))
    runs = [memory.translate(line_keys(spark, sf_dir, where), providers.Options("noop"), held).withColumn("run", F.lit(i)) for i, where in enumerate(("doc_id % 2 = 0", "true", "true"), 1)]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2])
    sent = F.col("requested").cast("long")
    return every.groupBy("text_en").agg(F.max("text_ru").alias("text_ru"), F.min(F.when(F.col("requested"), F.col("run"))).alias("run"), F.sum(sent).alias("requests"))


# --- Sources and sinks: files written from the driver tables and read again ---


def written(spark: SparkSession, name: str, write) -> str:
    """A fresh path that write(path) has filled."""
    path = fresh_path(spark, name)
    write(path)
    return path


def ranked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.ranked(frequency.text_frequency(flatten.bag_of(table(spark, sf_dir, "part"), F.col("p_brand"), F.lit(""), shapes())))


def shapes() -> Column:
    """Texts as drawings hold them: quotes, commas, line feeds, edge spaces."""
    return F.concat(F.lit(' "'), "p_type", F.lit('",\n'), F.substring("p_name", 1, 3), F.lit(" "))


SHAPES_SQL = "' \"' || p_type || '\",' || chr(10) || left(p_name, 3) || ' '"
TYPES_SQL = f"SELECT t AS text_en, n AS count, row_number() OVER (ORDER BY n DESC, t) AS rn FROM (SELECT trim({SHAPES_SQL}, '{WS}') AS t, count(*) AS n FROM part GROUP BY 1)"


@query("extract_csv", f"SELECT count, text_en FROM ({TYPES_SQL})")
def extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_extract(spark, written(spark, "extract.csv", lambda p: sinks.write_frequency_csv(ranked_types(spark, sf_dir), p)))


@query("frequency_json_file", f"SELECT count, text_en FROM ({TYPES_SQL})")
def frequency_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_frequency_json(spark, written(spark, "extract.json", lambda p: sinks.write_frequency_json(ranked_types(spark, sf_dir), p)))


@query("frequency_txt_file", f"SELECT unnest(string_split('[' || count || '] ' || text_en, chr(10))) AS value FROM ({TYPES_SQL})")
def frequency_txt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(written(spark, "extract.txt", lambda p: sinks.write_frequency_txt(ranked_types(spark, sf_dir), p)))


@query("translated_txt_file", f"SELECT '[' || count || '] ' || upper(replace(text_en, chr(10), '')) AS value FROM ({TYPES_SQL}) WHERE rn <= 20")
def translated_txt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer side's rest is cut: translations of the first twenty keys."""
    keys = ranked_types(spark, sf_dir)
    ru = keys.where("rn <= 20").select("rn", F.upper(F.replace("text_en", F.lit("\n"), F.lit(""))).alias("text_ru"))
    return spark.read.text(written(spark, "ru.txt", lambda p: sinks.write_translated_txt(keys, ru, p)))


@query("map_csv", f"SELECT text_en, ' ' || upper(text_en) AS text_ru FROM ({TYPES_SQL})")
def map_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ranked_types(spark, sf_dir).withColumn("text_ru", F.concat(F.lit(" "), F.upper("text_en")))
    return files.read_csv(spark, written(spark, "map.csv", lambda p: sinks.write_map_csv(pairs, p)))


@query(
    "csv_dictionary",
    f"SELECT en, ru FROM (SELECT trim(CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE {SHAPES_SQL} END, '{WS}') AS en, trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE ' ' || p_brand END, '{WS}') AS ru FROM part) WHERE en <> ''",
)
def csv_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank keys go, blank values and repeated keys stay."""
    en, ru = F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(shapes()), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "p_brand"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rn"), en.alias("text_en"), ru.alias("text_ru"))
    return files.read_csv_dictionary(spark, written(spark, "dictionary.csv", lambda p: sinks.write_map_csv(rows, p))).select("en", "ru")


TEXT_PAIRS_SQL = "SELECT row_number() OVER (ORDER BY c_custkey) AS rn, c_custkey % 9 + 1 AS n, ' ' || c_name AS en, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE upper(c_name) || ',\"' END AS ru FROM customer"


@query(
    "files_in_order",
    f"""SELECT 'csv' AS kind, rn, trim(en) AS en, ru FROM ({TEXT_PAIRS_SQL}) UNION ALL SELECT 'extract', rn, en, n::VARCHAR FROM ({TEXT_PAIRS_SQL})
 UNION ALL SELECT 'text', rn, en, ru FROM (SELECT rn, trim(en) AS en FROM ({TEXT_PAIRS_SQL})) JOIN (SELECT row_number() OVER (ORDER BY rn) AS rn, ru FROM ({TEXT_PAIRS_SQL}) WHERE ru <> '') USING (rn)""",
)
def files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of several files, each twice as large as the one before it, read back: every row keeps its place, every
    pair its partner, in a CSV dictionary, an extract and paired texts."""
    keys = frequency.dense(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    blank = F.col("c_custkey") % 7 == 0
    rows = keys.select("rn", (F.col("c_custkey") % 9 + 1).alias("count"), F.concat(F.lit(" "), "c_name").alias("text_en"), F.when(blank, "").otherwise(F.concat(F.upper("c_name"), F.lit(',"'))).alias("text_ru"))
    rows = rows.repartitionByRange(8, F.floor(F.log2("rn"))).sortWithinPartitions("rn")  # all of a file's rows come before the next one's
    csv = lambda columns, name: written(spark, name, lambda p: rows.select(*columns).write.options(**sinks.CSV_OUT).csv(p))
    lines = lambda c, name: written(spark, name, lambda p: rows.select(c.alias("value")).write.text(p))
    pairs = files.read_csv_dictionary(spark, csv(("text_en", "text_ru"), "map")).select(F.lit("csv").alias("kind"), F.col("pos").alias("rn"), "en", "ru")
    extract = files.read_extract_in_order(spark, csv(("count", "text_en"), "extract")).select(F.lit("extract").alias("kind"), "rn", F.col("text_en").alias("en"), F.col("count").cast("string").alias("ru"))
    en, ru = lines(T.with_count("count", "text_en"), "en"), lines(F.col("text_ru"), "ru")
    texts = files.read_text_pair_dictionary(spark, en, ru).select(F.lit("text").alias("kind"), F.col("pos").alias("rn"), "en", "ru")
    return pairs.unionByName(extract).unionByName(texts)


LINES_SQL = "SELECT p_partkey AS ix, '[' || p_size || '] ' || p_type AS en, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE ' ' || upper(p_name) END AS ru FROM part"


@query(
    "text_pair_dictionary",
    rf"""WITH l AS (SELECT row_number() OVER (ORDER BY ix) AS rn, regexp_replace(en, '^\[\d+\]\s*', '') AS en FROM ({LINES_SQL})),
 r AS (SELECT row_number() OVER (ORDER BY ix) AS rn, trim(ru) AS ru FROM ({LINES_SQL}) WHERE trim(ru) <> '')
 SELECT en, arg_min(ru, rn) AS ru, min(rn) AS pos FROM l JOIN r USING (rn) GROUP BY en""",
)
def text_pair_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines go on one side only, which shifts that side; the first value of a key wins."""
    p = table(spark, sf_dir, "part")
    en, ru = F.concat(F.lit("["), "p_size", F.lit("] "), "p_type"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    one = lambda c, name: written(spark, name, lambda path: p.select("p_partkey", c.alias("value")).repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path))
    return files.read_text_pair_dictionary(spark, one(en, "en.txt"), one(ru, "ru.txt")).select("en", "ru", "pos")


JSON_MAP_SQL = "SELECT n_name AS text_en, CASE WHEN n_nationkey % 4 = 0 THEN n_name || chr(10) || '\"' ELSE lower(n_name) END AS text_ru FROM nation"


def nation_map(spark: SparkSession, sf_dir: str) -> str:
    """A flat JSON object in a file."""
    ru = F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit('\n"'))).otherwise(F.lower("n_name"))
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", ru)))).alias("value"))  # 25 rows
    return written(spark, "translations.json", whole.write.text)


@query("json_map", JSON_MAP_SQL)
def json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_json_map(spark, nation_map(spark, sf_dir))


@query("coverage_run", f"SELECT n AS count, text_en, text_ru, true AS in_map FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey JOIN ({JSON_MAP_SQL}) ON text_en = n_name")
def coverage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage check over files: the extract is enriched in place and the map is written."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count().join(table(spark, sf_dir, "nation"), "n_nationkey")
    extract = written(spark, "extracted.csv", lambda p: sinks.write_frequency_csv(frequency.ranked(counts.select("count", F.col("n_name").alias("text_en"))), p))
    into = fresh_path(spark, "map.csv")
    localise.check_and_enrich(spark, nation_map(spark, sf_dir), extract, into)
    known = files.read_csv(spark, into).select("text_en", F.lit(True).alias("in_map"))
    return files.read_csv(spark, extract).withColumn("count", F.col("count").cast("long")).join(known, "text_en", "left")


@query("dictionary_guards", "SELECT count(*) FILTER (WHERE n_nationkey < 0) = 0 AS refuses_empty, count(*) = 0 AS refuses_full, 25 - count(*) FILTER (WHERE n_nationkey % 2 = 0) AS missing FROM nation")
def dictionary_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks refuse: an empty dictionary, and a map that lacks keys, with their number."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text_en"), F.lit("x").alias("text_ru"))

    def refused(check, *tables: DataFrame) -> str | None:
        try:
            check(*tables)
        except PySparkValueError as e:
            return str(e)
        return None

    lacking = refused(dictionary.check_coverage, n, n.where("n_nationkey % 2 = 0")) or "0"
    row = (refused(dictionary.check_not_empty, n.where("n_nationkey < 0")) is not None, refused(dictionary.check_not_empty, n) is not None, int(lacking.split()[0]))
    return spark.createDataFrame([row], "refuses_empty boolean, refuses_full boolean, missing long")


@query("reply_messages", "SELECT conv_id, turn, CASE WHEN text = '' THEN 'other' ELSE text END AS message FROM conversations")
def reply_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat replies of several shapes, the first choice empty in some: the first text that is not."""

    def run(parts):
        for pdf in parts:
            found = []
            for i, text in enumerate(pdf["text"]):
                message = {"content": text if i % 2 else [{"text": text[:3]}, text[3:]]}
                choice = {"message": message} if i % 3 else {"text": text}
                found.append(providers.message_of({"choices": [{"message": {"content": ""}}, choice, {"text": "other"}]}))
            yield pdf[["conv_id", "turn"]].assign(message=found)

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, message string")


@query("default_outputs", "SELECT c_custkey, 'd.1/' || c_name || '_ru.dxf' AS output, 'd.1/' || c_name || '_map.csv' AS map, 'd.1/' || c_name || '_texts.txt' AS texts, 'd.1/' || c_name || '_texts_ru.txt' AS translated FROM customer")
def default_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d.1/"), "c_name", F.when(F.col("c_custkey") % 2 == 0, ".DWG").otherwise(".dxf"))
    return table(spark, sf_dir, "customer").select("c_custkey", *(T.default_path(path, k, "dxf").alias(k) for k in ("output", "map", "texts", "translated")))


# --- Drawings: files made from part, a hundred parts each ---

DRAWN = ("TEXT", "MTEXT", "ATTDEF", "DIMENSION", "LINE")


def drawings(spark: SparkSession, sf_dir: str) -> str:
    """A folder of drawings in two code pages; every fifth file lies below a folder of its own."""
    p = table(spark, sf_dir, "part")
    line = lambda code, value: F.concat(F.lit(f"{code:>3}\r\n"), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))
    kind = F.element_at(F.array(*map(F.lit, DRAWN)), F.pmod("p_partkey", F.lit(len(DRAWN))).cast("int") + 1)
    mtext = F.concat(line(3, F.concat(F.lit("{\\fArial|b0;"), "p_name", F.lit("}"))), line(1, F.concat(F.lit("\\P\\A1;é "), "p_type")))
    body = F.when(kind == "MTEXT", mtext).when(kind == "DIMENSION", line(1, F.concat(F.lit("<> é "), "p_type"))).otherwise(line(1, F.concat("p_type", F.lit(" é"))))
    tag = F.when(kind == "ATTDEF", line(2, F.col("p_brand"))).otherwise("")
    style = F.when(kind != "DIMENSION", line(7, "Standard")).otherwise("")
    layout = F.when(F.col("p_size") % 2 == 0, line(410, "Sheet")).otherwise("")
    entity = F.concat(line(0, kind), layout, body, tag, style)
    drawing = F.floor(F.col("p_partkey") / 100).cast("long").alias("drawing")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", entity.alias("e")))), lambda x: x["e"]), "")  # at most 100
    page = F.when(F.col("drawing") % 2 == 0, F.concat(line(1, "AC1015"), line(9, "$DWGCODEPAGE"), line(3, "ANSI_1252"))).otherwise(line(1, "AC1032"))
    head = F.concat(line(0, "SECTION"), line(2, "HEADER"), line(9, "$ACADVER"), page, line(0, "ENDSEC"), line(0, "SECTION"), line(2, "ENTITIES"))
    whole = F.concat(head, "texts", line(0, "ENDSEC"), line(0, "EOF"))
    content = F.when(F.col("drawing") % 2 == 0, F.encode(whole, "ISO-8859-1")).otherwise(F.encode(whole, "UTF-8"))
    name = F.concat(F.when(F.col("drawing") % 5 == 0, F.concat(F.lit("sub/d"), "drawing")).otherwise(F.concat(F.lit("d"), F.floor(F.col("drawing") / 5) * 5)), F.lit("."), F.col("drawing"), F.lit(".dxf"))
    made = p.groupBy(drawing).agg(texts.alias("texts")).select(name.alias("name"), content.alias("content"))
    return written(spark, "drawings", lambda path: dxf.write_files(made, path).count())


def drawn_sql(replaced: str) -> str:
    """kind, layout and text of the drawings' entities, by p_partkey; replaced: p_type in the texts."""
    kinds = "[" + ", ".join(map(LIT, DRAWN)) + "]"
    return f"""SELECT p_partkey, dxftype, CASE WHEN p_size % 2 = 0 THEN 'Sheet' ELSE 'Model' END AS container, CASE WHEN dxftype = 'MTEXT' THEN p_name || chr(10) || 'é ' || {replaced}
 WHEN dxftype = 'DIMENSION' THEN '<> é ' || {replaced} WHEN dxftype = 'LINE' THEN NULL ELSE {replaced} || ' é' END AS text
 FROM (SELECT *, {kinds}[(p_partkey % {len(DRAWN)}) + 1] AS dxftype FROM part)"""


@query("drawing_entities", f"SELECT dxftype, container, text, count(*) AS n FROM ({drawn_sql('p_type')}) GROUP BY ALL")
def drawing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.read_entities(spark, drawings(spark, sf_dir)).groupBy("dxftype", "container", "text").agg(F.count(F.lit(1)).alias("n"))


@query("drawing_frequency", f"SELECT trim(text, '{WS}') AS text_en, count(*) AS count FROM ({drawn_sql('p_type')}) WHERE text IS NOT NULL GROUP BY 1")
def drawing_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command extract over a folder of drawings, its CSV read again."""
    from .. import cli

    out = fresh_path(spark, "extract.csv")
    with contextlib.redirect_stdout(io.StringIO()):
        cli.run(spark, cli.parser().parse_args(["extract", drawings(spark, sf_dir), "--csv", out]))
    return files.read_extract(spark, out)


TYPE_PAIRS = [("STANDARD", "стандарт"), ("SMALL", "малый <>"), ("é", "e"), ("AR", "ar")]


@query("drawing_apply", f"SELECT dxftype, container, text, CASE WHEN dxftype IN ('TEXT', 'MTEXT', 'ATTDEF') THEN 'RU' WHEN dxftype = 'LINE' THEN 'Standard' END AS style, count(*) AS n FROM (SELECT dxftype, container, {nested('text', apply.ordered(TYPE_PAIRS))} AS text FROM ({drawn_sql('p_type')})) GROUP BY ALL")
def drawing_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command apply with a CSV dictionary over a folder of drawings, which are read again from where it
    wrote them: code pages, styles and names of files as they were."""
    from .. import cli

    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(TYPE_PAIRS, 1)], "rn long, text_en string, text_ru string")
    mapping, out = f"{fresh_path(spark, 'map')}/map.csv", fresh_path(spark, "applied")
    sinks.write_map_csv(pairs, mapping)
    with contextlib.redirect_stdout(io.StringIO()):
        cli.run(spark, cli.parser().parse_args(["apply", drawings(spark, sf_dir), mapping, out]))
    return dxf.read_entities(spark, out).groupBy("dxftype", "container", "text", "style").agg(F.count(F.lit(1)).alias("n"))


from . import shop  # noqa: E402, F401  registers its queries
