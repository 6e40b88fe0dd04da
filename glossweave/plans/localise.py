"""The engine's end-to-end runs: extract, translate, apply, check coverage."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply, dictionary, flatten, frequency, providers
from ..sources import files, sinks
from .tables import materialize

SUMMARY = "output_path string, backend string, map_saved boolean, extracted_txt_saved boolean, translated_txt_saved boolean, items_translated bigint"


@dataclass(frozen=True)
class Outputs:
    """Where side outputs go; each is written only if it is wanted and has a path."""

    texts_txt: str | None = None
    translated_txt: str | None = None
    map_csv: str | None = None
    save_txt: bool = True
    save_map: bool = True


def default_paths(input_path: str, fmt: str = "dwg") -> dict[str, str]:
    """Where output, map and texts go if nothing else is said: beside the input, named after it."""
    stem = input_path[: len(input_path) - len(Path(input_path).suffix)]
    return {"output": f"{stem}_ru.{fmt}", "map": f"{stem}_map.csv", "texts": f"{stem}_texts.txt", "translated": f"{stem}_texts_ru.txt"}


@dataclass(frozen=True)
class Result:
    translated: DataFrame  # rn, count, text_en, text_ru
    entities: DataFrame | None
    summary: DataFrame


def extract(bag: DataFrame) -> DataFrame:
    """count, text_en, rn of the distinct texts of a bag."""
    return frequency.ranked(frequency.text_frequency(bag))


def translated_keys(keys: DataFrame, options: providers.Options, steps: int = 20) -> DataFrame:
    """keys: rn, count, text_en. Adds text_ru; every key is sent once, in batches of a twentieth. Written once."""
    total = keys.count()
    return providers.translate(keys, options, frequency.pipeline_batch_size(total, steps)).select("rn", "count", "text_en", "text_ru")


def run_bag(bag: DataFrame, options: providers.Options, outputs: Outputs = Outputs(), output_path: str | None = None) -> Result:
    """Counts, ranks and translates the texts of a bag and writes the side outputs."""
    keys = extract(bag)
    done = translated_keys(keys, options)
    txt = sinks.write_if(outputs.save_txt, outputs.texts_txt, lambda p: sinks.write_frequency_txt(done.select("rn", "count", "text_en"), p))
    ru = sinks.write_if(outputs.save_txt, outputs.translated_txt, lambda p: sinks.write_translated_txt(done.select("rn", "count"), done.select("rn", "text_ru"), p))
    saved = sinks.write_if(outputs.save_map, outputs.map_csv, lambda p: sinks.write_map_csv(done, p))
    summary = done.agg(F.count(F.lit(1)).alias("items_translated")).select(
        F.lit(output_path).cast("string").alias("output_path"), F.lit(providers.backend(options)).alias("backend"),
        F.lit(saved).alias("map_saved"), F.lit(txt).alias("extracted_txt_saved"), F.lit(ru).alias("translated_txt_saved"), "items_translated",
    )
    return Result(done, None, summary)


def pairs_of(done: DataFrame) -> dictionary.Ordered | DataFrame:
    return dictionary.ordered_or_table(done.select(F.col("rn").alias("pos"), F.col("text_en").alias("en"), F.col("text_ru").alias("ru")))


def run_entities(entities: DataFrame, options: providers.Options, outputs: Outputs = Outputs(), output_path: str | None = None, style: str | None = apply.STYLE_NAME) -> Result:
    """As run_bag() for the texts of entities, and the entities with their texts replaced."""
    entities = materialize(entities, "entities")  # drawings are parsed once
    found = run_bag(flatten.text_bag(entities), options, outputs, output_path)
    return Result(found.translated, apply.apply_to_entities(entities, pairs_of(found.translated), style), found.summary)


def apply_dictionary(entities: DataFrame, mapping: str, source_en: str | None = None, style: str | None = apply.STYLE_NAME) -> DataFrame:
    """entities with a dictionary file applied: a .csv, or a .txt beside the texts it translates."""
    spark = entities.sparkSession
    if mapping.lower().endswith(".csv"):
        pairs = files.read_csv_dictionary(spark, mapping)
    elif mapping.lower().endswith(".txt") and source_en:
        pairs = files.read_text_pair_dictionary(spark, source_en, mapping)
    else:
        raise PySparkValueError("the dictionary is a .csv, or a .txt with source_en")
    dictionary.check_not_empty(pairs)
    return apply.apply_to_entities(entities, dictionary.ordered_or_table(pairs), style)


def check_and_enrich(spark: SparkSession, translations_json: str, extract_csv: str, map_csv: str) -> DataFrame:
    """Refuses missing or empty translations; then writes the map CSV and adds text_ru to the extract in
    place. Gives the enriched rows."""
    mapping, rows = files.read_json_map(spark, translations_json), files.read_extract_in_order(spark, extract_csv)
    dictionary.check_coverage(rows, mapping)
    done = materialize(dictionary.enriched(rows, mapping), "enriched")
    sinks.write_map_csv(done, map_csv)
    sinks.write_enriched_csv(done, extract_csv)
    return done.select("count", "text_en", "text_ru")
