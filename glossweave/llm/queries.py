"""The queries opN_<name> of this folder's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, features, langid, line_dedup, mixing, near_dup, quality, search, sharding, spotsigs, token_counts, toxicity, warc
from .common import table
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.plan(table(spark, sf_dir, "documents"))
    taken = F.col("size") * F.size("draws")
    return drawn.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("draws.pass").alias("passes"), F.col("draws.shard").alias("shards"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels)).drop("passages")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.document_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_spotsigs": op10_spotsigs,
    "op11_search": op11_search,
    "op12_features": op12_features,
    "op13_token_counts": op13_token_counts,
}
