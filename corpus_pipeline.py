"""The training-text pipeline: toxic documents go, repeated lines go, one document of each group of
near-duplicates stays, sources are mixed to their weights, and the mix is encoded.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever other columns there
are. In every stage an empty table gives an empty table, and a null id is a document like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import bpe, line_dedup, mixing, near_dup, toxicity
from glossweave.llm.common import materialize, release, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5. Labels come from the table labels, outside fold 0; without any toxic
    or clean ones nothing is rejected. Null and empty texts are scored as texts without words; repeated rows
    and rows without id are scored each, and ties cannot occur. Null languages and sources do not matter."""
    return toxicity.accept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in 5 documents or more stay in the largest doc_id only; n_chars
    follows the text. Documents stay, even if no text is left. Null texts stay null, with their n_chars. Rows
    of one id are one document, in counting and in keeping; a null id counts for no line and keeps none."""
    out = line_dedup.replace_text(line_dedup.build(docs), docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles of similarity 0.8 or more; of a group
    without ids the document first by the digest of its text. Repeated rows (one id, one text) are one document
    and stay or go together; rows of one id with other texts are linked by their own sets. Null and wordless
    texts are linked with nothing and stay."""
    return near_dup.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times each. A null source is a source of its own,
    ranked last. Null and empty texts have no words: they cost nothing and come with the blocks that they
    are in. Repeated rows and ties of the hash are drawn alike."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and digests of the ids and the decoded text, a row
    a row of docs. Null and empty texts have no ids; null ids and repeated rows stay."""
    out = bpe.encode(docs)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained scores, sketches and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(last)
    return docs
