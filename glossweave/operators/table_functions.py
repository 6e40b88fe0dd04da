"""Table functions, for SQL and DataFrames alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class RequestBatches:
    """The JSON request of each partition of a table with batch, rn and text, ids counted from 0 over all batches. A
    partition is one batch; its rows come in the order of the call. Null texts are sent as empty ones."""

    def __init__(self) -> None:
        self.batch, self.items = None, []

    def eval(self, row: Row) -> None:
        self.batch = row["batch"]
        self.items.append({"id": str(row["rn"] - 1), "text": row["text"] or ""})

    def terminate(self):
        if self.items:
            yield self.batch, json.dumps({"items": self.items}, ensure_ascii=False)


request_batches = F.udtf(RequestBatches, returnType="batch long, payload string")


def register(spark: SparkSession) -> None:
    """Makes request_batches(TABLE(...) PARTITION BY batch ORDER BY rn) known to SQL."""
    spark.udtf.register("request_batches", request_batches)


def requests(keys: DataFrame, size: int) -> DataFrame:
    """keys: rn, text. batch and payload, as providers.requests(), through the table function."""
    numbered = keys.select("rn", "text", F.floor((F.col("rn") - 1) / size).cast("long").alias("batch"))
    return request_batches(numbered.asTable().partitionBy("batch").orderBy("rn"))
