"""Runs from a checkpoint, also after a crash in the middle of a batch."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossweave.streaming import events


def test_a_crashed_run_goes_on(spark, tmp_path):
    """Every key is given out once, and windows hold the rows that were in time, whatever was tried before."""
    broken = tmp_path / "broken"
    source, schema = f"file://{tmp_path}/in", "at timestamp_ntz, key string"
    at = lambda lot, rows: spark.createDataFrame(rows, "at string, key string").select(F.col("at").cast("timestamp_ntz").alias("at"), "key").write.parquet(f"{source}/{lot}")

    def run(name, make):
        def fragile(batches):
            for pdf in batches:
                if broken.exists() and len(pdf):
                    raise RuntimeError("lost")
                yield pdf

        made = make(events.arrivals(spark, source, spark.createDataFrame([], schema).schema))
        made = made.mapInPandas(fragile, made.schema)
        events.run(made, f"file://{tmp_path}/{name}-checkpoint", f"file://{tmp_path}/{name}")
        return Counter(map(tuple, events.results(spark, f"file://{tmp_path}/{name}", made.schema).collect()))

    texts = lambda s: events.unseen(s, F.col("key"))
    windows = lambda s: events.closed_windows(s, "at", ["key"], "1 hour", "1 hour").select("key", "n")
    assert events.results(spark, f"file://{tmp_path}/none", spark.createDataFrame([], schema).schema).count() == 0
    at(0, [("2024-01-01 00:10:00", " a "), ("2024-01-01 00:20:00", "a"), ("2024-01-01 03:00:00", "b"), (None, ""), (None, None)])
    assert run("texts", texts) == {("a",): 1, ("b",): 1} and run("windows", windows) == {(" a ", 1): 1, ("a", 1): 1}
    at(1, [("2024-01-01 00:30:00", "late"), ("2024-01-01 03:30:00", "b"), ("2024-01-01 09:00:00", "c")])
    broken.touch()
    for name, make in (("texts", texts), ("windows", windows)):
        with pytest.raises(PySparkException):
            run(name, make)
    broken.unlink()
    assert run("texts", texts) == {(k,): 1 for k in ("a", "b", "late", "c")}
    assert run("windows", windows) == {(" a ", 1): 1, ("a", 1): 1, ("b", 2): 1}
    assert run("texts", texts) == {(k,): 1 for k in ("a", "b", "late", "c")}  # nothing new, nothing again
