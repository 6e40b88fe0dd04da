"""Point-in-time feature join by a range-frame window, with DataFrame operations only.

A label asks at a time for the version of its key that had arrived and not expired by then; the latest event
wins, then the earliest arrival, then the largest id. Versions and questions are united, and a range frame over
the event time collects the versions of the longest lifetime before each question; the arrays are filtered on
arrival and expiry, and the largest struct is the winner.

A key may hold any share of the rows, so no window holds a whole key: time is cut into spans of one lifetime,
every version is lent to the span after its own, and a window holds one span of one key. Before that, versions
of one key and event are thinned to those that can win at some time (a later one in the order of preference
stays only if it expires after all before it), and questions of one key and time are asked once. What a
window holds is then bounded by the time that it spans, however many rows fall into it. Nothing is broadcast
by hint, and nothing but the longest lifetime (one number) goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Fixed values of the contract: seconds of event time, arrival before and after it, life, and freshness.
EVENTS, LEAD, DELAYS, LIFE, FRESH = 50_000, 60, 600, 900, 120


def thinned(versions: DataFrame) -> DataFrame:
    """versions: key, event, arrival, expiry, id, payload. Those that win at some time among the versions of their
    key and event, for whatever questions; exact repeats keep the largest id and payload."""
    usable = versions.where("key is not null and event is not null and arrival < expiry and event < expiry")
    best = usable.groupBy("key", "event", "arrival", "expiry").agg(F.max(F.struct("id", "payload")).alias("best"))
    better = Window.partitionBy("key", "event").orderBy("arrival", F.col("best.id").desc(), F.col("expiry").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.max("expiry").over(better)
    return best.withColumn("lasts", lasts).where("lasts is null or lasts < expiry").drop("lasts")


def winners(versions: DataFrame, questions: DataFrame, lifetime: int) -> DataFrame:
    """questions: key, t, each once. Adds winner: the struct of event, later (minus its arrival), id and payload
    of the version that wins at t, null without any. lifetime: no version lives longer after its event."""
    spark, span = versions.sparkSession, max(1, lifetime)
    own = F.floor(F.col("event") / span)
    version = F.struct("event", (-F.col("arrival")).alias("later"), F.col("best.id").alias("id"), F.col("best.payload").alias("payload"), "expiry").alias("v")
    lent = thinned(versions).select("key", F.explode(F.array(own, own + 1)).alias("span"), F.col("event").alias("t"), version, F.lit(False).alias("asks"))
    asked = questions.select("key", F.floor(F.col("t") / span).alias("span"), "t", F.lit(None).cast(lent.schema["v"].dataType).alias("v"), F.lit(True).alias("asks"))
    rows = lent.unionByName(asked).repartition(shuffle_partitions(spark), "key", "span")
    seconds = rows.groupBy("key", "span", "t").agg(F.collect_list("v").alias("v"), F.max("asks").alias("asks"))
    frame = Window.partitionBy("key", "span").orderBy("t").rangeBetween(-span, 0)
    seen = seconds.withColumn("seen", F.collect_list(F.when(F.size("v") > 0, F.col("v"))).over(frame)).where("asks")
    alive = F.filter(F.flatten("seen"), lambda v: (-v["later"] <= F.col("t")) & (F.col("t") < v["expiry"]))
    return seen.select("key", "t", F.array_max(alive).alias("winner"))


def join(versions: DataFrame, labels: DataFrame, key: str, event: Column, arrival: Column, expiry: Column, version_id: Column, payload: Column, at: str) -> DataFrame:
    """labels with winner (event, later, id, payload), a row a row of labels, with all its columns.

    Times are whole numbers (seconds or any other unit). A null key on either side meets nothing; neither does a
    null time of a label; a version with a null event, arrival or expiry is never usable. Of equal event and
    arrival the largest id wins (null ids last), of repeated rows with one id the largest payload. Repeated
    labels are answered each. An empty table of versions answers nothing, an empty table of labels gives an empty
    table. Columns of labels may have any names but winner.
    """
    v = versions.select(F.col(key).alias("key"), event.cast("long").alias("event"), arrival.cast("long").alias("arrival"), expiry.cast("long").alias("expiry"), version_id.alias("id"), payload.alias("payload"))
    lifetime = v.where("arrival < expiry").agg(F.max(F.col("expiry") - F.col("event"))).first()[0] or 0
    row = labels.select(F.struct(*labels.columns).alias("row"), F.col(key).alias("key"), F.col(at).cast("long").alias("t"))
    can = F.col("key").isNotNull() & F.col("t").isNotNull()
    asked = row.where(can)
    found = winners(v, asked.select("key", "t").distinct(), lifetime)
    answered = asked.join(found.hint("merge"), ["key", "t"], "left").select("row", "winner")
    return answered.unionByName(row.where(~can).select("row", F.lit(None).cast(found.schema["winner"].dataType).alias("winner"))).select("row.*", "winner")


def numbers(doc_id: Column) -> list[Column]:
    """The first four groups of eight digits of the hexadecimal sha256 of the decimal id."""
    digest = F.sha2(doc_id.cast("string").cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def document_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a row of labels: doc_id, t, version_id, age, status, n_chars, lang. Documents are versions of
    their sources; a label asks about its document's source.

    A null id of a label, an id without a document and a null source give the status none (t is null only for a
    null id). Where documents repeat an id, a label asks about the largest of their sources, and each of the rows is
    a version of its own source. Null n_chars and lang of a winner stay null. Texts are not read, so
    empty and long ones do not matter; other columns are ignored. Empty tables as in join().
    """
    a, b, c, _ = numbers(F.col("doc_id"))
    event = a % EVENTS
    versions = docs.select("doc_id", "source", "n_chars", "lang", event.alias("event"), (b % DELAYS).alias("b"), (c % LIFE).alias("c"))
    asks = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("source").alias("source"))
    asked = asks.where("doc_id is not null").join(known.hint("merge"), "doc_id", "left").unionByName(asks.where("doc_id is null").withColumn("source", F.lit(None).cast("string")))
    asked = asked.withColumn("t", numbers(F.col("doc_id"))[3] % EVENTS)
    e = F.col("event")
    found = join(versions, asked, "source", e, e - LEAD + F.col("b"), e + F.col("c"), F.col("doc_id").cast("long"), F.struct(F.col("n_chars").cast("long").alias("n_chars"), "lang"), "t")
    age = F.col("t") - F.col("winner.event")
    status = F.when(F.col("winner").isNull(), "none").when(age > FRESH, "stale").otherwise("fresh")
    fresh = lambda c: F.when(status == "fresh", F.col(f"winner.payload.{c}")).alias(c)
    return found.select("doc_id", "t", F.col("winner.id").alias("version_id"), age.alias("age"), status.alias("status"), fresh("n_chars"), fresh("lang"))
