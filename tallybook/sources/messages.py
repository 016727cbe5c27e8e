"""Committed batches as JSON messages: reading, writing, and the table form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.schemas import BATCH


def _bytes(numbers: Column) -> Column:
    """An array of byte values as a binary."""
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(F.pmod(b.cast("long"), F.lit(256))), 2, "0")), ""))


def _numbers(b: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: i <= F.length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))


def parsed(messages: DataFrame, column: str = "value", fail: bool = True) -> DataFrame:
    """Batches (ingest_time_ms, source_id, batch_seq, batch_hash, events) of JSON messages; empty ones are skipped.

    Missing source or sequence count as 0. A payload that isn't such JSON fails the micro-batch, so that its offsets
    are not committed; with fail=False it is left out.
    """
    text = F.col(column).cast("string")
    got = F.from_json(text, BATCH)
    bad = got.isNull() | got["events"].isNull()
    df = messages.withColumn("b", got)
    df = df.withColumn("b", F.when(bad, F.raise_error(F.concat(F.lit("not a batch: "), F.substring(F.coalesce(text, F.lit("null")), 1, 80))).cast(df.schema["b"].dataType)).otherwise(F.col("b"))) if fail else df.where(~bad)
    events = F.transform("b.events", lambda e: F.struct(_bytes(e["key_id"]).alias("key"), e["value"].alias("value"), e["ts"].alias("ts")))
    return df.select(
        F.col("b.ingest_time_ms").alias("ingest_time_ms"), F.coalesce("b.source_id", F.lit(0)).alias("source_id"), F.coalesce("b.source_batch_seq", F.lit(0)).cast("long").alias("batch_seq"),
        _bytes(F.col("b.batch_hash")).alias("batch_hash"), events.alias("events"),
    ).where(F.size("events") > 0)


def exploded(batches: DataFrame) -> DataFrame:
    """One row per event: (ingest_time_ms, source_id, batch_seq, pos, key, value, ts)."""
    return batches.select("ingest_time_ms", "source_id", "batch_seq", F.posexplode("events").alias("pos", "e")).select("ingest_time_ms", "source_id", "batch_seq", "pos", "e.key", "e.value", "e.ts")


def messages(batches: DataFrame, aggregators: int) -> DataFrame:
    """(key, value, partition) of batches, as a topic takes them."""
    events = F.transform("events", lambda e: F.struct(_numbers(e["key"]).alias("key_id"), e["value"].alias("value"), e["ts"].alias("ts")))
    body = F.struct("ingest_time_ms", "source_id", F.col("batch_seq").alias("source_batch_seq"), events.alias("events"), _numbers(F.col("batch_hash")).alias("batch_hash"))
    return batches.select(F.concat(F.lit("src"), F.col("source_id").cast("string")).alias("key"), F.to_json(body).alias("value"), (F.col("source_id") % aggregators).cast("int").alias("partition"))


def stream(spark: SparkSession, kind: str = "json", path: str | None = None, **options) -> DataFrame:
    """A stream of messages (value): lines of files below path, or a topic (kind "kafka", whose connector is added at deployment)."""
    if kind == "kafka":
        return spark.readStream.format("kafka").options(**options).load().selectExpr("cast(value as string) as value")
    return spark.readStream.options(**options).text(path)


def send(batches: DataFrame, aggregators: int, kind: str = "json", path: str | None = None, **options) -> None:
    """Writes the messages to files, or a topic."""
    out = messages(batches, aggregators)
    if kind == "kafka":
        out.write.format("kafka").options(**options).save()
    else:
        out.select("value").write.mode("append").options(**options).text(path)
