"""Orphan and unprocessed epochs, retention, shard merges, and facts about stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.operators.batching import numbered

KEY = ["epoch_type", "aggregator_id", "sequence"]
#: Epochs around the newest complete one that recovery looks at.
NEAR = 5


def orphans(rows: DataFrame, done: DataFrame, near: int = NEAR) -> DataFrame:
    """Epochs (KEY) that have rows but no completion marker, within `near` of the newest marker; all, if there is none."""
    newest = done.groupBy("epoch_type", "aggregator_id").agg(F.max("sequence").alias("newest"))
    there = rows.select(*KEY).distinct().join(done.select(*KEY), KEY, "left_anti")
    return there.join(newest, ["epoch_type", "aggregator_id"], "left").where(F.col("newest").isNull() | (F.abs(F.col("sequence") - F.col("newest")) <= near)).select(*KEY)


def without_orphans(rows: DataFrame, done: DataFrame, near: int = NEAR) -> DataFrame:
    return rows.join(orphans(rows, done, near), KEY, "left_anti")


def complete(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of epochs that are marked complete: what readers see."""
    return rows.join(done.select(*KEY), KEY, "left_semi")


def unprocessed(raw: DataFrame, done: DataFrame, epoch_type: str) -> DataFrame:
    """(aggregator_id, sequence) of raw epochs without a marker of this type."""
    mine = done.where(F.col("epoch_type") == epoch_type).select("aggregator_id", "sequence")
    return raw.select("aggregator_id", "sequence").distinct().join(mine, ["aggregator_id", "sequence"], "left_anti")


def droppable(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Per aggregator the raw epochs up to the first that isn't processed."""
    state = raw.select("aggregator_id", "sequence").distinct().join(done.select("aggregator_id", "sequence").distinct().withColumn("ready", F.lit(True)), ["aggregator_id", "sequence"], "left")
    first = state.where("ready is null").groupBy("aggregator_id").agg(F.min("sequence").alias("first_open"))
    return state.join(first, "aggregator_id", "left").where("first_open is null or sequence < first_open").select("aggregator_id", "sequence")


def merged_shards(shards: list[DataFrame], key: list[str] | None = None, order: str = "ingest_time_ms") -> DataFrame:
    """Shards as one table, the first row of each key by `order`, then the smallest as JSON."""
    key = key or KEY
    rows = reduce(DataFrame.unionByName, shards)
    first = Window.partitionBy(*key).orderBy(order, F.to_json(F.struct(*rows.columns)))
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def header_bodies(headers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Headers with their bodies, by epoch type, aggregator and sequence."""
    return headers.join(bodies, KEY, "inner")


def store_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table: rows, least and greatest sequence."""
    facts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"), F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, facts)


def source_dictionary(known: DataFrame, seen: DataFrame, head: int = 7) -> DataFrame:
    """known(source_key, source_id) and, for new keys of seen(source_key), the next ids in order of key."""
    new = seen.select("source_key").distinct().join(known, "source_key", "left_anti")
    top = known.agg(F.coalesce(F.max("source_id"), F.lit(-1)).alias("top"))
    # numbered by slices of keys with the same beginning, not in one pass over all
    sliced = new.withColumns({"all": F.lit(0), "head": F.substring("source_key", 1, head)})
    ids = numbered(sliced, ["all"], ["source_key"], "head").crossJoin(F.broadcast(top)).select("source_key", (F.col("top") + 1 + F.col("n")).cast("long").alias("source_id"))
    return known.select("source_key", F.col("source_id").cast("long").alias("source_id")).unionByName(ids)
