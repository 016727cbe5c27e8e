"""The driver's tables as telemetry: events with keys, sources, aggregators and epochs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.keys import be, key_from_u64, key_hi, key_lo, zeros
from tallybook.operators import batching, integrity, summaries
from tallybook.sources.shared import shared_dir, written
from tallybook.sources.tables import EpochStore

SOURCES, AGGREGATORS = 8, 4


def tele_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by user, a day an epoch, cents as values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and value is not null and ts is not null")
    df = e.select(
        "event_id", "event_type", F.col("user_id").cast("long").alias("key_lo"), F.round(F.col("value") * 100).cast("long").alias("value"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("sequence"),
    )
    return df.withColumns({
        "key_hi": F.lit(0).cast("long"), "key": key_from_u64(F.col("key_lo")), "source_id": (F.col("key_lo") % SOURCES).cast("int"), "ingest_time_ms": F.col("ts") * 1000,
    }).withColumn("aggregator_id", (F.col("source_id") % AGGREGATORS).cast("long"))


def tele_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines keyed by supplier and part, a thousand orders an epoch, quantities as values."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = li.select(
        "l_orderkey", "l_linenumber", F.shiftleft(F.col("l_suppkey").cast("long"), 32).bitwiseOR(F.col("l_partkey").cast("long")).alias("key_lo"), F.col("l_quantity").cast("long").alias("value"),
        F.col("l_orderkey").cast("long").alias("ts"), (F.col("l_suppkey") % SOURCES).cast("int").alias("source_id"), F.expr("l_orderkey div 1000").cast("long").alias("sequence"),
    )
    key = F.concat(zeros(7), be(F.col("key_lo"), 8))
    return df.withColumns({"key_hi": F.lit(0).cast("long"), "key": key, "aggregator_id": (F.col("source_id") % AGGREGATORS).cast("long"), "ingest_time_ms": F.col("ts") * 1000})


def batched(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    return batching.with_batches(events, list(order), slice_="sequence")


def epoch_headers(events: DataFrame) -> DataFrame:
    """What summaries.headers gives of `batched` events, from counts: no event is numbered.

    A source has one aggregator and an epoch is a slice, so that a source's events of an epoch follow each other: where
    they start and end says which batches they lie in.
    """
    per = events.groupBy(*summaries.EPOCH, "source_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("ingest_time_ms").alias("ingest_time_ms"), F.count("*").alias("c"))
    before = Window.partitionBy("source_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))  # one row for each source and epoch
    n_batches = F.expr(f"(start + c - 1) div {batching.BATCH_EVENTS} - start div {batching.BATCH_EVENTS} + 1")
    return placed.groupBy(*summaries.EPOCH).agg(
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.max("ingest_time_ms").alias("ingest_time_ms"), F.sum("c").alias("n_events"),
        F.sum(n_batches).alias("n_batches"), F.count("*").alias("n_sources"),
    ).withColumn("epoch_type", F.lit("samples_epoch"))


def claimed_batches(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(source_id, batch_seq, commit, prev_hash, batch_hash) of the events' batches."""
    return integrity.chained(integrity.committed(events, list(order), "sequence"))


def arrivals(events: DataFrame) -> DataFrame:
    """(source_id, batch_seq, arrival, ingest_time_ms, aggregator_id): the batches as they might arrive: some twice, some lost."""
    b = batched(events).groupBy("source_id", "batch_seq").agg(F.max("ingest_time_ms").alias("ingest_time_ms"), F.max("aggregator_id").alias("aggregator_id"))
    kept = b.where("(batch_seq + source_id) % 23 != 7")
    copies = kept.select("*", F.explode(F.when(F.col("batch_seq") % 11 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return copies.withColumn("arrival", F.col("batch_seq") * 2 + F.col("copy")).drop("copy")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epoch_seq, source_id, owner): a map every tenth day with events, sources dealt anew to one aggregator more or less; one source is unmapped each time."""
    e = tele_events(spark, sf_dir)
    maps = e.where("sequence % 10 = 0").select("sequence", "source_id").distinct()
    owner = F.col("source_id") % F.when(F.col("sequence") % 20 == 0, 3).otherwise(4)
    return maps.where("source_id != (sequence div 10) % 8").select(F.col("sequence").alias("epoch_seq"), "source_id", owner.cast("int").alias("owner"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of requests made from events: (request_id, type, mask, pattern, group_by, support)."""
    e = tele_events(spark, sf_dir)
    n = F.col("event_id") % 8
    kind = F.element_at(F.array(*map(F.lit, ["samples_sum", "samples_avg_key", "cm_topk", "samples_sum_key", "histogram_all", "samples_sum_key_pattern", "histogram_all_key", "cm_estimate"])), (n + 1).cast("int"))
    pattern = F.when(n == 5, F.when(F.col("event_id") % 3 == 0, "ab??").otherwise("0123456789abcde?")).when(n == 6, F.when(F.col("event_id") % 3 == 0, "????????aabbccdd").otherwise("0b1010"))
    group = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("ip"))).when(F.col("event_id") % 5 == 1, F.array(F.lit("bucket"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("request_id"), kind.alias("type"), F.expr("shiftleft(-1L, cast(key_lo % 64 as int))").alias("mask"), pattern.alias("pattern"), group.alias("group_by"), (F.col("value") % 40).alias("support"))


def epoch_summaries(events: DataFrame) -> dict[str, DataFrame]:
    """All summary tables of events, as the facade takes them."""
    cells = summaries.sketch_cells_table(events)
    b = batched(events)
    return {
        "epoch_header": summaries.headers(b), "samples_entries": summaries.samples(events), "hist_cells": summaries.histogram_cells(events), "hist_keys": summaries.histogram_keys(events),
        "cm_cells": cells, "cm_slots": summaries.ranked_slots(events, cells), "raw_events": b,
    }


#: Stores of this process, the epoch types that they hold, and the headers: (application, folder of tables) -> (store, types, headers).
_STORES: dict[tuple[str, str], tuple[EpochStore, set[str], DataFrame | None]] = {}

#: The epoch type that each stored table is complete with.
TYPE_OF = {"epoch_header": "samples_epoch", "samples_entries": "samples_epoch", "raw_events": "raw_epoch", "hist_cells": "histogram_epoch", "hist_keys": "histogram_epoch", "cm_cells": "sketch_epoch", "cm_slots": "slots_epoch"}
#: The epoch types, each after those that it is made from.
TYPES = ("histogram_epoch", "sketch_epoch", "slots_epoch", "samples_epoch", "raw_epoch")


def stored(spark: SparkSession, sf_dir: str, path: str | None = None, types: Iterable[str] = TYPES) -> EpochStore:
    """The summaries of a folder's events as a store that holds these epoch types, each written once for each application (or to a path of one's own)."""
    known = spark.sparkContext.applicationId, sf_dir
    store, held, header = (_STORES.get(known) if path is None else None) or (None, set(), None)
    if store is None:
        store = EpochStore(spark, path or f"{shared_dir(spark)}/summaries-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    wanted = {*types, *(("sketch_epoch",) if "slots_epoch" in types else ())}  # slots are ranked by the cells that were written
    if wanted <= held:
        return store
    e = tele_events(spark, sf_dir)
    header = written(epoch_headers(e), "headers") if header is None else header

    def keyed(rows: DataFrame) -> DataFrame:
        """With the numbers of the key and in its order, so that scans for keys and epochs skip most of a file."""
        with_numbers = rows.withColumns({"key_hi": key_hi(F.col("key")), "key_lo": key_lo(F.col("key"))})
        return with_numbers.sortWithinPartitions("aggregator_id", "sequence", "key_hi", "key_lo")

    tables = {
        "histogram_epoch": lambda: {"hist_cells": keyed(summaries.histogram_cells(e)), "hist_keys": keyed(summaries.histogram_keys(e))},
        "sketch_epoch": lambda: {"cm_cells": summaries.sketch_cells_table(e)},
        "slots_epoch": lambda: {"cm_slots": summaries.ranked_slots(e, store.read("cm_cells", "sketch_epoch"))},
        "samples_epoch": lambda: {"samples_entries": keyed(summaries.samples(e))},
        "raw_epoch": lambda: {"raw_events": batched(e).withColumn("idx", F.struct("source_id", "batch_seq", "pos")).sortWithinPartitions("aggregator_id", "sequence", "key_lo")},
    }
    for kind in TYPES:
        if kind in wanted - held:
            store.commit(kind, {**tables[kind](), "epoch_header": header.withColumn("epoch_type", F.lit(kind))})
            held.add(kind)
    if path is None:
        _STORES[known] = store, held, header
    return store


def types_of(kind: str) -> tuple[str, ...]:
    """The epoch types that a request of this type is answered from."""
    if kind.startswith("histogram"):
        return ("histogram_epoch",)
    if kind.startswith("cm"):
        return ("sketch_epoch", "slots_epoch") if kind == "cm_topk" else ("sketch_epoch",)
    return ("raw_epoch",) if kind.startswith("samples_raw") else ("samples_epoch",)


def stored_tables(store: EpochStore, types: Iterable[str] = TYPES) -> dict[str, DataFrame]:
    """The summary tables of these epoch types in a store, as the facade takes them."""
    header = "samples_epoch" if "samples_epoch" in types else min(types)
    return {"epoch_header": store.read("epoch_header", header), **{name: store.read(name, kind) for name, kind in TYPE_OF.items() if kind in types and name != "epoch_header"}}
