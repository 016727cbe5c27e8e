"""Epoch summaries: per-key totals, histograms, Count-Min sketches with heavy hitters, headers and merges.

Events come as (aggregator_id, sequence, key, value, ts, ...). Every table is keyed by (aggregator_id, sequence).
Totals are partial sums per task before any shuffle, so a hot key or cell costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.hashing import sketch_cells
from tallybook.functions.keys import HIST_BUCKETS, SKETCH_COLUMNS, SKETCH_SEEDS, hist_bucket

EPOCH = ["aggregator_id", "sequence"]
U32, SLOTS = (1 << 32) - 1, 100


def capped(x: Column, cap: int = U32) -> Column:
    """Saturating sums: all addends are non-negative, so the clamped total is what stepwise saturation gives."""
    return F.least(x, F.lit(cap))


def samples(events: DataFrame, count_cap: int = U32) -> DataFrame:
    """Per epoch and key: sum and count of values."""
    return events.groupBy(*EPOCH, "key").agg(F.sum("value").alias("sum"), capped(F.count("*"), count_cap).alias("count"))


def samples_totals(entries: DataFrame) -> DataFrame:
    """Per epoch: total_sum, total_count and number of keys of the samples entries."""
    return entries.groupBy(*EPOCH).agg(F.sum("sum").alias("total_sum"), F.sum("count").alias("total_count"), F.count("*").alias("n_keys"))


def histogram_cells(events: DataFrame) -> DataFrame:
    """Per epoch, key and log2 bucket: n."""
    return events.groupBy(*EPOCH, "key", hist_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_keys(events: DataFrame) -> DataFrame:
    """Per epoch and key: count and sum."""
    return events.groupBy(*EPOCH, "key").agg(F.count("*").alias("count"), F.sum("value").alias("sum"))


def histogram_wide(cells: DataFrame) -> DataFrame:
    """Per epoch and key: counts, an array with a slot for each bucket (at most HIST_BUCKETS cells a key)."""
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    return cells.groupBy(*EPOCH, "key").agg(held.alias("m")).select(
        *EPOCH, "key", F.transform(F.sequence(F.lit(0), F.lit(HIST_BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("counts")
    )


def sketch_cells_table(events: DataFrame, weight: str | None = "value") -> DataFrame:
    """Per epoch, row and column: n, the sum of the weights (1 each, if None) of the keys that fall there, saturating."""
    add = F.sum(weight) if weight else F.count("*")
    # keys are totalled before their three cells are made, in Arrow batches
    per_key = events.groupBy(*EPOCH, "key").agg(add.alias("w"))
    cells = per_key.select(*EPOCH, "w", F.explode(sketch_cells(F.col("key"), SKETCH_SEEDS, SKETCH_COLUMNS)).alias("c"))
    return cells.groupBy(*EPOCH, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(capped(F.sum("w")).alias("n"))


def with_cells(keys: DataFrame) -> DataFrame:
    """keys(key, ...) with one row for each of the key's cells: row, col."""
    return keys.select("*", F.explode(sketch_cells(F.col("key"), SKETCH_SEEDS, SKETCH_COLUMNS)).alias("c")).select("*", F.col("c.row").alias("row"), F.col("c.col").alias("col")).drop("c")


def estimates(cells: DataFrame, keys: DataFrame, by: list[str] = EPOCH) -> DataFrame:
    """(by, key, est): the least of each key's cells; a cell that the sketch lacks counts 0. keys has the columns of by, and key."""
    distinct = keys.select(*by, "key").distinct()
    if by:
        # cells grow with the epochs: never broadcast, which would pass them through the driver
        found = with_cells(distinct).join(cells.hint("merge"), [*by, "row", "col"], "left")
        return found.groupBy(*by, "key").agg(F.min(F.coalesce("n", F.lit(0))).alias("est"))
    # one sketch: at most rows x columns cells, whatever the table
    found = with_cells(distinct).join(F.broadcast(cells), ["row", "col"], "left")
    return found.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("est"))


def ranked_slots(events: DataFrame, cells: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per epoch the `slots` keys with the largest final estimates, ties to the smaller key: free of event order."""
    rank = F.row_number().over(Window.partitionBy(*EPOCH).orderBy(F.desc("est"), "key"))
    return estimates(cells, events).withColumn("slot", rank).where(F.col("slot") <= slots).select(*EPOCH, "key", "est", (F.col("slot") - 1).alias("slot"))


def replayed_slots(events: DataFrame, slots: int = SLOTS, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Per epoch the slots as an in-order pass leaves them: an event's estimate replaces the least slot if larger.

    by: the columns that order an epoch's events. Order dependent by definition, so an epoch passes through one task,
    which holds its sketch and slots beside one Arrow batch, whatever the epoch's size; `ranked_slots` is free of order.
    """
    cells = sketch_cells(F.col("key"), SKETCH_SEEDS, SKETCH_COLUMNS)
    order = [f"o{i}" for i in range(len(by))]
    hashed = events.withColumn("c", cells).select(*(F.col(c).cast("long").alias(c) for c in EPOCH), "key", F.col("value").cast("long").alias("value"), F.transform("c", lambda c: c["col"]).alias("cols"), *(F.col(c).alias(o) for c, o in zip(by, order, strict=True)))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch, table, keys, score, place = None, [], [], [], {}

        def left() -> list[tuple]:
            return [(*epoch, k, s, i) for i, (k, s) in enumerate(zip(keys, score, strict=True))] if epoch else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=[*EPOCH, "key", "est", "slot"])

        for batch in batches:
            out: list[tuple] = []
            for a, n, key, value, cols in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (a, n) != epoch:
                    out += left()
                    epoch, table, keys, score, place = (a, n), [{} for _ in SKETCH_SEEDS], [], [], {}
                for t, c in zip(table, cols, strict=True):
                    t[c] = min(U32, t.get(c, 0) + value)
                est = min(t[c] for t, c in zip(table, cols, strict=True))
                if key in place:
                    score[place[key]] = max(score[place[key]], est)
                elif len(keys) < slots:
                    place[key] = len(keys)
                    keys.append(key)
                    score.append(est)
                elif est > (low := min(score)):
                    least = score.index(low)
                    del place[keys[least]]
                    place[key], keys[least], score[least] = least, key, est
            yield batch_of(out)
        yield batch_of(left())

    dealt = hashed.repartition(*EPOCH).sortWithinPartitions(*EPOCH, *order).select(*EPOCH, "key", "value", "cols")
    return dealt.mapInArrow(replay, "aggregator_id long, sequence long, key binary, est long, slot int")


def headers(events: DataFrame, epoch_type: str = "samples_epoch") -> DataFrame:
    """Per epoch: event and ingest times, numbers of events, batches and sources."""
    return events.groupBy(*EPOCH).agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("ingest_time_ms").alias("ingest_time_ms"), F.count("*").alias("n_events"),
        F.count_distinct("source_id", "batch_seq").alias("n_batches"), F.count_distinct("source_id").alias("n_sources"),
    ).withColumn("epoch_type", F.lit(epoch_type))


def merged_slots(parts: list[DataFrame], cells: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots of an epoch from those of its partial sketches: their keys, ranked anew by the merged sketch's cells."""
    keys = parts[0].select(*EPOCH, "key")
    for p in parts[1:]:
        keys = keys.unionByName(p.select(*EPOCH, "key"))
    return ranked_slots(keys, cells, slots)


def merged_cells(parts: list[DataFrame]) -> DataFrame:
    """One sketch of several partial ones, saturating like each."""
    return merged(parts, ["row", "col"], "n").withColumn("n", capped(F.col("n")))


def merged(parts: list[DataFrame], cell: list[str], *values: str) -> DataFrame:
    """One summary of several partial ones: values add up cell by cell."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*EPOCH, *cell).agg(*(F.sum(v).alias(v) for v in values))
