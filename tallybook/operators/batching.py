"""Commit batches, gaps and duplicates, and epochs of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.sources.shared import parted, ranged

#: Events in a commit batch, and batches in an epoch.
BATCH_EVENTS, EPOCH_BATCHES = 8, 16


def numbered(rows: DataFrame, by: list[str], order: list[str], slice_: str | None = None) -> DataFrame:
    """rows with n, their place from 0 among those with the same `by`, in order.

    slice_: a column that never falls along the order (a day, an hour). Each slice is then numbered on its own, from
    where the counts of the slices before it end, so that one `by` with most of the rows is many tasks' work.
    """
    if slice_ is None:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    before = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, slice_).agg(F.count("*").alias("c")).select(*by, slice_, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, slice_).orderBy(*order)) - 1)
    return inside.join(starts, [*by, slice_]).withColumn("n", F.col("start") + F.col("k")).drop("start", "k").select(*rows.columns, "n")


def with_batches(events: DataFrame, order: list[str], size: int = BATCH_EVENTS, slice_: str | None = None) -> DataFrame:
    """events(source_id, ...) with batch_seq and pos: consecutive chunks of `size` (0: one batch) per source, from 0. slice_: see numbered."""
    nth = numbered(events, ["source_id"], order, slice_)
    if not size:
        return nth.withColumn("batch_seq", F.lit(0).cast("long")).withColumn("pos", F.col("n")).drop("n")
    return nth.withColumn("batch_seq", F.expr(f"n div {size}")).withColumn("pos", F.expr(f"cast(n % {size} as int)")).drop("n")


def round_robin(events: DataFrame, order: list[str], sources: int, by: str, slice_: str | None = None) -> DataFrame:
    """events with source_id dealt in turn within each value of `by` (a file, a day). slice_: see numbered."""
    return numbered(events, [by], order, slice_).withColumn("source_id", F.pmod("n", F.lit(sources)).cast("int")).drop("n")


def merged_by_time(events: DataFrame, max_events: int | None = None) -> DataFrame:
    """Files merged in time order; ties by key, file and value."""
    out = events.orderBy("start_time", "key", "file", "value")
    return out if max_events is None else out.limit(max_events)


def interleaved(rows: DataFrame, slice_: str | None = None) -> DataFrame:
    """rows(file, pos, ...) in turn from each file: order_key = nth in its file * number of files + number of the file.

    slice_: see numbered; without one, files are numbered range by range.
    """
    files = rows.select("file").distinct()
    counted = ranged(files, [], [F.col("file")]).crossJoin(F.broadcast(files.agg(F.count("*").alias("files")))).withColumnRenamed("nth", "file_no")
    nth = numbered(rows, ["file"], ["pos"], slice_) if slice_ else ranged(rows, ["file"], [F.col("pos")]).withColumnRenamed("nth", "n")
    return nth.join(counted, "file").withColumn("order_key", F.col("n").cast("long") * F.col("files") + F.col("file_no")).drop("n", "files", "file_no")


def sequence_report(batches: DataFrame) -> DataFrame:
    """Per arriving batch(source_id, batch_seq, arrival): first, next, gap, duplicate or restart, against the one before.

    Arrivals are looked at range by range; a range starts with what those before it leave: their last batch and their
    highest. So a source with most of the batches is many tasks' work.
    """
    parts = parted(batches, ["source_id"], [F.col("arrival")])
    over = Window.partitionBy("source_id").orderBy("part")
    ends = parts.groupBy("source_id", "part").agg(F.max_by("batch_seq", "arrival").alias("last"), F.max("batch_seq").alias("top"))
    carried = ends.select("source_id", "part", F.lag("last").over(over).alias("last"), F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("top"))
    w = Window.partitionBy("source_id", "part").orderBy("arrival")
    prev = F.coalesce(F.lag("batch_seq").over(w), F.col("last"))
    seen = F.greatest(F.max("batch_seq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("top"))
    looked = parts.join(carried, ["source_id", "part"]).withColumn("prev", prev).withColumn("seen", seen)
    status = F.when(F.col("prev").isNull(), "first").when(F.col("batch_seq") == F.col("prev") + 1, "next").when(F.col("batch_seq") > F.col("prev") + 1, "gap").when((F.col("batch_seq") == 0) & (F.col("seen") > 0), "restart").when(F.col("batch_seq") == F.col("prev"), "duplicate").otherwise("restart")
    return looked.withColumn("expected", F.col("prev") + 1).withColumn("status", status).select(*batches.columns, "expected", "status")


def deduplicated(batches: DataFrame, keep: str = "first") -> DataFrame:
    """One batch per (source_id, batch_seq), the first or last by arrival, with how many came and whether their hashes differ."""
    order = F.col("arrival") if keep == "first" else F.desc("arrival")
    key = Window.partitionBy("source_id", "batch_seq")
    return (
        batches.withColumn("n", F.row_number().over(key.orderBy(order))).withColumn("deliveries", F.count("*").over(key)).withColumn("conflict", F.min("batch_hash").over(key) != F.max("batch_hash").over(key))
        .where("n = 1").drop("n")
    )


def contiguous(batches: DataFrame, expected: DataFrame, allow_gaps: bool = False) -> DataFrame:
    """The batches that each source may contribute: from expected(source_id, next_seq) on without a gap; 0 for a source it lacks."""
    held = batches.join(expected, "source_id", "left").withColumn("next_seq", F.coalesce("next_seq", F.lit(0)).cast("long")).where("batch_seq >= next_seq")
    if allow_gaps:
        return held.drop("next_seq")
    # a source's first gap is the first number that should come, or comes next, and isn't there: equi-joins, however many batches a source has
    there = held.select("source_id", "batch_seq").distinct()
    wanted = held.select("source_id", F.col("next_seq").alias("batch_seq")).distinct().unionByName(there.select("source_id", (F.col("batch_seq") + 1).alias("batch_seq")))
    gaps = wanted.join(there, ["source_id", "batch_seq"], "left_anti").groupBy("source_id").agg(F.min("batch_seq").alias("gap"))
    return held.join(gaps, "source_id").where("batch_seq < gap").drop("gap", "next_seq")


def epochs(batches: DataFrame, threshold: int = EPOCH_BATCHES, min_sources: int = 1, slice_ms: int = 3_600_000) -> DataFrame:
    """batches(aggregator_id, ingest_time_ms, source_id, batch_seq) with epoch_seq: up to `threshold` a epoch, in order; epochs of fewer sources than min_sources are left out.

    Batches are numbered slice by slice of slice_ms of ingest time, so that an aggregator is many tasks' work.
    """
    sliced = batches.withColumn("slice", F.expr(f"ingest_time_ms div {slice_ms}"))
    out = numbered(sliced, ["aggregator_id"], ["ingest_time_ms", "source_id", "batch_seq"], "slice").withColumn("epoch_seq", F.expr(f"n div {threshold}")).drop("n", "slice")
    if min_sources <= 1:
        return out
    enough = out.groupBy("aggregator_id", "epoch_seq").agg(F.count_distinct("source_id").alias("s")).where(F.col("s") >= min_sources)
    return out.join(enough.drop("s"), ["aggregator_id", "epoch_seq"], "left_semi")


def dealt_epochs(rows: DataFrame, keys: int, epochs_wanted: int, per_key: int) -> DataFrame:
    """(epoch_seq, key, nth, value): the first `keys` keys by appearance, each giving per_key values an epoch, over again from its start when they run out."""
    first = rows.groupBy("key").agg(F.min("pos").alias("first")).orderBy("first", "key").limit(keys)
    own = rows.join(F.broadcast(first), "key")  # `keys` rows
    w = Window.partitionBy("key")
    ranked = own.withColumn("nth", F.row_number().over(w.orderBy("pos")) - 1).withColumn("total", F.count("*").over(w))
    # the places n = nth, nth + total, ... below epochs * per_key
    places = F.expr(f"case when nth < {epochs_wanted * per_key} then sequence(cast(nth as bigint), {epochs_wanted * per_key - 1}L, total) else array() end")
    return ranked.select("key", "value", F.explode(places).alias("place")).select(F.expr(f"place div {per_key}").alias("epoch_seq"), "key", F.expr(f"place % {per_key}").alias("nth"), "value")


def source_status(batches: DataFrame, tips: DataFrame) -> DataFrame:
    """Per source of tips(source_id, last_seq): least, greatest and number of batches and the next sequence."""
    got = batches.groupBy("source_id").agg(F.min("batch_seq").alias("min_seq"), F.max("batch_seq").alias("max_seq"), F.count("*").alias("n_batches"))
    return got.join(tips, "source_id", "right").select("source_id", "min_seq", "max_seq", F.coalesce("n_batches", F.lit(0)).alias("n_batches"), F.coalesce(F.greatest("max_seq", "last_seq") + 1, F.lit(0)).cast("long").alias("next_seq"), F.col("n_batches").isNull().alias("silent"))


def precheck(expected: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per source: what expected(source_id, next_seq) and incoming(source_id, min_seq, max_seq) say of each other."""
    joined = expected.join(incoming, "source_id", "full_outer")
    status = F.when(F.col("min_seq").isNull(), "NO INCOMING BATCHES").when(F.col("min_seq") == F.coalesce("next_seq", F.lit(0)), "OK").when(F.col("min_seq") > F.coalesce("next_seq", F.lit(0)), "GAP!").otherwise("OVERLAP")
    return joined.withColumn("status", status)
