"""Answers over the summaries of selected epochs, and over raw events.

All take tables already cut to the selected epochs (functions.windows.selected) and return one small DataFrame with
`support` (contributing records) and `suppressed`. Global sums read headers' totals only; per-key answers filter the
entries first; top-k orders only k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.bits import unsigned_decimal
from tallybook.functions.hashing import key_hash
from tallybook.functions.keys import KeyMask, hist_bucket, key_hi, key_lo, sketch_column
from tallybook.operators.privacy import MIN_SUPPORT, suppressed
from tallybook.operators.summaries import capped, estimates
from tallybook.sources.shared import written

TOP = 100
#: Bits of a value that a round of rank selection counts by.
DIGIT = 16


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def _keyed(table: DataFrame) -> DataFrame:
    """table with key_hi and key_lo, made from the key where it lacks them."""
    return table if "key_lo" in table.columns else table.withColumns({"key_hi": key_hi(F.col("key")), "key_lo": key_lo(F.col("key"))})


def samples_sum(totals: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    out = totals.agg(_zero(F.sum("total_sum")).alias("sum"), _zero(F.sum("total_count")).alias("support"))
    return suppressed(out, ["sum"], min_support)


def samples_avg(totals: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Whole-number average, 0 without records."""
    out = totals.agg(_zero(F.sum("total_sum")).alias("s"), _zero(F.sum("total_count")).alias("support"))
    return suppressed(out.select(F.expr("if(support = 0, 0, s div support)").alias("avg"), "support"), ["avg"], min_support)


def samples_sum_key(entries: DataFrame, mask: KeyMask, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Sum over keys that match: a mask, a pattern, or (exact_key) one key."""
    out = _keyed(entries).where(mask.matches()).agg(_zero(F.sum("sum")).alias("sum"), _zero(F.sum("count")).alias("support"))
    return suppressed(out, ["sum"], min_support)


def samples_avg_key(entries: DataFrame, mask: KeyMask, min_support: int = MIN_SUPPORT) -> DataFrame:
    out = _keyed(entries).where(mask.matches()).agg(_zero(F.sum("sum")).alias("s"), _zero(F.sum("count")).alias("support"))
    return suppressed(out.select(F.expr("if(support = 0, 0, s div support)").alias("avg"), "support"), ["avg"], min_support)


def samples_sum_key_ids(entries: DataFrame, mask: KeyMask, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Sum, modulo 2^64, of the hashes of matching keys, one per epoch entry; hashes are made once per distinct key."""
    per_key = _keyed(entries).where(mask.matches()).groupBy("key").agg(F.count("*").alias("n"), F.sum("count").alias("support"))
    hashed = per_key.select((unsigned_decimal(key_hash(F.col("key"))).cast("decimal(38,0)") * F.col("n")).cast("decimal(38,0)").alias("h"), "support")
    out = hashed.agg(F.coalesce(F.sum("h") % F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(0)).cast("decimal(20,0)").alias("sum_key_ids"), _zero(F.sum("support")).alias("support"))
    return suppressed(out, ["sum_key_ids"], min_support)


def samples_topk(entries: DataFrame, limit: int = TOP, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The largest per-key sums over all epochs, without their keys; the zero key is left out."""
    totals = _keyed(entries).where("key_hi != 0 or key_lo != 0").groupBy("key").agg(F.sum("sum").alias("sum"))
    support = entries.agg(_zero(F.sum("count")).alias("support"))
    top = totals.orderBy(F.desc("sum"), "key").limit(min(limit, TOP))
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("sum"), "key")).alias("rank"), "sum")  # at most TOP rows
    return ranked.crossJoin(F.broadcast(support)).where(F.col("support") >= min_support)


def samples_max_key(entries: DataFrame, mask: KeyMask, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The largest per-epoch sum of a matching key."""
    out = _keyed(entries).where(mask.matches()).agg(_zero(F.max("sum")).alias("max"), _zero(F.sum("count")).alias("support"))
    return suppressed(out, ["max"], min_support)


def samples_count(totals: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    return suppressed(totals.agg(_zero(F.sum("total_count")).alias("count"), _zero(F.sum("total_count")).alias("support")), ["count"], min_support)


def ranked_values(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """ranks(q, rank) with the value of that rank, from 1, among counts(value, n).

    Rank selection by digits: of 65,536 digits at a time those are counted whose higher digits are right, so that four
    rounds find a 64-bit value, and no window has more rows than digits, however far apart values lie.
    """
    digits, rest = 1 << DIGIT, 64 - DIGIT
    # in the order of unsigned numbers
    unsigned = counts.select(F.col("value").cast("long").bitwiseXOR(F.lit(-(2**63))).alias("u"), "n")
    asked = ranks.select("q", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    order = Window.partitionBy("q").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(rest, -1, -DIGIT):
        higher = F.lit(0).cast("long") if shift == rest else F.shiftrightunsigned("u", shift + DIGIT)
        rows = unsigned.select(higher.alias("prefix"), F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(digits - 1)).alias("digit"), "n")
        # one row for each rank that is asked for
        held = rows.join(F.broadcast(asked), "prefix").groupBy("q", "prefix", "rank", "digit").agg(F.sum("n").alias("n"))
        upto = held.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") >= F.col("rank"))
        found = upto.groupBy("q", "prefix", "rank").agg(F.min_by(F.struct("digit", (F.col("upto") - F.col("n")).alias("before")), "digit").alias("d"))
        asked = written(found.select("q", (F.col("rank") - F.col("d.before")).alias("rank"), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("d.digit")).alias("prefix")), "ranks")
    return asked.select("q", F.col("prefix").bitwiseXOR(F.lit(-(2**63))).alias("value"))


def raw_extremes(events: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), min_support: int = MIN_SUPPORT) -> DataFrame:
    """Least, greatest and discrete percentiles of raw values (summaries can't give them): values are counted, then selected by rank."""
    counts = written(events.groupBy("value").agg(F.count("*").alias("n")), "values")
    total = counts.agg(_zero(F.min("value")).alias("min"), _zero(F.max("value")).alias("max"), _zero(F.sum("n")).alias("support"))
    asked = total.where("support > 0").select(F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.ceil(F.col("support") * q).alias("rank")) for i, q in enumerate(percentiles)))).alias("a")).select("a.*")
    names = [f"p{round(q * 100)}" for q in percentiles]
    found = ranked_values(counts, asked).agg(*(_zero(F.min(F.when(F.col("q") == i, F.col("value")))).alias(n) for i, n in enumerate(names)))
    return suppressed(total.crossJoin(F.broadcast(found)).select("min", "max", *names, "support"), ["min", "max", *names], min_support)


def histogram_bucket(cells: DataFrame, bucket: int, min_support: int = MIN_SUPPORT) -> DataFrame:
    out = cells.agg(_zero(F.sum(F.when(F.col("bucket") == bucket, F.col("n")))).alias("count"), _zero(F.sum("n")).alias("support"))
    return suppressed(out, ["count"], min_support)


def histogram_all(cells: DataFrame, keys: DataFrame, mask: KeyMask | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Non-empty buckets with the totals beside them; of matching keys only, if a mask is given. No rows below min_support."""
    if mask:
        cells, keys = _keyed(cells).where(mask.matches()), _keyed(keys).where(mask.matches())
    totals = keys.agg(_zero(F.sum("count")).alias("total_count"), _zero(F.sum("sum")).alias("total_sum"))
    buckets = cells.groupBy("bucket").agg(F.sum("n").alias("count")).where("count > 0")
    return buckets.crossJoin(F.broadcast(totals)).where(F.col("total_count") >= min_support)


def histogram_percentile(cells: DataFrame, percent: int = 90, lower_bound: str = "reference", min_support: int = MIN_SUPPORT) -> DataFrame:
    """First bucket whose cumulative count reaches floor(total * percent / 100), and the value it stands for.

    lower_bound: "reference" reports 0, 1, then 2^(bucket - 1); "exact" the bucket's least value, 2^bucket.
    """
    counts = cells.groupBy("bucket").agg(F.sum("n").alias("n"))  # at most one row a bucket
    running = counts.withColumn("cum", F.sum("n").over(Window.orderBy("bucket")))
    total = counts.agg(_zero(F.sum("n")).alias("total"))
    first = running.crossJoin(F.broadcast(total)).where(f"cum >= total * {percent} div 100").agg(F.min("bucket").alias("b"))
    shift = "b - 1" if lower_bound == "reference" else "b"
    out = total.crossJoin(first).select(
        F.coalesce("b", F.lit(0)).cast("long").alias("bucket"),
        F.expr(f"case when coalesce(b, 0) = 0 then 0L when b = 1 and '{lower_bound}' = 'reference' then 1L else shiftleft(1L, {shift}) end").alias("value"), F.col("total").alias("support"),
    )
    return suppressed(out, ["bucket", "value"], min_support)


def histogram_totals(keys: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Sum and count over all histograms."""
    out = keys.agg(_zero(F.sum("sum")).alias("sum"), _zero(F.sum("count")).alias("count")).withColumn("support", F.col("count"))
    return suppressed(out, ["sum", "count"], min_support)


def summed_cells(cells: DataFrame) -> DataFrame:
    """The sketch of all selected epochs: (row, col, n), of at most rows x columns cells."""
    return cells.groupBy("row", "col").agg(capped(F.sum("n"), (1 << 63) - 1).alias("n"))


def sketch_total(cells: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """What one row of the sketch adds up to."""
    out = cells.where("row = 0").agg(_zero(F.sum("n")).alias("total")).withColumn("support", F.col("total"))
    return suppressed(out, ["total"], min_support)


def sketch_estimate(cells: DataFrame, keys: DataFrame, support: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """key, estimate of each asked key(key): the least of its cells, each summed over the epochs. support(support) has one row."""
    found = estimates(summed_cells(cells), keys, []).withColumnRenamed("est", "estimate").crossJoin(F.broadcast(support))
    return suppressed(found, ["estimate"], min_support)


def sketch_topk(cells: DataFrame, slots: DataFrame, support: DataFrame, limit: int = TOP, min_support: int = MIN_SUPPORT) -> DataFrame:
    """rank, key, estimate of the slots' keys with the largest estimates on the summed sketch; the zero key is left out."""
    candidates = _keyed(slots.select("key")).where("key_hi != 0 or key_lo != 0").select("key").distinct()
    top = estimates(summed_cells(cells), candidates, []).orderBy(F.desc("est"), "key").limit(min(limit, TOP))
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("est"), "key")).alias("rank"), "key", F.col("est").alias("estimate"))  # at most TOP rows
    return ranked.crossJoin(F.broadcast(support)).where(F.col("support") >= min_support)


def raw_max_key(events: DataFrame, mask: KeyMask) -> DataFrame:
    """Per matching key its greatest value, with the number of all matching events."""
    found = _keyed(events).where(mask.matches()).groupBy("key").agg(F.max("value").alias("max"), F.count("*").alias("n"))
    total = found.agg(_zero(F.sum("n")).alias("support"))
    return found.select("key", "max").crossJoin(F.broadcast(total))


def raw_stats_key(events: DataFrame, mask: KeyMask) -> DataFrame:
    return _keyed(events).where(mask.matches()).agg(_zero(F.sum("value")).alias("sum"), F.count("*").alias("count"))


def raw_hist_bucket_key(events: DataFrame, mask: KeyMask, bucket: int) -> DataFrame:
    return _keyed(events).where(mask.matches()).agg(F.count_if(hist_bucket(F.col("value")) == bucket).alias("count"), F.count("*").alias("support"))


def raw_sketch_estimate_key(events: DataFrame, mask: KeyMask, value: int) -> DataFrame:
    """How often a value occurs among matching events by a sketch of values, and exactly.

    Only the asked value's cells are counted: values are totalled first, then those that share a cell with it are added.
    """
    counts = _keyed(events).where(mask.matches()).groupBy("value").agg(F.count("*").alias("n"))
    rows = range(3)
    asked = [sketch_column(F.lit(value).cast("long"), r) for r in rows]
    cells = counts.agg(*(_zero(F.sum(F.when(sketch_column(F.col("value"), r) == asked[r], F.col("n")))).alias(f"c{r}") for r in rows), _zero(F.sum(F.when(F.col("value") == value, F.col("n")))).alias("exact"), _zero(F.sum("n")).alias("support"))
    return cells.select(F.least(*(f"c{r}" for r in rows)).alias("estimate"), "exact", "support")


def prefix_sum(events: DataFrame, name: str, prefix: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Sum and count of events whose string key begins with a prefix."""
    out = events.where(F.col(name).startswith(prefix)).agg(_zero(F.sum("value")).alias("sum"), F.count("*").alias("support"))
    return suppressed(out, ["sum"], min_support)


class TooManyEvents(ValueError):
    """A raw request that more events would have to be read for than it may."""


def guarded(events: DataFrame, most: int) -> DataFrame:
    """events, if there are at most so many; else the request fails before it is answered. Looks at one event more than that, of no column."""
    if events.select(F.lit(1).alias("one")).limit(most + 1).count() > most:
        raise TooManyEvents(f"more than {most} events")
    return events


def raw_events_by_time(events: DataFrame, start_ms: int, end_ms: int, limit: int | None = None, guard: int | None = None) -> DataFrame:
    """Events ingested within both ends, in order; guard fails the read if there are more than so many."""
    found = events.where(F.col("ingest_time_ms").between(start_ms, end_ms))
    if guard is not None:
        n = found.agg(F.count("*").alias("n")).select(F.when(F.col("n") > guard, F.raise_error(F.concat(F.lit(f"more than {guard} events: "), F.col("n").cast("string"))).cast("boolean")).otherwise(True).alias("fits"))
        found = found.crossJoin(F.broadcast(n)).where("fits").drop("fits")
    found = found.orderBy("ingest_time_ms", "sequence", "idx")
    return found if limit is None else found.limit(limit)


def raw_events_by_sequence(events: DataFrame, sequences: list[int], limit: int | None = None) -> DataFrame:
    """Events of the listed epochs, in order; the list is the request's own."""
    found = events.where(F.col("sequence").isin([int(s) for s in sequences])).orderBy("ingest_time_ms", "sequence", "idx")
    return found if limit is None else found.limit(limit)


def first_of_epochs(events: DataFrame, cap: int) -> DataFrame:
    """At most `cap` events of each epoch, the first in order."""
    nth = F.row_number().over(Window.partitionBy("aggregator_id", "sequence").orderBy("idx"))
    return events.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")
