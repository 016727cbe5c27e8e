"""Which aggregator owns which source in which epoch: maps, changes, handoffs, coverage and continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.operators.integrity import zero_hash


def active_maps(maps: DataFrame, epochs: DataFrame) -> DataFrame:
    """(epoch, epoch_seq): for each asked epoch(epoch) the latest map installed at or before it, null if none.

    Maps and asked epochs are laid out in one order and the last map seen is carried along; the carry is done per
    block of epochs, with each block's start taken from the blocks before, so no task needs them all.
    """
    width = 1024
    marks = maps.select("epoch_seq").distinct().select(F.col("epoch_seq").alias("at"), F.lit(0).alias("kind"), F.col("epoch_seq").alias("map"))
    asked = epochs.select("epoch").distinct().select(F.col("epoch").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("map"))
    rows = marks.unionByName(asked).withColumn("block", F.floor(F.col("at") / width))
    inside = rows.withColumn("carried", F.last("map", ignorenulls=True).over(Window.partitionBy("block").orderBy("at", "kind")))
    ends = rows.groupBy("block").agg(F.max("map").alias("last"))  # one row for each 1024 epochs
    starts = ends.select("block", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    return inside.where("kind = 1").join(starts, "block").select(F.col("at").alias("epoch"), F.coalesce("carried", "start").alias("epoch_seq"))


def owners(maps: DataFrame, asked: DataFrame, default: int) -> DataFrame:
    """asked(source_id, epoch, ...) with owner: that of the active map; the default if the map lacks the source (older maps don't count)."""
    found = asked.join(active_maps(maps, asked), "epoch", "left")
    own = maps.select("epoch_seq", "source_id", F.col("owner"))
    return found.join(own, ["epoch_seq", "source_id"], "left").withColumn("owner", F.coalesce("owner", F.lit(default))).drop("epoch_seq")


def owned_batches(batches: DataFrame, maps: DataFrame, aggregator_id: int, default: int) -> DataFrame:
    """The batches(source_id, epoch, ...) whose source this aggregator owns in their epoch.

    Batches pass by a hash table of the pairs, one row for each source and epoch, so that none are sorted.
    """
    pairs = batches.select("source_id", "epoch").distinct()
    mine = owners(maps, pairs, default).where(F.col("owner") == aggregator_id).select("source_id", "epoch")
    return batches.join(mine.hint("shuffle_hash"), ["source_id", "epoch"], "left_semi")


def map_changes(maps: DataFrame, before: int, after: int) -> DataFrame:
    """(source_id, old_owner, new_owner, change) between two maps: changed, new or dropped."""
    old = maps.where(F.col("epoch_seq") == before).select("source_id", F.col("owner").alias("old_owner"))
    new = maps.where(F.col("epoch_seq") == after).select("source_id", F.col("owner").alias("new_owner"))
    joined = old.join(new, "source_id", "full_outer").where(~F.col("old_owner").eqNullSafe(F.col("new_owner")))
    return joined.withColumn("change", F.when(F.col("old_owner").isNull(), "new").when(F.col("new_owner").isNull(), "dropped").otherwise("changed"))


def transitions(owned: DataFrame) -> DataFrame:
    """(source_id, at_epoch, from_aggregator, to_aggregator) where owned(source_id, epoch, owner) changes from one epoch to the next."""
    before = F.lag("owner").over(Window.partitionBy("source_id").orderBy("epoch"))
    return owned.withColumn("from_aggregator", before).where("from_aggregator is not null and from_aggregator != owner").select("source_id", F.col("epoch").alias("at_epoch"), "from_aggregator", F.col("owner").alias("to_aggregator"))


def is_real_tip(tip: Column, last_seq: Column) -> Column:
    return F.coalesce(tip.isNotNull() & (tip != zero_hash()) & (last_seq >= 0), F.lit(False))


def inherited(incoming: DataFrame, tips: DataFrame, handoffs: DataFrame) -> DataFrame:
    """incoming(source_id, at_epoch, reader) with where its chain goes on: from a durable tip, else the handoff of that boundary, else cold.

    origin says which, class whether the tip's owner is the reader (kept) or another (moved).
    """
    t = tips.select("source_id", F.col("chain_tip").alias("t_tip"), F.col("last_seq").alias("t_seq"), F.col("owner").alias("t_owner"))
    h = handoffs.select("source_id", "at_epoch", F.col("chain_tip").alias("h_tip"), F.col("last_seq").alias("h_seq"), F.col("from_aggregator").alias("h_from"))
    df = incoming.join(t, "source_id", "left").join(h, ["source_id", "at_epoch"], "left")
    durable, handed = is_real_tip(F.col("t_tip"), F.col("t_seq")), is_real_tip(F.col("h_tip"), F.col("h_seq"))
    return df.select(
        "source_id", "at_epoch", F.when(durable, "tip").when(handed, "handoff").otherwise("cold").alias("origin"),
        F.when(durable, F.col("t_tip")).when(handed, F.col("h_tip")).otherwise(zero_hash()).alias("chain_tip"),
        F.when(durable, F.col("t_seq")).when(handed, F.col("h_seq")).otherwise(F.lit(-1)).cast("long").alias("last_seq"),
        F.when(durable, F.when(F.col("t_owner") == F.col("reader"), "kept").otherwise("moved")).when(handed, "moved").otherwise("new").alias("class"),
    )


def coverage(owned: DataFrame, aggregators: int, by: list[str] | None = None) -> DataFrame:
    """One row (one for each value of `by`): sources, uncovered (no owner), out_of_range, idle aggregators, covered."""
    per = owned.groupBy(*(by or []), "owner").agg(F.count("*").alias("n"))  # one row an owner
    facts = per.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sources"), F.coalesce(F.sum(F.when(F.col("owner").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("uncovered"),
        F.coalesce(F.sum(F.when((F.col("owner") < 0) | (F.col("owner") >= aggregators), F.col("n"))), F.lit(0)).cast("long").alias("out_of_range"),
        F.count_if(F.col("owner").between(0, aggregators - 1)).alias("busy"),
    )
    return facts.select(*(by or []), "sources", "uncovered", "out_of_range", (F.lit(aggregators) - F.col("busy")).cast("long").alias("idle"), ((F.col("uncovered") == 0) & (F.col("out_of_range") == 0) & (F.col("busy") == aggregators)).alias("covered"))


def continuity(handoffs: DataFrame) -> DataFrame:
    """handoffs with continuous: the tip is real and its former owner known."""
    return handoffs.withColumn("continuous", is_real_tip(F.col("chain_tip"), F.col("last_seq")) & F.coalesce(F.col("from_aggregator") >= 0, F.lit(False)))


def continuity_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("handoffs"), F.count_if("continuous").alias("continuous"), F.count_if(~F.col("continuous")).alias("broken"), F.coalesce(F.bool_and("continuous"), F.lit(True)).alias("all_continuous"))


def merged_state(stores: list[DataFrame], key: list[str], since: int | None = None, until: int | None = None, epoch: str = "updated_at_epoch") -> DataFrame:
    """Tips or handoffs of many stores as one: real ones only, within the epochs, the latest for each key."""
    rows = stores[0]
    for s in stores[1:]:
        rows = rows.unionByName(s)
    rows = rows.where(is_real_tip(F.col("chain_tip"), F.col("last_seq")))
    if since is not None:
        rows = rows.where(F.col(epoch) >= since)
    if until is not None:
        rows = rows.where(F.col(epoch) <= until)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(epoch), F.desc("last_seq"), "chain_tip"))).where("n = 1").drop("n")


def installed(maps: DataFrame, new: DataFrame, next_epoch: int) -> DataFrame:
    """new(epoch_seq, source_id, owner, ...) as it may be appended to the maps: fails the job where it changes an epoch before next_epoch, names a source twice, or an epoch that is mapped already."""
    twice = F.count("*").over(Window.partitionBy("epoch_seq", "source_id")) > 1
    there = maps.select("epoch_seq").distinct().withColumn("mapped", F.lit(True))
    df = new.withColumn("twice", twice).join(there, "epoch_seq", "left")
    problem = F.when(F.col("epoch_seq") < next_epoch, "a map can't change epochs that have begun").when(F.col("twice"), "a source is named twice").when(F.col("mapped"), "the epoch has a map")
    return df.withColumn("owner", F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.col("owner"))).select(*new.columns)
