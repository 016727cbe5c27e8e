"""Streams of committed batches to epochs, and epochs to stored summaries.

An aggregator's batches wait in state until their source's earlier ones are there (gaps wait, duplicates and replays
below the next sequence are dropped). An epoch leaves when EPOCH_BATCHES batches are ready, when the timeout has passed
since the first of them got ready, or in a drain run. With min_sources an epoch takes batches of so many sources, in
place of the latest of its slice if need be; where fewer sources are ready it waits for the timeout or the drain run,
which let it leave with what there is, so that no batch waits for ever.

State holds waiting batches, and the places of those that are ready; the checkpoint holds offsets and state, so a
restart goes on where the last committed micro-batch ended. Batches that leave with the micro-batch they came in never
touch the state: an aggregator's task holds those of one micro-batch, packed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallybook.operators.batching import EPOCH_BATCHES

TIMEOUT_MS = 30_000
EVENTS = "array<struct<key: binary, value: long, ts: long>>"
OUT = f"aggregator_id long, sequence long, source_id int, batch_seq long, ingest_time_ms long, batch_hash binary, events {EVENTS}"


def picked(ready: list[tuple[int, int, int]], threshold: int, min_sources: int, partial: bool) -> list[tuple[int, int, int]]:
    """Of ready (ingest time, source, sequence), in any order, those of the next epoch, in order; none if it has to wait. partial: it may leave with less."""
    by_source: dict[int, list[tuple[int, int]]] = {}
    for ingest, source, seq in ready:
        by_source.setdefault(source, []).append((seq, ingest))
    # a source's batches keep their order: none comes before an earlier one of its source
    line = []
    for source, batches in by_source.items():
        batches.sort()
        line += [(at, source, seq) for (seq, _), at in zip(batches, accumulate((ingest for _, ingest in batches), max), strict=True)]
    line.sort()
    if not line or len(line) < threshold and not partial:
        return []
    now = line[:threshold]
    have = {source for _, source, _ in now}
    want = min(min_sources, threshold, len(by_source))
    if len(have) < min_sources and len(by_source) < min_sources and not partial:
        return []
    if len(have) < want:
        # the first batches of further sources in place of the latest of those with several
        first = {}
        for x in line:
            first.setdefault(x[1], x)
        more = sorted(x for s, x in first.items() if s not in have)[: want - len(have)]
        for _ in more:
            counts: dict[int, int] = {}
            for x in now:
                counts[x[1]] = counts.get(x[1], 0) + 1
            now.remove(max(x for x in now if counts[x[1]] > 1))
        now = sorted([*now, *more])
    return now


def drawn(ready: list[tuple[int, int, int]], threshold: int, min_sources: int, partial: bool) -> Iterator[list[tuple[int, int, int]]]:
    """The epochs that `picked` gives one after the other, in time that grows with the batches, not with batches times epochs."""
    by_source: dict[int, list[tuple[int, int]]] = {}
    for ingest, source, seq in ready:
        by_source.setdefault(source, []).append((seq, ingest))
    for batches in by_source.values():
        batches.sort()
    if min_sources <= 1:
        # an epoch is the next slice of one line, whose order stays as epochs leave
        line = sorted((at, source, seq) for source, batches in by_source.items() for (seq, _), at in zip(batches, accumulate((ingest for _, ingest in batches), max), strict=True))
        for first in range(0, len(line), threshold):
            if first + threshold <= len(line) or partial:
                yield line[first: first + threshold]
        return
    # an epoch takes the first batches of each source: `threshold` of each are enough to pick from
    gone = dict.fromkeys(by_source, 0)
    while now := picked([(ingest, source, seq) for source, batches in by_source.items() for seq, ingest in batches[gone[source]: gone[source] + threshold]], threshold, min_sources, partial):
        for _, source, _ in now:
            gone[source] += 1
        yield now


#: Rows of a frame of epochs, about.
FRAME_ROWS = 2048


class EpochAssigner(StatefulProcessor):
    """One aggregator's epochs. force: every ready batch leaves with its micro-batch (drain runs); else partial epochs leave by timer, or without a timeout wait until they are full."""

    def __init__(self, threshold: int = EPOCH_BATCHES, timeout_ms: int | None = TIMEOUT_MS, force: bool = False, min_sources: int = 1, allow_gaps: bool = False):
        self.threshold, self.timeout_ms, self.force, self.min_sources, self.allow_gaps = threshold, timeout_ms, force, min_sources, allow_gaps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next_epoch = handle.getValueState("next_epoch", "n long")
        self.deadline = handle.getValueState("deadline", "at long")
        self.expected = handle.getMapState("expected", "source_id int", "next_seq long")
        self.run_end = handle.getMapState("run_end", "source_id int", "next_seq long")
        self.waiting = handle.getMapState("waiting", "source_id int, batch_seq long", f"ingest_time_ms long, batch_hash binary, events {EVENTS}")
        self.ready = handle.getMapState("ready", "source_id int, batch_seq long", "ingest_time_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple[int, int], tuple[int, bytes, bytes]] = {}
        expected, stored = {}, next(iter(self.waiting.iterator()), None) is not None
        for pdf in rows:
            for source, seq, ingest, digest, events in zip(*(pdf[c] for c in ("source_id", "batch_seq", "ingest_time_ms", "batch_hash", "events")), strict=True):
                at = (int(source), int(seq))
                if at[0] not in expected:
                    expected[at[0]] = self._of(self.expected, at[0])
                if at[1] >= expected[at[0]] and at not in came and not (stored and self.waiting.containsKey(at)):
                    came[at] = (int(ingest), bytes(digest), pickle.dumps([(bytes(e["key"]), int(e["value"]), int(e["ts"])) for e in events]))
        if self.allow_gaps:
            fresh = {at: batch[0] for at, batch in came.items()}
        else:
            fresh = {}
            for source in sorted({s for s, _ in came}):
                end = begun = max(self._of(self.run_end, source), expected[source])
                while (at := (source, end)) in came or stored and self.waiting.containsKey(at):
                    fresh[at] = came[at][0] if at in came else int(self.waiting.getValue(at)[0])
                    end += 1
                if end != begun:
                    self.run_end.updateValue((source,), (end,))
        yield from self._leave(key, self.force, came, fresh)
        self._arm(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.deadline.clear()
        yield from self._leave(key, True, {}, {})
        self._arm(timerValues)

    def close(self) -> None:
        pass

    def _arm(self, timerValues) -> None:
        """A timer from when the first batch got ready: later batches leave it as it is."""
        if not self.force and self.timeout_ms is not None and not self.deadline.exists() and next(iter(self.ready.iterator()), None) is not None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(at)
            self.deadline.update((at,))

    def _of(self, state, source: int) -> int:
        return int(state.getValue((source,))[0]) if state.containsKey((source,)) else 0

    def _leave(self, key, partial: bool, came: dict[tuple[int, int], tuple[int, bytes, bytes]], fresh: dict[tuple[int, int], int]) -> Iterator[pd.DataFrame]:
        """Epochs of what is ready; what came and doesn't leave, and the places of fresh ready ones, are put into the state after that."""
        ready = {(int(at[0]), int(at[1])): int(value[0]) for at, value in self.ready.iterator()}
        old = set(ready)
        ready |= fresh
        epoch = begun = int(self.next_epoch.get()[0]) if self.next_epoch.exists() else 0
        upto: dict[int, int] = {}
        out = []
        for now in drawn([(ingest, *at) for at, ingest in ready.items()], self.threshold, self.min_sources, partial):
            for at in sorted(x[1:] for x in now):
                batch = came.pop(at, None)
                if batch is None:
                    ingest, digest, events = self.waiting.getValue(at)
                    self.waiting.removeKey(at)
                else:
                    ingest, digest, events = batch[0], batch[1], pickle.loads(batch[2])
                out.append((key[0], epoch, *at, ingest, digest, [{"key": e[0], "value": e[1], "ts": e[2]} for e in events]))
                if at in old:
                    self.ready.removeKey(at)
                del ready[at]
                upto[at[0]] = max(upto.get(at[0], 0), at[1] + 1)
            epoch += 1
            if len(out) >= FRAME_ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        for source, next_seq in upto.items():
            self.expected.updateValue((source,), (max(self._of(self.expected, source), next_seq),))
        for at, (ingest, digest, events) in came.items():
            self.waiting.updateValue(at, (ingest, digest, pickle.loads(events)))
        for at in fresh:
            if at in ready:
                self.ready.updateValue(at, (ready[at],))
        if epoch != begun:
            self.next_epoch.update((epoch,))
            if self.deadline.exists():  # what is still ready waits from now on
                self.handle.deleteTimer(int(self.deadline.get()[0]))
                self.deadline.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["aggregator_id", "sequence", "source_id", "batch_seq", "ingest_time_ms", "batch_hash", "events"])


def epochs(batches: DataFrame, aggregators: int, timers: bool = False, force: bool | None = None, **settings) -> DataFrame:
    """A stream of batches with their epochs. timers: for long-running queries; without them a drain run ends by itself, with all that is ready, or with force=False with full epochs only."""
    keyed = batches.withColumn("aggregator_id", (F.col("source_id") % aggregators).cast("long"))
    if not timers:
        settings["timeout_ms"] = None
    processor = EpochAssigner(force=not timers if force is None else force, **settings)
    return keyed.groupBy("aggregator_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if timers else "None")


def use_rocksdb(spark) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def events_of(assigned: DataFrame) -> DataFrame:
    """One row per event of assigned batches; idx orders them by source, batch and place."""
    flat = assigned.select("aggregator_id", "sequence", "source_id", "batch_seq", "ingest_time_ms", F.posexplode("events").alias("pos", "e")).select("aggregator_id", "sequence", "source_id", "batch_seq", "ingest_time_ms", "pos", "e.key", "e.value", "e.ts")
    return flat.withColumn("idx", F.struct("source_id", "batch_seq", "pos"))


def processed(store, assigned: DataFrame, maps: DataFrame | None = None, default_owner: int = -1) -> None:
    """foreachBatch's work: verify chains, set bad batches aside, store summaries, tips, chain links and handoffs of the epochs that are new.

    Histograms and sketches are committed as epochs of their own type, samples last, with all that the next epochs go
    on from: source tips, the epoch chain, batches set aside, and (maps: ownership) the tips handed to a source's next
    owner. Tips and links are read as they stand, not from history. Only marked epochs are read, so a micro-batch that is replayed after a failure at any point starts from the
    same tips and leaves the same tables. What unmarked attempts left behind is swept first.
    """
    from tallybook.operators import integrity, ownership, summaries
    from tallybook.operators.recovery import KEY

    store.sweep()
    held = assigned.persist()
    since = held.agg(F.min("sequence")).first()[0]
    new = held.withColumn("epoch_type", F.lit("samples_epoch"))
    if since is not None and store.exists("epoch_done"):
        new = new.join(store.done(since).select(*KEY), KEY, "left_anti")
    new = new.drop("epoch_type").persist()
    if new.isEmpty():
        new.unpersist()
        held.unpersist()
        return
    checked = kept = None
    try:
        events = events_of(new)
        commits = integrity.batch_commits(events)
        claimed = commits.join(new.select("source_id", "batch_seq", "batch_hash", "aggregator_id", "sequence"), ["source_id", "batch_seq"])
        known = last_link = None
        if store.exists("source_tips"):
            known = store.latest("source_tips").select("source_id", "last_seq", "chain_tip")
        if store.exists("epoch_chain"):
            last_link = store.latest("epoch_chain").select("aggregator_id", F.col("final_hash").alias("tip"))
        checked = integrity.verified(claimed, known).persist()
        good, bad = integrity.split_verified(checked)
        kept = events.join(good.select("source_id", "batch_seq"), ["source_id", "batch_seq"], "left_semi").persist()
        # a source goes on from the last batch seen, as it does within one micro-batch
        tips = checked.groupBy("aggregator_id", "sequence", "source_id").agg(F.max("batch_seq").alias("last_seq"), F.max_by("batch_hash", "batch_seq").alias("chain_tip"), F.max_by("status", "batch_seq").alias("status"))
        # an epoch whose batches are all bad is complete as well
        header = new.select("aggregator_id", "sequence").distinct().join(summaries.headers(kept).drop("epoch_type"), ["aggregator_id", "sequence"], "left").fillna(0).withColumn("epoch_type", F.lit("samples_epoch"))
        entries, cells = summaries.samples(kept), summaries.sketch_cells_table(kept)
        states = integrity.samples_commits(entries, summaries.samples_totals(entries))
        store.commit("histogram_epoch", {"hist_cells": summaries.histogram_cells(kept), "hist_keys": summaries.histogram_keys(kept), "epoch_header": header.withColumn("epoch_type", F.lit("histogram_epoch"))})
        store.commit("sketch_epoch", {"cm_cells": cells, "cm_slots": summaries.ranked_slots(kept, cells), "epoch_header": header.withColumn("epoch_type", F.lit("sketch_epoch"))})
        tables = {"samples_entries": entries, "raw_events": kept, "raw_epochs_bad": bad, "source_tips": tips, "epoch_chain": integrity.epoch_chain(states, last_link), "epoch_header": header}
        if maps is not None:
            real = tips.where("status = 'ok'").select("aggregator_id", "sequence", "source_id", "last_seq", "chain_tip")
            asked = real.select("source_id", F.explode(F.array(F.col("sequence"), F.col("sequence") + 1)).alias("epoch")).distinct()
            moved = ownership.transitions(ownership.owners(maps, asked, default_owner))
            tables["handoffs"] = real.join(moved.withColumn("sequence", F.col("at_epoch") - 1), ["source_id", "sequence"]).select("aggregator_id", "sequence", "source_id", "at_epoch", "from_aggregator", "to_aggregator", "chain_tip", "last_seq")
        store.commit("samples_epoch", tables)
        store.compact()
    finally:
        for rows in (new, checked, kept, held):
            if rows is not None:
                rows.unpersist()


def run(assigned: DataFrame, store, checkpoint: str, available_now: bool = True, maps: DataFrame | None = None):
    """Starts the query that stores the epochs; checkpoint: its folder; maps: ownership, for handoffs."""
    writer = assigned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: processed(store, df, maps))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def windowed_samples(events: DataFrame, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Per event-time window and key: sum and count, of a stream with `event_time`; rows later than the delay are left out."""
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return events.withWatermark("event_time", delay).groupBy(w.alias("w"), "key").agg(F.sum("value").alias("sum"), F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), "key", "sum", "count")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Per session and key: sum and count; a session ends after `gap` without an event; one that comes just `gap` after the last still belongs to it."""
    return events.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("w"), "key").agg(F.sum("value").alias("sum"), F.count("*").alias("count")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "key", "sum", "count")


def split_late(batch: DataFrame, watermark_s: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch against the watermark, for foreachBatch with a side table of late rows."""
    return batch.where(F.col("ts") >= watermark_s), batch.where(F.col("ts") < watermark_s)
