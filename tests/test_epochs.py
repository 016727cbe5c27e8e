"""Epochs that fail and are replayed, triggers, handoffs, chains in one pass and vectorised hashes."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.functions import hashing, keys
from tallybook.functions.keys import key_from_u64
from tallybook.operators import batching, integrity, recovery, summaries
from tallybook.operators import window_queries as wq
from tallybook.sources import messages, tables
from tallybook.streaming import epochs

ZERO = b"\0" * 32


# --- picking and triggers -----------------------------------------------------------------------------------------
def test_epochs_are_picked_in_order_of_source_and_time():
    ready = [(5, 1, 0), (1, 1, 1), (2, 2, 0), (9, 2, 1)]
    assert epochs.picked(ready, 2, 1, False) == [(2, 2, 0), (5, 1, 0)]  # batch 1 of source 1 came first, but follows batch 0
    assert epochs.picked(ready, 5, 1, False) == [] and len(epochs.picked(ready, 5, 1, True)) == 4
    assert epochs.picked([], 1, 1, True) == []


def test_min_sources_never_blocks():
    early = [(i, 1, i) for i in range(6)]
    # other sources' first batches come in place of the latest of the slice
    assert {x[1] for x in epochs.picked([*early, (50, 2, 0), (60, 3, 0)], 4, 3, False)} == {1, 2, 3}
    assert [x[1:] for x in epochs.picked([*early, (50, 2, 0), (60, 3, 0)], 4, 3, False)] == [(1, 0), (1, 1), (2, 0), (3, 0)]
    # one source only: waits for others, but not beyond the timeout or a drain run
    assert epochs.picked(early, 4, 2, False) == [] and len(epochs.picked(early, 4, 2, True)) == 4
    assert len(epochs.picked([*early, (9, 2, 0)], 4, 9, True)) == 4


def test_epochs_are_drawn_as_they_are_picked_and_in_linear_time():
    """F2, F3, F4, F15: a micro-batch of many epochs."""
    rng = random.Random(3)
    for min_sources in (1, 2, 3):
        for _ in range(60):
            left = [(rng.randrange(6), s, n) for s in range(rng.randrange(1, 4)) for n in range(rng.randrange(1, 9))]
            partial, threshold, want = rng.random() < 0.5, rng.randrange(1, 5), []
            got = [[x[1:] for x in e] for e in epochs.drawn(list(left), threshold, min_sources, partial)]
            while now := epochs.picked(left, threshold, min_sources, partial):
                want.append([x[1:] for x in now])
                left = [x for x in left if x[1:] not in {y[1:] for y in now}]
            assert got == want
    begun = time.perf_counter()
    assert sum(len(e) for e in epochs.drawn([(n, s, n) for s in range(2) for n in range(50_000)], 16, 1, True)) == 100_000
    assert time.perf_counter() - begun < 5


def test_batches_that_leave_at_once_never_touch_the_state():
    handle, assigner = Handle(), epochs.EpochAssigner(threshold=2, force=True)
    assigner.init(handle)
    assigner.waiting.updateValue = assigner.ready.updateValue = None  # would fail
    frames = list(assigner.handleInputRows((0,), arrivals(*((1, i, i) for i in range(7)), (1, 3, 3)), Clock(0)))
    assert [(n, s) for f in frames for n, s in zip(f["batch_seq"], f["sequence"], strict=True)] == [(i, i // 2) for i in range(7)]
    assert assigner.expected == {(1,): (7,)} and assigner.next_epoch.get() == (4,)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    containsKey, getValue, removeKey, updateValue, iterator = dict.__contains__, dict.__getitem__, dict.pop, dict.__setitem__, lambda self: iter(list(self.items()))


class Handle:
    """State in memory, and the timers that are set."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def arrivals(*batches):
    import pandas as pd

    return iter([pd.DataFrame([(s, n, t, ZERO, [{"key": b"k", "value": 1, "ts": 1}]) for s, n, t in batches], columns=["source_id", "batch_seq", "ingest_time_ms", "batch_hash", "events"])])


def places(frames):
    return [sorted(zip(f["source_id"], f["batch_seq"], strict=True)) for f in frames]


def test_a_trickle_times_out_from_its_first_batch():
    handle, assigner = Handle(), epochs.EpochAssigner(threshold=100, timeout_ms=1000)
    assigner.init(handle)
    for i in range(9):
        assert list(assigner.handleInputRows((0,), arrivals((1, i, i)), Clock(100 * i))) == []
        assert handle.timers == {1000}  # later batches leave it as it is
    handle.timers.clear()
    assert places(assigner.handleExpiredTimer((0,), Clock(1000), None)) == [[(1, i) for i in range(9)]]
    assert not handle.timers and not assigner.waiting and not assigner.ready
    list(assigner.handleInputRows((0,), arrivals((1, 9, 9)), Clock(5000)))
    assert handle.timers == {6000}


def test_gaps_wait_duplicates_are_dropped_and_the_timer_follows_what_is_left():
    handle, assigner = Handle(), epochs.EpochAssigner(threshold=2, timeout_ms=1000)
    assigner.init(handle)
    assert list(assigner.handleInputRows((0,), arrivals((1, 1, 5), (1, 2, 6)), Clock(0))) == [] and not handle.timers  # nothing is ready
    assert places(assigner.handleInputRows((0,), arrivals((1, 0, 1), (1, 2, 6)), Clock(10))) == [[(1, 0), (1, 1)]]
    assert handle.timers == {1010} and set(assigner.ready) == {(1, 2)}
    assert list(assigner.handleInputRows((0,), arrivals((1, 0, 1), (1, 2, 6)), Clock(20))) == []  # replays change nothing
    assert places(assigner.handleInputRows((0,), arrivals((2, 0, 7)), Clock(30))) == [[(1, 2), (2, 0)]]
    assert not handle.timers and not assigner.waiting


# --- failures and replays -----------------------------------------------------------------------------------------
def assigned(spark, sequences, sources=(0, 4), tampered=()):
    """Epochs of aggregator 0: a batch of two events of each source in each, chained."""
    rows = [(0, e, s, e, 1000 * e, [(10 * s + i, e + i + 1, e) for i in range(2)]) for e in range(max(sequences) + 1) for s in sources]
    df = spark.createDataFrame(rows, "aggregator_id long, sequence long, source_id int, batch_seq long, ingest_time_ms long, e array<struct<k:long,value:long,ts:long>>")
    df = df.withColumn("events", F.transform("e", lambda x: F.struct(key_from_u64(x["k"]).alias("key"), x["value"].alias("value"), x["ts"].alias("ts")))).drop("e")
    chain = integrity.chained(integrity.batch_commits(epochs.events_of(df))).select("source_id", "batch_seq", "batch_hash")
    wrong = F.when(F.array_contains(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).cast("long").alias("n")) for s, n in tampered)), F.struct(F.col("source_id").alias("s"), F.col("batch_seq").alias("n"))), F.unhex(F.lit("ab" * 32))).otherwise(F.col("batch_hash")) if tampered else F.col("batch_hash")
    return df.join(chain, ["source_id", "batch_seq"]).withColumn("batch_hash", wrong).where(F.col("sequence").isin(list(sequences))).select("aggregator_id", "sequence", "source_id", "batch_seq", "ingest_time_ms", "batch_hash", "events")


def contents(store):
    """All that complete epochs hold, ready to compare."""
    names = ["epoch_header", "samples_entries", "hist_cells", "hist_keys", "cm_cells", "cm_slots", "raw_events", "source_tips", "epoch_chain"]
    return {n: sorted(map(str, store.read(n).select(sorted(store.read(n).columns)).collect())) for n in names} | {"bad": store.read("raw_epochs_bad").count(), "done": sorted((r.epoch_type, r.sequence) for r in store.done().collect())}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What a store holds without failures."""
    store = tables.EpochStore(spark, str(tmp_path_factory.mktemp("whole")))
    for sequences in ([0], [1, 2]):
        epochs.processed(store, assigned(spark, sequences))
    held = contents(store)
    assert held["bad"] == 0 and len(held["done"]) == 9 and len(held["epoch_chain"]) == 3
    return held


@pytest.mark.parametrize("fails", ["source_tips", "epoch_done 3"])
def test_a_replay_after_a_failure_leaves_the_same_tables(spark, tmp_path, monkeypatch, whole, fails):
    store = tables.EpochStore(spark, str(tmp_path / "store"))
    epochs.processed(store, assigned(spark, [0]))
    name, nth = (*fails.split(), "1")[:2]
    left, real = [int(nth)], tables.EpochStore.append

    def failing(self, table, rows, partitioned=True):
        if table == name and left[0]:
            left[0] -= 1
            if not left[0]:
                raise OSError("the disk is gone")
        real(self, table, rows, partitioned)

    with monkeypatch.context() as m:
        m.setattr(tables.EpochStore, "append", failing)
        with pytest.raises(OSError, match="the disk is gone"):
            epochs.processed(store, assigned(spark, [1, 2]))
    for _ in range(2):  # the micro-batch comes again, and once more
        epochs.processed(store, assigned(spark, [1, 2]))
    assert contents(store) == whole
    assert store.sweep() == 0  # what the failed attempt wrote was swept before the replay


def test_an_epoch_counts_once_even_if_two_attempts_are_marked(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    head = spark.createDataFrame([(0, 1, 5)], "aggregator_id long, sequence long, n_events long")
    store.commit("samples_epoch", {"epoch_header": head}, 1)
    late = head.withColumn("epoch_type", F.lit("samples_epoch")).withColumn("attempt", F.lit("zombie"))
    store.append("epoch_header", late)
    store.append("epoch_done", late.select("epoch_type", "aggregator_id", "sequence", "attempt").withColumn("completed_at_ms", F.lit(9).cast("long")), partitioned=False)
    assert store.read("epoch_header").count() == 1 and store.done().count() == 1


def test_bad_batches_are_set_aside_and_their_source_goes_on(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    for sequences in ([0, 1], [2, 3]):
        epochs.processed(store, assigned(spark, sequences, tampered=((4, 1),)))
    bad = [(r.source_id, r.batch_seq, r.status) for r in store.read("raw_epochs_bad").collect()]
    # its successor names another predecessor's hash than the one that came
    assert sorted(bad) == [(4, 1, "bad_hash"), (4, 2, "bad_hash")]
    assert store.read("raw_events").count() == 12 and store.read("epoch_header", "samples_epoch").count() == 4


def test_handoffs_and_the_epoch_chain_are_committed_and_epochs_retired(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    maps = spark.createDataFrame([(0, 0, 0), (0, 4, 0), (2, 0, 0), (2, 4, 3)], "epoch_seq long, source_id int, owner int")
    for sequences in ([0, 1], [2]):
        epochs.processed(store, assigned(spark, sequences), maps)
    handed = store.read("handoffs").collect()
    assert [(r.source_id, r.at_epoch, r.from_aggregator, r.to_aggregator, r.last_seq) for r in handed] == [(4, 2, 0, 3, 1)]
    assert handed[0].chain_tip == assigned(spark, [1], [4]).first().batch_hash
    chain = store.read("epoch_chain")
    assert {r.status for r in integrity.epoch_chain_verified(chain.select("aggregator_id", "sequence", "prev_hash", "state_commit", "final_hash")).collect()} == {"ok"} and chain.count() == 3
    raw = store.read("raw_events", "samples_epoch")
    assert store.retire("raw_events", recovery.droppable(raw, store.done()).where("sequence < 1")) == 0  # its folder holds epoch 1 as well
    assert store.retire("raw_events", recovery.droppable(raw, store.done()).where("sequence < 2")) == 1
    assert {r.sequence for r in store.read("raw_events").collect()} == {2} and store.read("samples_entries").count() == 12


# --- chains and commitments ---------------------------------------------------------------------------------------
def test_long_chains_are_linear_and_go_on_from_tips(spark):
    commits = spark.range(300_000).select(F.lit(1).alias("source_id"), F.col("id").alias("batch_seq"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("commit"))
    began = time.perf_counter()
    last = integrity.chained(commits).orderBy(F.desc("batch_seq")).first()
    assert time.perf_counter() - began < 60
    h = ZERO
    for i in range(300_000):
        if i == 200_000:
            middle = h
        h = hashlib.sha256(integrity.TAGS["chain"] + h + hashlib.sha256(str(i).encode()).digest()).digest()
    assert bytes(last.batch_hash) == h
    tips = spark.createDataFrame([(1, middle)], "source_id int, tip binary")
    assert bytes(integrity.chained(commits.where("batch_seq >= 200000"), tips=tips).orderBy(F.desc("batch_seq")).first().batch_hash) == h


@pytest.mark.parametrize("size", [1, 3, 8, 0])
def test_batches_committed_as_they_pass_are_those_of_windows(spark, size):
    r = random.Random(size)
    rows = [(s, t // 7, t, i, r.getrandbits(63), r.getrandbits(32), r.getrandbits(31)) for i, (s, t) in enumerate((r.choice([1, 1, 1, 2, 3]), r.randint(0, 60)) for _ in range(400))]
    e = spark.createDataFrame(rows, "source_id int, slice long, t long, i long, k long, value long, ts long").withColumn("key", key_from_u64(F.col("k"))).repartition(5)
    want = integrity.batch_commits(batching.with_batches(e, ["t", "i"], size))
    got = integrity.committed(e, ["t", "i"], "slice", size)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert integrity.committed(e, ["t", "i"], "slice", size).exceptAll(want.select(got.columns)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert integrity.committed(e.where("false"), ["t", "i"], "slice", size).count() == 0


# --- hashes, sketches, percentiles --------------------------------------------------------------------------------
def test_vectorised_hashes_are_those_of_columns(spark):
    r = random.Random(1)
    raw = [b"", b"\0", b"abc", None, *(r.randbytes(15) for _ in range(40))]
    df = spark.createDataFrame([(b,) for b in raw], "key binary").select("key", keys.key_hash(F.col("key")).alias("h"))
    got = df.select("key", "h", hashing.key_hash(F.col("key")).alias("v"), keys.sketch_cells(F.col("h")).alias("c"), hashing.sketch_cells(F.col("key"), keys.SKETCH_SEEDS, keys.SKETCH_COLUMNS).alias("w"), keys.sample_bucket(F.col("h")).alias("b"), hashing.hash_buckets(F.col("key"), keys.SAMPLE_BUCKETS).alias("x")).collect()
    for row in got:
        if row.key is not None:
            assert (row.h, row.c, row.b) == (row.v, row.w, row.x)
    assert hashing.fnv1a64(pa.array([b"abc"], pa.binary()))[0] == 0xE71FA2190541574B


def test_partial_sketches_merge(spark):
    r = random.Random(2)
    e = spark.createDataFrame([(0, r.randint(0, 1), r.randint(1, 30), r.randint(0, 99), i) for i in range(400)], "aggregator_id long, sequence long, k long, value long, i long").withColumn("key", key_from_u64(F.col("k")))
    cells = summaries.sketch_cells_table(e)
    parts = [summaries.sketch_cells_table(e.where(F.col("i") % 3 == k)) for k in range(3)]
    whole = summaries.merged_cells(parts)
    assert whole.exceptAll(cells.select(whole.columns)).count() == 0 and whole.count() == cells.count()
    slots = [summaries.ranked_slots(e.where(F.col("i") % 3 == k), p) for k, p in enumerate(parts)]
    assert summaries.merged_slots(slots, whole).exceptAll(summaries.ranked_slots(e, cells)).count() == 0


def test_percentiles_by_counts(spark):
    r = random.Random(5)
    values = [int(r.expovariate(1 / 20_000)) for _ in range(997)]
    row = wq.raw_extremes(spark.createDataFrame([(v,) for v in values], "value long")).first()
    values.sort()
    assert (row["min"], row["max"], row.support) == (values[0], values[-1], 997)
    assert [row.p50, row.p90, row.p95, row.p99] == [next(v for n, v in enumerate(values) if n + 1 >= 997 * q) for q in (0.5, 0.9, 0.95, 0.99)]
    assert wq.raw_extremes(spark.createDataFrame([], "value long")).first().suppressed
    e = spark.createDataFrame([(0, i % 3, i) for i in range(20)], "aggregator_id long, sequence long, idx long")
    assert sorted(x.idx for x in wq.first_of_epochs(e, 2).collect()) == [0, 1, 2, 3, 4, 5]


# --- restarts -----------------------------------------------------------------------------------------------------
def test_a_stream_with_timers_goes_on_after_a_restart(spark, tmp_path):
    """Partial epochs leave by timer; a stopped query goes on with its state, and what it has stored stays."""
    batches = assigned(spark, [0, 1, 2]).drop("aggregator_id", "sequence").persist()
    store, topic = tables.EpochStore(spark, str(tmp_path / "store")), str(tmp_path / "topic")

    def until(n):
        stream = epochs.epochs(messages.parsed(messages.stream(spark, path=topic)), 4, timers=True, threshold=100, timeout_ms=1500)
        q = epochs.run(stream, store, str(tmp_path / "checkpoint"), available_now=False)
        try:
            for _ in range(240):
                if store.exists("raw_events") and store.read("raw_events", "samples_epoch").count() >= n:
                    return
                assert q.isActive, q.exception()
                time.sleep(0.5)
            raise AssertionError("the timer never came")
        finally:
            q.stop()

    messages.send(batches.where("batch_seq = 0"), 4, path=topic)
    until(4)
    messages.send(batches.where("batch_seq != 1 or source_id = 0"), 4, path=topic)  # batch 0 again; batch 2 of source 4 waits for 1
    until(8)
    messages.send(batches.where("batch_seq = 1 and source_id = 4"), 4, path=topic)
    until(12)
    got = store.read("samples_entries").groupBy("key").agg(F.sum("sum").alias("sum"), F.sum("count").alias("n"))
    want = batches.select(F.explode("events").alias("e")).groupBy("e.key").agg(F.sum("e.value").alias("sum"), F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 4
    assert store.read("raw_epochs_bad").count() == 0 and store.read("epoch_chain").count() >= 3
