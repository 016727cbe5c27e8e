"""Batches, chains, Merkle trees, ownership, recovery, privacy and sketches on small cases with known results."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallybook.functions import hashing, keys
from tallybook.functions.keys import KeyMask, be, key_from_u64, sketch_cells
from tallybook.operators import batching, integrity, ownership, privacy, recovery, summaries
from tallybook.operators import window_queries as wq
from tallybook.plans.facade import PolicyViolation, run_query
from tallybook.sources.shared import ranged
from tallybook.plans.telemetry import epoch_summaries, tele_events

ZERO, TIP = b"\0" * 32, b"\x01" * 32


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def events(spark, rows):
    df = spark.createDataFrame(rows, "aggregator_id long, sequence long, source_id int, k long, value long, ts long")
    return df.withColumn("key", key_from_u64(F.col("k"))).withColumn("ingest_time_ms", F.col("ts") * 1000)


# --- chains -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def chain(spark):
    e = events(spark, [(0, 0, s, i, i * 10, i) for s in (1, 2) for i in range(20)])
    return integrity.chained(integrity.batch_commits(batching.with_batches(e, ["ts"], 4))).persist()


def test_chain_is_a_plain_fold(chain):
    for source in (1, 2):
        h = ZERO
        for r in chain.where(F.col("source_id") == source).orderBy("batch_seq").collect():
            want = sha(*(b"\0" * 7 + i.to_bytes(8, "big") + (i * 10).to_bytes(4, "big") + i.to_bytes(4, "big") for i in range(r.batch_seq * 4, r.batch_seq * 4 + 4)))
            assert bytes(r.commit) == want and bytes(r.prev_hash) == h
            h = sha(integrity.TAGS["chain"], h, want)
            assert bytes(r.batch_hash) == h


def test_tampering_is_found_where_it_is(chain):
    assert integrity.verified(chain).where("status != 'ok'").count() == 0
    bad = chain.withColumn("commit", F.when((F.col("source_id") == 1) & (F.col("batch_seq") == 2), F.unhex(F.lit("ab"))).otherwise(F.col("commit")))
    assert [(r.source_id, r.batch_seq) for r in integrity.verified(bad).where("status != 'ok'").collect()] == [(1, 2)]
    good, worse = integrity.split_verified(integrity.verified(chain.where("batch_seq != 1")))
    assert {(r.batch_seq, r.status) for r in worse.collect()} == {(2, "gap")} and good.count() == 6
    with pytest.raises(Exception, match="chain violation"):
        integrity.split_verified(integrity.verified(bad), fail_fast=True)[0].collect()


def test_verification_goes_on_from_tips(spark, chain):
    tips = integrity.tips(integrity.verified(chain.where("batch_seq < 2")))
    assert integrity.verified(chain.where("batch_seq >= 2"), tips).where("status != 'ok'").count() == 0
    assert integrity.verified(chain.where("batch_seq >= 2")).where("status = 'gap'").count() == 2


def test_epoch_chain_modes(spark):
    commits = spark.createDataFrame([(0, s, sha(bytes([s]))) for s in range(4)], "aggregator_id long, sequence long, state_commit binary")
    chain = integrity.epoch_chain(commits)
    assert integrity.chain_facts(integrity.epoch_chain_verified(chain, commits)).first().ok
    again = integrity.epoch_chain(commits.where("sequence >= 2")).unionByName(chain.where("sequence < 2"))
    assert integrity.epoch_chain_verified(again).where("status != 'ok'").count() == 1
    assert integrity.epoch_chain_verified(again, mode="reference").where("status != 'ok'").count() == 0
    other = commits.withColumn("state_commit", F.when(F.col("sequence") == 1, F.unhex(F.lit("00"))).otherwise(F.col("state_commit")))
    assert [r.sequence for r in integrity.epoch_chain_verified(chain, other).where("not state_ok").collect()] == [1]


def test_merkle_roots_and_proofs(spark):
    leaves = spark.createDataFrame([(0, 0, i, bytes([i])) for i in range(11)], "aggregator_id long, sequence long, idx long, b binary")
    level = [sha(b"\0", bytes([i])) for i in range(11)] + [sha(b"\0")] * 5
    while len(level) > 1:
        level = [sha(b"\1", level[i], level[i + 1]) for i in range(0, len(level), 2)]
    by = ["aggregator_id", "sequence"]
    assert bytes(integrity.merkle_roots(leaves, by, 16).first().root) == level[0]
    for proofs in (integrity.inclusion_proofs(integrity.merkle_levels(leaves, by, 16), leaves.select(*by, "idx"), by), integrity.dense_proofs(integrity.dense_trees(leaves, by, 16), leaves.select(*by, "idx"), by)):
        rows = proofs.withColumn("got", integrity.path_root(F.col("leaf"), F.col("path"), F.col("idx"))).collect()
        assert len(rows) == 11 and all(bytes(r.got) == level[0] == bytes(r.root) for r in rows)


def test_merkle_trees_of_any_size(spark):
    """Depth from each tree's own leaves, over several blocks; gaps are leaves of nothing; changed leaves' paths alone are hashed again."""
    by, sizes = ["aggregator_id", "sequence"], {0: 1, 1: 2, 2: 6, 3: 1024, 4: 1025, 5: 5000}
    byte = lambda i: b"%d" % i
    rows = [(0, s, i, byte(i)) for s, n in sizes.items() for i in range(n) if i % 97 != 5 or i == n - 1]
    leaves = spark.createDataFrame(rows, "aggregator_id long, sequence long, idx long, b binary")

    def levels(n, of, least=1):
        size = max(least, 1 << (n - 1).bit_length())
        level = [sha(b"\0", of(i)) if i < n and (i % 97 != 5 or i == n - 1) else sha(b"\0") for i in range(size)]
        out = [level]
        while len(level) > 1:
            level = [sha(b"\1", level[i], level[i + 1]) for i in range(0, len(level), 2)]
            out.append(level)
        return out

    nodes = integrity.merkle_nodes(leaves, by)
    tops = {r.sequence: bytes(r.root) for r in integrity.merkle_tops(nodes, by).collect()}
    assert tops == {s: levels(n, byte)[-1][0] for s, n in sizes.items()}
    assert {r.sequence: bytes(r.root) for r in integrity.merkle_roots(leaves, by, 2048).collect()} == {s: levels(n, byte, 2048)[-1][0] for s, n in sizes.items()}
    paths = integrity.merkle_paths(nodes, leaves.select(*by, "idx"), by).withColumn("got", integrity.path_root(F.col("leaf"), F.col("path"), F.col("idx"))).collect()
    assert len(paths) == len(rows) and all(bytes(r.got) == bytes(r.root) == tops[r.sequence] and len(r.path) == (sizes[r.sequence] - 1).bit_length() for r in paths)
    change = {(3, 1000), (5, 0), (5, 1), (5, 2047), (5, 4999), (2, 3), (0, 0)}
    changed = integrity.merkle_changed(nodes, spark.createDataFrame([(0, s, i, b"new") for s, i in change], "aggregator_id long, sequence long, idx long, b binary"), by)
    want = {s: levels(n, lambda i, s=s: b"new" if (s, i) in change else byte(i)) for s, n in sizes.items()}
    got = {(r.sequence, r.level, r.idx): bytes(r.h) for r in changed.collect()}
    assert len(got) == nodes.count() and all(want[s][level][i] == h for (s, level, i), h in got.items())
    with pytest.raises(Exception, match="a leaf beyond"):
        integrity.merkle_changed(nodes, spark.createDataFrame([(0, 2, 8, b"new")], "aggregator_id long, sequence long, idx long, b binary"), by)
    few = spark.createDataFrame([(0, 0, i, bytes([i])) for i in range(6)], "aggregator_id long, sequence long, idx long, b binary")
    for cut in (integrity.merkle_levels(few, by, 4)[-1], integrity.dense_trees(few, by, 4)):
        with pytest.raises(Exception, match="a leaf beyond"):
            cut.collect()
    assert integrity.merkle_roots(few.where("false"), by).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_made_block_by_block(spark):
    """no row for each step of each path is shuffled; what is asked for and not there, or of no tree, gives no path."""
    by = ["aggregator_id"]
    leaves = spark.createDataFrame([(a, i, bytes([a]) + i.to_bytes(4, "big")) for a, n in ((0, 1500), (1, 1), (2, 7)) for i in range(n)], "aggregator_id long, idx long, b binary")
    nodes = integrity.merkle_nodes(leaves, by)
    asked = spark.createDataFrame([(0, 0), (0, 1023), (0, 1024), (0, 1499), (0, 1500), (1, 0), (2, 6), (2, 7), (9, 0)], "aggregator_id long, idx long")
    paths = integrity.merkle_paths(nodes, asked, by)
    assert "Generate" not in plan(paths)
    found = paths.withColumn("ok", integrity.path_root(F.col("leaf"), F.col("path"), F.col("idx")) == F.col("root")).join(integrity.merkle_tops(nodes, by).withColumnRenamed("root", "top"), by).collect()
    assert {(r.aggregator_id, r.idx): len(r.path) for r in found} == {(0, 0): 11, (0, 1023): 11, (0, 1024): 11, (0, 1499): 11, (1, 0): 0, (2, 6): 3}
    assert all(r.ok and r.root == r.top for r in found)


def test_a_large_tree_is_not_one_task_of_its_depths_join(spark):
    """leaves meet their tree's depth by chunk, and places within `by` are numbered without a window over its rows."""
    depths = integrity._depths(spark.range(200_000).select(F.lit(0).alias("t"), F.col("id").alias("idx")), ["t"], 1)
    assert sorted((r.chunk, r.depth) for r in depths.collect()) == [(i, 18) for i in range(4)]
    placed = ranged(spark.range(1000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("v")), ["k"], [F.col("v")])
    assert "Window" not in plan(placed)
    assert sorted((r.k, r.v, r.nth) for r in placed.collect()) == sorted((k, v, n) for k in range(3) for n, v in enumerate(sorted(-i for i in range(1000) if i % 3 == k)))


def test_roots_of_changed_trees_shuffle_no_replaced_nodes(spark):
    """asking for tops filters what was replaced as well."""
    by = ["aggregator_id"]
    nodes = integrity.merkle_nodes(spark.range(9).select(F.lit(0).alias("aggregator_id"), F.col("id").alias("idx"), F.lit(b"x").alias("b")), by)
    new = spark.range(3, 5).select(F.lit(0).alias("aggregator_id"), F.col("id").alias("idx"), F.lit(b"y").alias("b"))
    tops = integrity.merkle_tops(integrity.merkle_changed(nodes, new, by), by)
    anti = plan(tops).split("Join LeftAnti")[1].split("Union")
    assert all("(level" in part and "= depth" in part for part in anti[1:3])
    want = spark.range(9).select(F.lit(0).alias("aggregator_id"), F.col("id").alias("idx"), F.when(F.col("id").isin(3, 4), F.lit(b"y")).otherwise(F.lit(b"x")).alias("b"))
    assert tops.collect() == integrity.merkle_roots(want, by).collect()


def test_checkpoints_and_audit(chain):
    published = integrity.checkpoints(chain, 2)
    assert {(r.source_id, r["index"]) for r in published.collect()} == {(s, i) for s in (1, 2) for i in (2, 4)}
    assert {r.verdict for r in integrity.audited(published, chain).collect()} == {"match"}
    assert {r.verdict for r in integrity.audited(published, chain.where("batch_seq < 2")).collect()} == {"match", "missing"}


# --- batches ------------------------------------------------------------------------------------------------------
def test_batches_gaps_and_prefixes(spark):
    got = spark.createDataFrame([(1, s) for s in (3, 4, 6)] + [(2, s) for s in (5, 6)], "source_id int, batch_seq long")
    expected = spark.createDataFrame([(1, 3), (2, 3)], "source_id int, next_seq long")
    assert [(r.source_id, r.batch_seq) for r in batching.contiguous(got, expected).orderBy("batch_seq").collect()] == [(1, 3), (1, 4)]
    assert batching.contiguous(got, expected, allow_gaps=True).count() == 5
    incoming = spark.createDataFrame([(1, 5, 6), (2, 7, 7), (3, 3, 4)], "source_id int, min_seq long, max_seq long")
    want = spark.createDataFrame([(i, 5) for i in (1, 2, 3, 4)], "source_id int, next_seq long")
    assert {r.source_id: r.status for r in batching.precheck(want, incoming).collect()} == {1: "OK", 2: "GAP!", 3: "OVERLAP", 4: "NO INCOMING BATCHES"}
    arrivals = spark.createDataFrame([(1, s, i) for i, s in enumerate([0, 1, 1, 4, 0])], "source_id int, batch_seq long, arrival long")
    assert [r.status for r in batching.sequence_report(arrivals).orderBy("arrival").collect()] == ["first", "next", "duplicate", "gap", "restart"]
    twice = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 2, "c")], "source_id int, batch_seq long, arrival long, batch_hash string")
    assert {(r.batch_seq, r.batch_hash, r.deliveries, r.conflict) for r in batching.deduplicated(twice).collect()} == {(0, "a", 2, True), (1, "c", 1, False)}
    assert {r.batch_hash for r in batching.deduplicated(twice, "last").collect()} == {"b", "c"}


def test_epochs_of_batches(spark):
    b = spark.createDataFrame([(0, i, i % 2, i) for i in range(10)] + [(1, 0, 5, 0)], "aggregator_id long, ingest_time_ms long, source_id int, batch_seq long")
    assert {(r.aggregator_id, r.epoch_seq): r["count"] for r in batching.epochs(b, 4).groupBy("aggregator_id", "epoch_seq").count().collect()} == {(0, 0): 4, (0, 1): 4, (0, 2): 2, (1, 0): 1}
    assert batching.epochs(b, 4, min_sources=2).where("aggregator_id = 1").count() == 0


# --- ownership ----------------------------------------------------------------------------------------------------
def test_owners_are_those_of_the_latest_map(spark):
    """Random maps against a plain search: maps that lack a source, epochs before any map, blocks of epochs far apart."""
    r = random.Random(17)
    maps = {e: {s: r.randint(0, 4) for s in range(6) if r.random() < 0.7} for e in [3, 4, 900, 1023, 1024, 1025, 5000, 70_000]}
    asked = [(s, e) for e in [0, 2, 3, 4, 5, 1022, 1023, 1024, 1026, 4999, 5000, 69_999, 70_000, 10**6] for s in range(7)]
    rows = [(e, s, o) for e, m in maps.items() for s, o in m.items()]
    got = {(x.source_id, x.epoch): x.owner for x in ownership.owners(spark.createDataFrame(rows, "epoch_seq long, source_id int, owner int"), spark.createDataFrame(asked, "source_id int, epoch long"), 77).collect()}
    installed = sorted(e for e, m in maps.items() if m)

    def plain(s, e):
        before = [i for i in installed if i <= e]
        return maps[before[-1]].get(s, 77) if before else 77

    assert got == {(s, e): plain(s, e) for s, e in asked}
    active = ownership.active_maps(spark.createDataFrame(rows, "epoch_seq long, source_id int, owner int"), spark.createDataFrame([(e,) for _, e in asked], "epoch long"))
    assert {x.epoch: x.epoch_seq for x in active.collect()} == {e: max((i for i in installed if i <= e), default=None) for _, e in asked}


# fixed values: how many of twelve sources change their owner
@pytest.mark.parametrize(("x", "y", "moved"), [(3, 5, 9), (2, 4, 6), (4, 2, 6), (3, 3, 0)])
def test_reshard_moves(spark, x, y, moved):
    maps = spark.createDataFrame([(0, s, s % x) for s in range(12)] + [(1, s, s % y) for s in range(12)], "epoch_seq long, source_id int, owner int")
    assert ownership.map_changes(maps, 0, 1).count() == moved
    owned = maps.where("epoch_seq = 1").select("source_id", "owner")
    assert ownership.coverage(owned, y).first().covered


def test_inheritance_and_continuity(spark):
    tips = spark.createDataFrame([(1, TIP, 23, 0), (2, ZERO, -1, 0), (5, TIP, 3, 2)], "source_id int, chain_tip binary, last_seq long, owner int")
    hand = spark.createDataFrame([(2, 7, TIP, 4, 0), (3, 7, ZERO, -1, 0)], "source_id int, at_epoch long, chain_tip binary, last_seq long, from_aggregator long")
    incoming = spark.createDataFrame([(s, 7, 2) for s in (1, 2, 3, 4, 5)], "source_id int, at_epoch long, reader int")
    got = {r.source_id: (r.origin, r["class"], r.last_seq) for r in ownership.inherited(incoming, tips, hand).collect()}
    assert got == {1: ("tip", "moved", 23), 2: ("handoff", "moved", 4), 3: ("cold", "new", -1), 4: ("cold", "new", -1), 5: ("tip", "kept", 3)}
    s = ownership.continuity_summary(ownership.continuity(hand)).first()
    assert (s.handoffs, s.continuous, s.broken, s.all_continuous) == (2, 1, 1, False)
    state = tips.withColumn("updated_at_epoch", F.lit(1))
    assert ownership.merged_state([state, state.withColumn("updated_at_epoch", F.lit(2))], ["source_id"]).count() == 2


def test_maps_cannot_change_the_past(spark):
    maps = spark.createDataFrame([(10, 7, 1)], "epoch_seq long, source_id int, owner int")

    def install(rows):
        return ownership.installed(maps, spark.createDataFrame(rows, "epoch_seq long, source_id int, owner int"), 15).collect()

    assert len(install([(20, 7, 1), (20, 8, 1)])) == 2
    for bad in ([(12, 7, 1)], [(20, 7, 1), (20, 7, 2)]):
        with pytest.raises(Exception, match="map can't|named twice"):
            install(bad)


# --- recovery -----------------------------------------------------------------------------------------------------
def test_orphans_and_retention(spark):
    def table(seqs):
        return spark.createDataFrame([("samples_epoch", 0, s) for s in seqs], "epoch_type string, aggregator_id long, sequence long")

    assert [r.sequence for r in recovery.orphans(table([0]), table([])).collect()] == [0]
    assert recovery.orphans(table([3]), table([3])).count() == 0 and recovery.without_orphans(table([3]), table([3])).count() == 1
    assert [r.sequence for r in recovery.orphans(table([1, 2]), table([1])).collect()] == [2]
    assert recovery.orphans(table([1, 30]), table([1])).count() == 0
    assert sorted(r.sequence for r in recovery.droppable(table([0, 1, 2, 3]), table([0, 1, 3])).collect()) == [0, 1]
    assert recovery.merged_shards([table([1, 2]).withColumn("ingest_time_ms", F.lit(1)), table([2, 3]).withColumn("ingest_time_ms", F.lit(2))]).count() == 3


# --- privacy ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("request_", "policy", "bad"), [
    ({"type": "samples_sum"}, {}, []), ({"type": "samples_sum", "support": 50}, {}, []), ({"type": "cm_topk"}, {"allow_anonymized_ids": True}, []),
    ({"type": "samples_sum_key_pattern", "pattern": "a" + "?" * 15}, {}, []), ({"type": "samples_avg_key", "key": 123}, {}, ["non_aggregate_query"]), ({"type": "cm_topk"}, {}, ["pii_output:key"]),
    ({"type": "samples_sum", "group_by": ["ip"]}, {}, ["group_by_not_allowed:ip"]), ({"type": "samples_sum", "support": 3}, {}, ["low_support"]),
    ({"type": "samples_sum_key_pattern", "pattern": "0123456789abcdef"}, {}, ["non_aggregate_query"]), ({"type": "samples_sum_key", "key": 1, "mask": 255}, {"allow_anonymized_ids": True}, []),
    ({"type": "cm_estimate", "key": 1}, {}, ["non_aggregate_query"]),
])
def test_screening(spark, request_, policy, bad):
    p = privacy.Policy(**policy)
    found = privacy.request_violations(request_, p)
    assert set(bad) <= set(found) and (found == []) == (bad == [])
    mask = request_.get("mask")
    row = spark.createDataFrame([(request_["type"], mask, request_.get("pattern"), request_.get("group_by"), request_.get("support"))], "type string, mask long, pattern string, group_by array<string>, support long")
    table = privacy.screened(row, p).first()
    assert table.ok == (not bad) and sorted(table.violations) == sorted(found)


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        privacy.request_violations({"type": "everything"})
    row = spark.createDataFrame([("everything", None, None, None, None)], "type string, mask long, pattern string, group_by array<string>, support long")
    with pytest.raises(Exception, match="unknown request type"):
        privacy.screened(row).collect()


def test_suppression_boundary_and_noise(spark):
    df = spark.createDataFrame([(9, 5), (10, 5)], "support long, sum long")
    assert {(r.support, r.sum, r.suppressed) for r in privacy.suppressed(df, ["sum"]).collect()} == {(0, 0, True), (10, 5, False)}
    noisy = privacy.released(spark.range(4000).select(F.lit(10**9).cast("long").alias("sum")), "sum", "samples_sum", seed=3, audit=True)
    s = noisy.agg(F.avg("noise").alias("m"), F.avg(F.abs("noise")).alias("a"), F.bool_and(F.col("sum") == 10**9 + F.col("noise")).alias("same")).first()
    assert abs(s.m) < 1e5 and 0.9e6 < s.a < 1.1e6 and s.same
    assert privacy.released(spark.createDataFrame([(0,)] * 50, "sum long"), "sum", "samples_sum", seed=1).where("sum < 0").count() == 0
    assert privacy.calibration(spark).count() == 19


# --- summaries ----------------------------------------------------------------------------------------------------
def test_sketch_bounds_and_slots(spark, sf):
    e = tele_events(spark, sf)
    cells = summaries.sketch_cells_table(e)
    est = summaries.estimates(cells, e)
    exact = e.groupBy(*summaries.EPOCH, "key").agg(F.sum("value").alias("s"))
    assert est.join(exact, [*summaries.EPOCH, "key"]).where("est < s").count() == 0
    replay = summaries.replayed_slots(e.withColumn("idx", F.col("event_id")))
    ranked = summaries.ranked_slots(e, cells)
    # fewer keys than slots: both hold every key
    assert replay.select(*summaries.EPOCH, "key").exceptAll(ranked.select(*summaries.EPOCH, "key")).count() == 0
    few = summaries.replayed_slots(e.withColumn("idx", F.col("event_id")), 3).groupBy(*summaries.EPOCH).count().agg(F.max("count")).first()[0]
    assert few == 3


def test_masked_sums_are_bounded(spark, sf):
    entries = summaries.samples(tele_events(spark, sf))
    whole = wq.samples_sum(summaries.samples_totals(entries)).first()["sum"]
    assert 0 < wq.samples_sum_key(entries, KeyMask(7, 15)).first()["sum"] <= whole
    assert wq.samples_sum(summaries.samples_totals(entries.where("false"))).first().asDict() == {"sum": 0, "support": 0, "suppressed": True}
    assert wq.histogram_percentile(summaries.histogram_cells(tele_events(spark, sf)).where("false")).first().value == 0


def test_replay_order_matters_beyond_slots(spark):
    rows = events(spark, [(0, 0, 1, k, v, t) for t, (k, v) in enumerate([(1, 5), (2, 6), (3, 7), (1, 1)])]).withColumn("idx", F.col("ts"))
    got = {bytes(r.key)[-1]: r.est for r in summaries.replayed_slots(rows, 2).collect()}
    assert got == {2: 6, 3: 7}
    assert spark.range(1).select(F.size(sketch_cells(be(F.lit(1), 8).cast("string").isNull().cast("long"))).alias("n")).first().n == 3


# --- facade -------------------------------------------------------------------------------------------------------
def test_facade_answers_all_kinds(spark, sf):
    tables = epoch_summaries(tele_events(spark, sf).persist())
    free = privacy.Policy(enforce=False)
    asks = [{"type": t, "key": 7, "mask": 15, "bucket": 12, "value": 1234, "pattern": "0000000000000??", "limit": 5, "latest": 9} for t in (
        "samples_sum", "samples_avg", "samples_sum_exact_key", "samples_sum_key", "samples_sum_key_pattern", "samples_avg_key", "samples_sum_topk", "histogram_bucket", "histogram_all", "histogram_all_key",
        "histogram_p90", "cm_estimate", "cm_topk", "samples_raw_max_key", "samples_raw_stats_key", "samples_raw_histogram_bucket_key", "samples_raw_cm_estimate_key")]
    assert len(asks) == 17
    for a in asks:
        assert run_query(tables, a, free).count() >= 0
    with pytest.raises(PolicyViolation):
        run_query(tables, {"type": "samples_avg_key", "key": 123})
    assert run_query(tables, {"type": "samples_sum", "window": "2d", "end_ms": 1704067200000 + 5 * 86400000}).count() == 1
    exact, noisy = (run_query(tables, {"type": "samples_sum"}, dp=d, seed=5).first()["sum"] for d in (None, "laplace"))
    assert exact != noisy and run_query(tables, {"type": "samples_sum"}, dp="offset").first().dp_offset == 50


def test_raw_requests_have_a_guard(spark, sf):
    tables = epoch_summaries(tele_events(spark, sf))
    n = tables["raw_events"].count()
    request = {"type": "samples_raw_stats_key", "key": 0, "mask": 0}
    assert run_query(tables, request, policy=privacy.Policy(enforce=False), max_events=n).count() == 1
    with pytest.raises(wq.TooManyEvents, match=f"more than {n - 1} events"):
        run_query(tables, request, policy=privacy.Policy(enforce=False), max_events=n - 1)


def test_ranks_of_values_however_far_apart(spark):
    r = random.Random(8)
    values = [r.choice([r.getrandbits(64) - 2**63, r.randint(-5, 5), 2**63 - 1, -(2**63)]) for _ in range(500)]
    counts = spark.createDataFrame([(v,) for v in values], "value long").groupBy("value").agg(F.count("*").alias("n"))
    got = {x.q: x.value for x in wq.ranked_values(counts, spark.createDataFrame([(i, i) for i in range(1, 501)], "q int, rank long")).collect()}
    assert got == dict(enumerate(sorted(values), 1))


def test_reports_of_one_source_are_many_tasks_work(spark):
    r = random.Random(6)
    arrived = [r.choice([i, i, i, i + 2, 0, max(0, i - 1)]) for i in range(600)]
    df = spark.createDataFrame([(1, s, i) for i, s in enumerate(arrived)], "source_id int, batch_seq long, arrival long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(x.expected, x.status) for x in batching.sequence_report(df).orderBy("arrival").collect()]
        files = spark.createDataFrame([(f"f{k}", i) for k in range(3) for i in range(50 * (k + 1))], "file string, pos long")
        keys = [x.order_key for x in batching.interleaved(files.repartition(5)).orderBy("order_key").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, top = [], None
    for i, s in enumerate(arrived):
        prev = arrived[i - 1] if i else None
        want.append((None if prev is None else prev + 1, "first" if prev is None else "next" if s == prev + 1 else "gap" if s > prev + 1 else "restart" if s == 0 and top > 0 else "duplicate" if s == prev else "restart"))
        top = s if top is None else max(top, s)
    assert got == want
    assert sorted(keys) == sorted(3 * i + k for k in range(3) for i in range(50 * (k + 1)))


def test_digests_are_those_of_whole_values(spark):
    """A group's bytes as they pass, over many Arrow batches, against one value."""
    rows = [(a, s, i, b"%d." % i if i % 5 else None) for a, s, n in ((0, 0, 1), (0, 1, 0), (1, 0, 400), (2, 5, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "aggregator_id long, sequence long, i long, b binary").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {(r.aggregator_id, r.sequence): bytes(r.digest) for r in integrity.digested(df, ["aggregator_id", "sequence"], ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, s, _, b in sorted(rows, key=lambda x: x[:3]):
        want[a, s] = want.get((a, s), b"") + (b or b"")
    assert got == {k: hashlib.sha256(v).digest() for k, v in want.items()}
    assert integrity.digested(df.where("false"), ["sequence"], ["i"]).count() == 0


def test_noise_by_key_is_the_same_however_rows_are_dealt(spark):
    sums = spark.range(2000).select(F.col("id").alias("k"), F.lit(10**9).cast("long").alias("sum"))
    a, b = ({r.k: r["sum"] for r in privacy.released(df, "sum", "samples_sum", seed=4, by=["k"]).collect()} for df in (sums.repartition(3), sums.repartition(11)))
    assert a == b and len(set(a.values())) > 100
    other = {r.k: r["sum"] for r in privacy.released(sums, "sum", "samples_sum", seed=5, by=["k"]).collect()}
    assert sum(other[k] == v for k, v in a.items()) < 200
    epsilon, sensitivity, _ = privacy.CALIBRATION["samples_sum"]
    mean = sum(abs(v - 10**9) for v in a.values()) / len(a)
    assert 0.8 < mean / (sensitivity / epsilon) < 1.2  # the mean size of Laplace noise is its scale
    hidden = [privacy.released(sums, "sum", "samples_sum", by=["k"]).agg(F.sum("sum")).first()[0] for _ in range(2)]
    assert hidden[0] != hidden[1]


def test_ordered_replay_is_that_of_a_plain_loop(spark, sf):
    """Slots after each epoch's events in order, over many Arrow batches; an epoch of most events among them."""
    e = tele_events(spark, sf).withColumn("sequence", F.when(F.col("sequence") < 20, 0).otherwise(F.col("sequence")).cast("long")).withColumn("idx", F.col("event_id"))
    hashed = e.select("*", hashing.sketch_cells(F.col("key"), keys.SKETCH_SEEDS, keys.SKETCH_COLUMNS).alias("cells"))
    want = {}
    for row in hashed.orderBy("aggregator_id", "sequence", "idx").collect():
        table, slots = want.setdefault((row.aggregator_id, row.sequence), ({}, []))
        cells = [(i, c["col"]) for i, c in enumerate(row.cells)]
        for c in cells:
            table[c] = table.get(c, 0) + row.value
        est, key = min(table[c] for c in cells), bytes(row.key)
        held = [s[0] for s in slots]
        if key in held:
            slots[held.index(key)][1] = max(slots[held.index(key)][1], est)
        elif len(slots) < 5:
            slots.append([key, est])
        else:
            least = min(range(5), key=lambda i: slots[i][1])
            if est > slots[least][1]:
                slots[least] = [key, est]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {}
        for r in summaries.replayed_slots(e, 5).orderBy("slot").collect():
            got.setdefault((r.aggregator_id, r.sequence), []).append([bytes(r.key), r.est])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: v[1] for k, v in want.items()} and len(got) > 8
