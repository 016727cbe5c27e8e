"""The epoch store: readers beside a writer, state as of now, merging and retirement."""

import json
import threading
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallybook.sources import tables

HEAD = "aggregator_id long, sequence long, n_events long"


def epoch_rows(spark, *sequences, aggregators=(0, 1)):
    return spark.createDataFrame([(a, s, 10 * s + a) for s in sequences for a in aggregators], HEAD)


def tips(spark, *sequences):
    return spark.createDataFrame([(a, s, 10 * a + k, s, bytes([s % 256, k])) for s in sequences for a in (0, 1) for k in range(3) if k < 2 or s % 2 == 0], "aggregator_id long, sequence long, source_id int, last_seq long, chain_tip binary")


def test_nothing_exists_before_a_marker(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    assert not store.exists("raw_events") and store.sweep() == 0 and store.compact() == 0
    (tmp_path / "raw_events" / "_temporary" / "0").mkdir(parents=True)  # as while a first write is on its way
    assert not store.exists("raw_events")
    with pytest.raises(ValueError, match="nothing is marked"):
        store.read("raw_events")
    store.append("raw_events", epoch_rows(spark, 0).withColumn("epoch_type", F.lit("samples_epoch")).withColumn("attempt", F.lit("a1")))
    assert not store.exists("raw_events") and store.all_rows("raw_events").count() == 2
    assert store.sweep() == 1
    store.commit("samples_epoch", {"epoch_header": epoch_rows(spark, 0), "raw_epochs_bad": epoch_rows(spark, 0).where("false")}, 1)
    assert store.exists("epoch_header") and store.exists("raw_epochs_bad") and store.read("raw_epochs_bad").count() == 0
    assert tables.EpochStore(spark, str(tmp_path)).read("epoch_header").schema == store.read("epoch_header").schema


def test_rows_of_epochs_without_header_are_left_out(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    store.commit("samples_epoch", {"epoch_header": epoch_rows(spark, 0), "raw_events": epoch_rows(spark, 0, 1)}, 1)
    assert store.read("raw_events").count() == 2
    store.commit("samples_epoch", {"epoch_header": epoch_rows(spark, 0, 1), "raw_events": epoch_rows(spark, 0, 1)}, 2)
    assert store.read("raw_events").count() == 4 and store.done().count() == 4 and store.done(1).count() >= 2


def test_readers_beside_a_writer_never_fail(spark, tmp_path):
    """A reader sees whole epochs only, whatever is being written, merged, retired and swept."""
    path, over, errors, seen = str(tmp_path), threading.Event(), [], ([], [])

    def read(seen):
        store = tables.EpochStore(spark, path)
        while not over.is_set():
            try:
                if store.exists("raw_events"):
                    done = store.done().where("epoch_type = 'samples_epoch'").count()
                    rows = store.read("raw_events", "samples_epoch").groupBy("sequence").count().collect()
                    assert all(r["count"] == 2 for r in rows) and store.latest("source_tips").count() >= 4
                    seen.append((done, len(rows)))
            except Exception as e:  # noqa: BLE001
                errors.append(repr(e)[:400])
                return

    readers = [threading.Thread(target=read, args=(seen[i],)) for i in range(2)]
    for r in readers:
        r.start()
    store = tables.EpochStore(spark, path, grace_ms=60_000)
    try:
        for s in range(12):
            store.sweep()
            store.append("raw_events", epoch_rows(spark, s).withColumn("epoch_type", F.lit("samples_epoch")).withColumn("attempt", F.lit(f"failed{s}")))
            store.commit("samples_epoch", {"raw_events": epoch_rows(spark, s), "epoch_header": epoch_rows(spark, s), "source_tips": tips(spark, s)})
            store.compact()
            if s == 10:
                assert store.retire("raw_events", epoch_rows(spark, *range(8))) == 1
    finally:
        over.set()
        for r in readers:
            r.join()
    assert not errors and all(len(s) > 5 and [x[0] for x in s] == sorted(x[0] for x in s) for s in seen)
    assert {r.sequence for r in store.read("raw_events").select("sequence").collect()} == set(range(8, 12))


def test_latest_is_that_of_history_and_folders_stay_few(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path), grace_ms=0)
    for s in range(11):
        store.commit("samples_epoch", {"epoch_header": epoch_rows(spark, s), "source_tips": tips(spark, s)}, s)
        store.compact()
    want = store.read("source_tips").groupBy("source_id").agg(F.max("last_seq").alias("last_seq"), F.max_by("chain_tip", "last_seq").alias("chain_tip"))
    got = store.latest("source_tips").select(want.columns)
    assert got.count() == want.count() == 6 and got.exceptAll(want).count() == 0
    assert store.read("epoch_header").count() == store.done().count() == 22
    version = store.version()
    assert all(len(held["folders"]) == 4 for held in version["tables"].values())  # a merged one and three of late
    assert {f["level"] for f in version["tables"]["source_tips_now"]["folders"]} == {0, 1}
    rows = store._rows("source_tips_now", [f for f in version["tables"]["source_tips_now"]["folders"] if f["level"] == 1], version["tables"]["source_tips_now"]["schema"])
    assert rows.count() == 6  # merging keeps the latest row of a source
    store.sweep()
    for table, held in version["tables"].items():
        there = {f"{table}/{p.name}" for p in (tmp_path / table).iterdir() if p.is_dir()}
        assert there == {f["path"] for f in held["folders"]}
    assert len(list((tmp_path / "_log").glob("v*.json"))) == 1


def planted(store, n):
    """n commits as they are on disk, written without Spark."""
    version = {"n": 0, "tables": {}, "gone": []}
    schema = {"type": "struct", "fields": [{"name": c, "type": t, "nullable": True, "metadata": {}} for c, t in (("sequence", "long"), ("n_events", "long"), ("attempt", "string"), ("epoch_type", "string"), ("aggregator_id", "long"))]}
    marks = {"type": "struct", "fields": [{"name": c, "type": t, "nullable": True, "metadata": {}} for c, t in (("epoch_type", "string"), ("aggregator_id", "long"), ("sequence", "long"), ("attempt", "string"), ("completed_at_ms", "long"))]}
    tip = {"type": "struct", "fields": [{"name": c, "type": t, "nullable": True, "metadata": {}} for c, t in (("aggregator_id", "long"), ("sequence", "long"), ("source_id", "integer"), ("last_seq", "long"), ("chain_tip", "binary"), ("epoch_type", "string"), ("attempt", "string"))]}
    from pathlib import Path

    for table, kind in (("epoch_header", schema), ("epoch_done", marks), ("source_tips", tip), ("source_tips_now", tip)):
        version["tables"][table] = {"schema": json.dumps(kind), "folders": []}
    for s in range(n):
        a = f"a{uuid.uuid4().hex}"
        for table, folder, rows in (
            ("epoch_header", f"attempt={a}/epoch_type=samples_epoch/aggregator_id=0", {"sequence": pa.array([s]), "n_events": pa.array([1])}),
            ("epoch_done", f"c{a}", {"epoch_type": pa.array(["samples_epoch"]), "aggregator_id": pa.array([0]), "sequence": pa.array([s]), "attempt": pa.array([a]), "completed_at_ms": pa.array([s])}),
            ("source_tips", f"attempt={a}/epoch_type=samples_epoch/aggregator_id=0", {"sequence": pa.array([s]), "source_id": pa.array([s % 7], pa.int32()), "last_seq": pa.array([s]), "chain_tip": pa.array([b"t"])}),
            ("source_tips_now", f"attempt={a}", {"aggregator_id": pa.array([0]), "sequence": pa.array([s]), "source_id": pa.array([s % 7], pa.int32()), "last_seq": pa.array([s]), "chain_tip": pa.array([b"t"]), "epoch_type": pa.array(["samples_epoch"])}),
        ):
            at = Path(store.path) / table / folder
            at.mkdir(parents=True)
            pq.write_table(pa.table(rows), at / "part-0.parquet")
            version["tables"][table]["folders"].append({"path": f"{table}/{folder.split('/')[0]}", "level": 0, "bytes": 1000, "unsure": False, "hi": s})
    store._publish(version)


def test_a_commit_takes_as_long_after_many(spark, tmp_path):
    """Reading how things stand, committing and merging: no slower after 400 commits than after 20."""
    def took(n):
        store = tables.EpochStore(spark, str(tmp_path / str(n)), grace_ms=0)
        planted(store, n)
        for _ in range(4):  # what a stream would have merged on its way
            store.compact()
        store.sweep()
        each = []
        for s in range(n, n + 5):
            began = time.perf_counter()
            store.sweep()
            assert store.latest("source_tips").count() == 7
            store.commit("samples_epoch", {"epoch_header": epoch_rows(spark, s, aggregators=(0,)), "source_tips": tips(spark, s).where("source_id = 0")}, s)
            store.compact()
            each.append(time.perf_counter() - began)
        assert store.done().count() == n + 5 and all(len(t["folders"]) < 4 * tables.FAN_IN for t in store.version()["tables"].values())
        return sorted(each)[len(each) // 2]

    few, many = took(20), took(400)
    assert many < 2 * few + 0.3
