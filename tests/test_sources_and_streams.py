"""File sources, messages, the epoch store, and streams, on small files."""

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallybook.operators import integrity
from tallybook.plans.telemetry import claimed_batches, tele_events
from tallybook.sources import captures, files, messages, tables
from tallybook.streaming import epochs


def test_machine_files(spark, tmp_path):
    (tmp_path / "avg_cpu_machine_id_7.txt").write_text("10\t5\n\nbad\n12\tx\n11\t6\n")
    (tmp_path / "avg_mem_machine_id_9.txt").write_text("10\t1\n")
    (tmp_path / "other.txt").write_text("1\t1\n")
    rows = files.machine_tsv(spark, str(tmp_path)).orderBy("file", "start_time").collect()
    assert [(r.start_time, r.value, bytes(r.key)[0], bytes(r.key)[-1]) for r in rows] == [(10, 5, 1, 7), (11, 6, 1, 7), (10, 1, 2, 9)]
    assert [r.ts for r in files.read_events(spark, "tsv", str(tmp_path), 2).collect()] == [10, 10]
    assert len(files.chosen_files(spark, str(tmp_path), "avg*", 1)) == 1


def test_machine_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"avg cpu","machine_id","end_time"\n"0.5","3","100"\n"-1","3","101"\n"nan","3","102"\n"0.25","4","103"\n')
    (tmp_path / "b.csv").write_text('"avg mem","machine_id","end_time"\n')
    rows = files.machine_csv(spark, str(tmp_path)).orderBy("start_time").collect()
    assert [(r.start_time, r.value, bytes(r.key)[0], bytes(r.key)[-1]) for r in rows] == [(100, 500_000, 1, 3), (103, 250_000, 1, 3)]


def test_flows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 60\n\n3 4 70\n5 6 80\n")
    (tmp_path / "b.txt").write_text("7 8 90\n")
    rows = files.flow_text(spark, str(tmp_path)).orderBy("order_key").collect()
    assert [r.value for r in rows] == [60, 90, 70, 80]
    (tmp_path / "c.txt").write_text("1 2 3 4\n")
    assert files.flow_text(spark, str(tmp_path), on_error="quarantine").where("problem is not null").count() == 1
    with pytest.raises(Exception, match="not three numbers"):
        files.flow_text(spark, str(tmp_path)).collect()


def test_vehicles(spark, tmp_path):
    head = "Model year,Make,Model,Vehicle class,Engine size (L),Cylinders,Transmission,Fuel type,a,b,c,d,CO2 (g/km),x,y\n"
    (tmp_path / "e.csv").write_text(head + "2022,Acura,ILX,Compact,2.4,4,AM8,Z,1,2,3,4,200,1,1\n2021,A,B,C,30,4,T,X,1,2,3,4,100,1,1\n2021,A,B,C,2,4,T,X,1,2,3,4\n2021,A,B,C,2,4,T,X,1,2,3,4,n/a,1,1\n")
    rows = files.read_events(spark, "car_emission", str(tmp_path)).collect()
    assert [(r.value, r.ts) for r in rows] == [(100, 1609459200), (200, 1640995200)] and bytes(rows[0].key)[9] == 255


def ip(src, dst):
    return b"\x45" + b"\0" * 11 + struct.pack(">II", src, dst)


def capture(link, *frames, order="<"):
    head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "IIII", 0, 0, len(f), len(f) + 5) + f for f in frames)


def test_captures(spark, tmp_path):
    ether = b"\0" * 12 + b"\x08\x00" + ip(1, 2)
    vlan = b"\0" * 12 + b"\x81\x00\0\1\x08\x00" + ip(3, 4)
    six = b"\0" * 12 + b"\x86\xdd" + b"\x60" + b"\0" * 39
    (tmp_path / "a.pcap").write_bytes(capture(1, ether, vlan, six))
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(capture(101, ip(5, 6), order=">")))
    (tmp_path / "c.pcap").write_bytes(capture(113, b"\0" * 14 + b"\x08\x00" + ip(7, 8)) + b"\0\0")
    (tmp_path / "d.pcap").write_bytes(b"nothing")
    got = files.captures(spark, str(tmp_path))
    assert sorted((r.src_ip, r.dst_ip) for r in got.where("problem is null").collect()) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert sorted(r.problem for r in files.capture_report(got).where("problem is not null").collect()) == ["not a capture file", "truncated packet header"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_captures_are_split_between_records(spark, tmp_path, order):
    """Stretches of every size give each packet once, though records hold what looks like headers."""
    r = random.Random(5)
    decoy = struct.pack(order + "IIII", 0, 0, 40, 45)
    frames = [ip(i, r.getrandbits(32)) + r.choice([b"", decoy, decoy * 3, r.randbytes(r.randint(0, 200)), bytes(40)]) for i in range(400)]
    (tmp_path / "a.pcap").write_bytes(capture(101, *frames, order=order))
    (tmp_path / "b.pcap").write_bytes(b"nothing at all, but longer than a header is")
    (tmp_path / "c.pcap").write_bytes(capture(101, *frames[:9], order=order) + b"\0\0\0")
    (tmp_path / "d.pcap.gz").write_bytes(gzip.compress(capture(101, *frames[:50], order=order)) + gzip.compress(b""))
    (tmp_path / "e.pcap").write_bytes(b"")
    whole = files.captures(spark, str(tmp_path)).where("problem is null").select("src_ip", "dst_ip", "length")
    assert whole.count() == 459
    for split in (1 << 20, 4000, 333):
        got = captures.split_captures(spark, str(tmp_path), split)
        assert got.rdd.getNumPartitions() >= 30_000 // split
        found = got.where("problem is null").select("src_ip", "dst_ip", "length")
        assert found.exceptAll(whole).count() == 0 and found.count() == 459
        assert sorted((x.file[-6:], x.problem) for x in got.where("problem is not null").collect()) == [("b.pcap", "not a capture file"), ("c.pcap", "truncated packet header"), ("e.pcap", "not a capture file")]


def test_captures_there_and_back(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3).alias("file"), (F.col("id") + 1_700_000_000).alias("second"), F.col("id").alias("src_ip"), (F.col("id") * 7).alias("dst_ip"), (F.col("id") % 90 + 20).alias("length"))
    captures.write_captures(rows, str(tmp_path / "out"))
    got = captures.split_captures(spark, str(tmp_path / "out"), 5000)
    assert got.select("src_ip", "dst_ip", "length").exceptAll(rows.select("src_ip", "dst_ip", "length")).count() == 0 and got.count() == 3000 and got.rdd.getNumPartitions() > 12


def test_files_are_chosen_and_reported(spark, tmp_path):
    (tmp_path / "avg_cpu_machine_id_7.txt").write_text("10\t5\n11\t6\n")
    (tmp_path / "avg_cpu_machine_id_8.txt").write_text("no\tnumbers\n")
    (tmp_path / "avg_mem_machine_id_9.tsv").write_text("10\t1\n")
    (tmp_path / "machine_3.txt").write_text("10\t1\n")
    (tmp_path / "notes.md").write_text("10\t1\n")
    (tmp_path / "other.txt").write_text("1\t1\n")
    report = {r.path.rsplit("/", 1)[-1]: (r.events, r.problem) for r in files.file_report(spark, "tsv", str(tmp_path), max_files=2).collect()}
    assert report == {
        "avg_cpu_machine_id_7.txt": (2, None), "avg_cpu_machine_id_8.txt": (0, "no good line"), "avg_mem_machine_id_9.tsv": (0, "beyond the first 2 files"),
        "machine_3.txt": (0, "no metric in the name"), "notes.md": (0, "another suffix"), "other.txt": (0, "no machine in the name"),
    }
    assert files.read_events(spark, "tsv", str(tmp_path), glob="*.tsv").count() == 1 and files.read_events(spark, "tsv", str(tmp_path), max_files=1).count() == 2
    with pytest.raises(ValueError, match="no files"):
        files.read_events(spark, "tsv", str(tmp_path), glob="*.md")
    with pytest.raises(ValueError, match="unknown kind"):
        files.read_events(spark, "other", str(tmp_path))


def batch_rows(spark, sf):
    e = tele_events(spark, sf)
    from tallybook.plans.telemetry import batched

    claimed = claimed_batches(e).select("source_id", "batch_seq", "batch_hash")
    grouped = batched(e).groupBy("source_id", "batch_seq").agg(F.max("ingest_time_ms").alias("ingest_time_ms"), F.array_sort(F.collect_list(F.struct("pos", "key", "value", "ts"))).alias("e"))
    return grouped.join(claimed, ["source_id", "batch_seq"]).withColumn("events", F.transform("e", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), x["ts"].alias("ts")))).drop("e")


def test_messages_there_and_back(spark, sf, tmp_path):
    batches = batch_rows(spark, sf)
    out = messages.messages(batches, 4)
    assert out.where("key != concat('src', get_json_object(value, '$.source_id'))").count() == 0
    back = messages.parsed(out)
    assert messages.exploded(back).select("key", "value", "ts").exceptAll(messages.exploded(batches).select("key", "value", "ts")).count() == 0
    odd = spark.createDataFrame([(json.dumps({"ingest_time_ms": 5, "events": [{"key_id": [0] * 15, "value": 1, "ts": 2}], "batch_hash": [255] * 32}),), (json.dumps({"ingest_time_ms": 5, "events": []}),), ("{broken",)], "value string")
    rows = messages.parsed(odd, fail=False).collect()
    assert [(r.source_id, r.batch_seq, bytes(r.batch_hash)) for r in rows] == [(0, 0, b"\xff" * 32)]
    with pytest.raises(Exception, match="not a batch"):
        messages.parsed(odd).collect()


def test_stream_gives_the_batch_result(spark, sf, tmp_path):
    batches = batch_rows(spark, sf).persist()
    topic, store = str(tmp_path / "topic"), tables.EpochStore(spark, str(tmp_path / "store"))

    def drain():
        assigned = epochs.epochs(messages.parsed(messages.stream(spark, path=topic)), 4, threshold=5)
        epochs.run(assigned, store, str(tmp_path / "checkpoint")).awaitTermination(300)

    early = batches.where("batch_seq < 3 or batch_seq = 5")
    messages.send(early, 4, path=topic)
    drain()
    first = store.read("raw_events").count()
    assert first == messages.exploded(batches.where("batch_seq < 3")).count()  # batch 5 waits for 3 and 4
    messages.send(batches.where("batch_seq >= 2"), 4, path=topic)  # 2 and 5 come twice
    drain()
    e = tele_events(spark, sf)
    got = store.read("samples_entries").groupBy("key").agg(F.sum("sum").alias("s"), F.sum("count").alias("c"))
    want = e.groupBy("key").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert store.all_rows("raw_epochs_bad").count() == 0
    tips = store.all_rows("source_tips").groupBy("source_id").agg(F.max("last_seq").alias("n"))
    assert {r.source_id: r.n for r in tips.collect()} == {r.source_id: r.n for r in batches.groupBy("source_id").agg(F.max("batch_seq").alias("n")).collect()}
    assert "samples_entries" in store.views() and spark.sql("select count(*) n from raw_events").first().n == e.count()


def test_store_hides_unmarked_epochs(spark, tmp_path):
    store = tables.EpochStore(spark, str(tmp_path))
    head = spark.createDataFrame([(0, 1, 5)], "aggregator_id long, sequence long, n_events long")
    store.commit("samples_epoch", {"epoch_header": head, "samples_entries": head.select("aggregator_id", "sequence")}, 1)
    store.append("samples_entries", spark.createDataFrame([("samples_epoch", 0, 2)], "epoch_type string, aggregator_id long, sequence long"))
    assert store.read("samples_entries").count() == 1 and store.all_rows("samples_entries").count() == 2
    store.commit("samples_epoch", {"epoch_header": head}, 2)
    assert store.all_rows("epoch_header").count() == 1
    points = integrity.checkpoints(spark.createDataFrame([(1, 1, b"\1" * 32)], "source_id int, batch_seq long, batch_hash binary"), 2)
    store.publish_checkpoints(points)
    store.publish_checkpoints(points)
    assert store.all_rows("checkpoints").count() == 1


def test_event_time_windows(spark, sf, tmp_path):
    e = tele_events(spark, sf).select(F.timestamp_seconds("ts").alias("event_time"), "key", "value", "ts")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = epochs.windowed_samples(stream, "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = epochs.windowed_samples(e, "1 day", "1 day")
    assert spark.sql("select * from windowed").exceptAll(want).count() == 0 and spark.sql("select * from windowed").count() == want.count()
    assert epochs.sessions(e, "1 hour", "1 day").agg(F.sum("count")).first()[0] == e.count()
    on_time, late = epochs.split_late(e, 1_705_000_000)
    assert on_time.count() + late.count() == e.count()
