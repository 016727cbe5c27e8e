"""Every registered query against DuckDB over the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallybook.operators import ownership, summaries
from tallybook.operators import window_queries as wq
from tallybook.plans import registry
from tallybook.plans import telemetry as tele
from tallybook.sources import tables
from tallybook.sources.shared import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__int__") else str(int(v)) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sessions_and_their_sql_agree_at_just_the_gap(spark, tmp_path):
    """events 7,199, 7,200 and 7,201 seconds after the one before."""
    c = duckdb.connect()
    at = [0, 7199, 14399, 21600]
    rows_ = ", ".join(f"({i}, timestamp '2024-01-01' + interval ({t}) second, 1, 'view', 1.0, '')" for i, t in enumerate(at))
    c.execute(f"create table events as select event_id::bigint event_id, ts, user_id::bigint user_id, event_type, value::double as value, props from (values {rows_}) t(event_id, ts, user_id, event_type, value, props)")
    c.execute(f"copy events to '{tmp_path}/events.parquet'")
    got, want = registry.QUERIES["event_sessions"](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLES["event_sessions"]).fetch_df()
    assert rows(got) == rows(want) and sorted(got["count"]) == [1, 3]


def test_registered_raw_requests_have_no_bound(spark, sf, duck, monkeypatch):
    """F5 to F8: they answer over all events, however many."""
    monkeypatch.setattr(wq, "guarded", lambda *_: pytest.fail("a bound"))
    for name in ("histogram_bucket", "cm_estimate", "max", "stats"):
        name = f"facade_samples_raw_{name}_key"
        assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(registry.ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).collect() == registry.QUERIES["samples_sum"](spark, "/root/testdata/sf0.001").collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_request_builds_only_what_it_reads(spark, sf, tmp_path):
    """F12 to F14: and no table that grows with the events passes through the driver."""
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    held = lambda: set(tele.stored(spark, str(tmp_path), types=()).version()["tables"]) - {"epoch_done", "epoch_header"}
    for name, more in (("cm_total", {"cm_cells"}), ("samples_avg", {"samples_entries"}), ("raw_cm_estimate_key", {"raw_events"}), ("cm_topk", {"cm_slots"})):
        before = held() if name != "cm_total" else set()
        assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(registry.QUERIES[name](spark, sf).toPandas())
        assert held() == before | more
    for kind in ("histogram_all", "cm_topk", "cm_estimate", "samples_raw_max_key"):
        found = tele.stored_tables(tele.stored(spark, sf, types=tele.types_of(kind)), tele.types_of(kind))
        assert found["epoch_header"].count() == 120


def test_cells_of_epochs_are_never_broadcast(spark, sf):
    """F12 to F14: however small they look to the planner."""
    e = tele.tele_events(spark, sf)
    found = summaries.estimates(written(summaries.sketch_cells_table(e), "cells"), e)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stored_headers_are_those_of_numbered_events(spark, sf):
    """F16: made from counts, without numbering an event."""
    e = tele.tele_events(spark, sf)
    got, want = tele.epoch_headers(e), summaries.headers(tele.batched(e))
    assert sorted(got.columns) == sorted(want.columns) and rows(got.toPandas()) == rows(want.toPandas())
    assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()


def test_epochs_of_a_commit_are_few_tasks(spark, tmp_path, monkeypatch):
    """F16: each table of a commit is joined with them, however many shuffle partitions there are."""
    monkeypatch.setattr(tables, "KEY_TASKS", 2)
    frame, seen = type(spark.range(0)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *a: seen.append(df) or persist(df, *a))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        head = spark.range(40).selectExpr("0L aggregator_id", "id sequence")
        tables.EpochStore(spark, str(tmp_path)).commit("samples_epoch", {"samples_entries": head.withColumn("sum", head.sequence), "epoch_header": head})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [df.rdd.getNumPartitions() for df in seen if df.columns == ["epoch_type", "aggregator_id", "sequence"]] == [2]
    assert tables.EpochStore(spark, str(tmp_path)).read("samples_entries", "samples_epoch").count() == 40


def test_owned_batches_are_counted_and_never_sorted(spark, sf):
    """an epoch's events of a source are one row before the join, and what is joined passes by a hash table."""
    found = registry.QUERIES["owned_batches"](spark, sf)
    lines = [x.strip(" :+-") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    first = next(x for x in lines if x.startswith(("Join", "Aggregate")))
    assert first.startswith("Join LeftSemi")
    batches = tele.tele_events(spark, sf).selectExpr("source_id", "sequence epoch", "event_id")
    plan = ownership.owned_batches(batches, tele.ownership(spark, sf), 1, 99)._jdf.queryExecution().sparkPlan().toString()
    assert next(x for x in plan.splitlines() if "LeftSemi" in x).strip(" :+-").startswith("ShuffledHashJoin")
