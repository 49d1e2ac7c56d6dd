"""Streams give the same rows as their batch twins, also over several micro-batches and restarts."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideboard import fixtures as fx
from tideboard.operators import joins as jn
from tideboard.operators import windows as wn
from tideboard.schema import EVENT_SCHEMA
from tideboard.streaming import streams as sm


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The events in four files, in time order."""
    folder = tmp_path_factory.mktemp("events")
    events = fx.table(spark, SMALL, "events")
    bounds = [r[0] for r in events.selectExpr("percentile_approx(event_id, array(0.25, 0.5, 0.75))").collect()][0]
    edges = [None, *bounds, None]
    for i in range(4):
        part = events
        if edges[i] is not None:
            part = part.filter(F.col("event_id") > edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col("event_id") <= edges[i + 1])
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, folder):
    return sm.ingest_stream(spark, folder, EVENT_SCHEMA, files_per_batch=1)


def test_ingest_is_exactly_once_over_restarts(spark, event_files, tmp_path):
    for _ in range(2):
        rows = stream(spark, event_files).select("event_id")
        sm.write_available(rows, str(tmp_path / "out"), str(tmp_path / "progress"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == fx.table(spark, SMALL, "events").count()


def test_dedup_keeps_one_row_per_key(spark, event_files):
    events = stream(spark, event_files).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sm.run_to_table(sm.dedup_stream(events, ["user_id", "event_type"], "ts", "60 days"), "dedup")
    batch = wn.dedup_first(fx.table(spark, SMALL, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    keys = lambda df: sorted((r.user_id, r.event_type) for r in df.select("user_id", "event_type").collect())
    assert keys(got) == keys(batch)


@pytest.mark.parametrize("ttl", [3600, 200_000])
def test_cache_state_equals_batch(spark, event_files, ttl):
    got = sm.run_to_table(sm.ttl_state(stream(spark, event_files), "user_id", ttl), "cache")
    events = fx.table(spark, SMALL, "events").select("user_id", "ts", "event_id")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    batch = jn.ttl_lookup(events, "user_id", ttl).select(
        "user_id", "event_id", "is_hit", F.timestamp_diff("MICROSECOND", epoch, F.col("stored_at")).alias("us")
    )
    assert sorted((r.key, r.tie, r.is_hit, r.stored_us) for r in got.collect()) == sorted(tuple(r) for r in batch.collect())


def test_cache_state_with_empty_results_equals_batch(spark, event_files):
    events = stream(spark, event_files).withColumn("none", F.col("event_type") == "signup")
    got = sm.run_to_table(sm.ttl_state(events, "user_id", 200_000, empty="none"), "cache")
    rows = fx.table(spark, SMALL, "events").withColumn("none", F.col("event_type") == "signup")
    batch = jn.ttl_lookup(rows, "user_id", 200_000, empty="none")
    assert sorted((r.tie, r.is_hit) for r in got.collect()) == sorted((r.event_id, r.is_hit) for r in batch.collect())


def test_health_state_equals_batch(spark, event_files):
    events = stream(spark, event_files).withColumn("ok", F.col("event_type") != "error")
    got = sm.run_to_table(sm.health_state(events, "user_id"), "health")
    rows = fx.table(spark, SMALL, "events").withColumn("ok", F.col("event_type") != "error")
    batch = wn.failure_streak(rows, "user_id", ["ts", "event_id"])
    assert sorted((r.tie, r.streak, r.healthy) for r in got.collect()) == sorted((r.event_id, r.streak, r.healthy) for r in batch.collect())
