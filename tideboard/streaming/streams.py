"""Incremental ingest, de-duplication, cache state and source health.

State lives in the state store, keyed by the posting, cache key or source. It is bounded by the
watermark: a timer or the watermark itself removes what can no longer matter."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from tideboard.session import STATE_PROVIDER, fresh_path

# Workers get these classes by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ingest_stream(
    spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000, glob: str = "*"
) -> DataFrame:
    """Files that appear in a folder, as a stream with a fixed schema."""
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .load(folder)
    )


def write_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends everything that is available now, exactly once, and stops."""
    spark = df.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_PROVIDER)
    try:
        query = (
            df.writeStream.format(fmt)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return query


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all available input and returns what it wrote."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write_available(df, path, fresh_path(spark, f"{name}-progress"))
    return spark.read.schema(df.schema).parquet(path)


def dedup_stream(df: DataFrame, keys: Sequence[str], ts: str, ttl: str) -> DataFrame:
    """First arrival of each key; a key is remembered for at least ``ttl`` of event time."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "tie"], kind="stable")


class CacheState(StatefulProcessor):
    """Per key: when the good value was stored. A timer drops it once it has expired."""

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        good = self.stored.get()[0] if self.stored.exists() else None
        entered, hits, stored = good, [], []
        for us, empty in zip(pdf["us"].tolist(), pdf["empty"].tolist()):
            hit = good is not None and us - good <= self.ttl
            if not hit:
                good = None if empty else us
            hits.append(hit)
            stored.append(good if hit else us)
        if good != entered:
            if entered is not None:
                self.handle.deleteTimer(self._expiry(entered))
            if good is None:
                self.stored.clear()
            else:
                self.stored.update((good,))
                self.handle.registerTimer(self._expiry(good))
        yield pd.DataFrame({"key": pdf["key"], "tie": pdf["tie"], "us": pdf["us"], "is_hit": hits, "stored_us": stored})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _expiry(self, us: int) -> int:
        """First millisecond at which the value is too old for every request."""
        return (us + self.ttl) // 1000 + 1


class HealthState(StatefulProcessor):
    """Per source: its consecutive failures."""

    def init(self, handle) -> None:
        self.failures = handle.getValueState("failures", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        n = self.failures.get()[0] if self.failures.exists() else 0
        streaks = []
        for ok in pdf["ok"].tolist():
            n = 0 if ok else n + 1
            streaks.append(n)
        self.failures.update((n,))
        yield pd.DataFrame({"key": pdf["key"], "tie": pdf["tie"], "us": pdf["us"], "streak": streaks})

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, key: str, ts: str, tie: str, **extra) -> DataFrame:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(ts).cast("timestamp_ntz"))
    return df.select(
        F.col(key).alias("key"),
        F.col(tie).cast("bigint").alias("tie"),
        micros.alias("us"),
        F.col(ts).cast("timestamp").alias("ts"),
        *[c.alias(name) for name, c in extra.items()],
    )


def ttl_state(
    df: DataFrame, key: str, ttl_seconds: int, ts: str = "ts", tie: str = "event_id", empty: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Cache outcome of each request of a stream: key, tie, us, is_hit, stored_us."""
    key_type = dict(df.dtypes)[key]
    rows = _keyed(df, key, ts, tie, empty=F.col(empty) if empty else F.lit(False)).withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CacheState(ttl_seconds * 1_000_000),
        outputStructType=f"key {key_type}, tie bigint, us bigint, is_hit boolean, stored_us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def health_state(
    df: DataFrame, source: str, ok: str = "ok", ts: str = "ts", tie: str = "event_id", threshold: int = 3
) -> DataFrame:
    """Consecutive failures of each source after each event of a stream."""
    key_type = dict(df.dtypes)[source]
    rows = _keyed(df, source, ts, tie, ok=F.col(ok))
    streaks = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=HealthState(),
        outputStructType=f"key {key_type}, tie bigint, us bigint, streak bigint",
        outputMode="Append",
        timeMode="None",
    )
    return streaks.withColumn("healthy", F.col("streak") < threshold)
