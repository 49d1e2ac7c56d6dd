"""Run and quality reports. Every aggregate is partial before the shuffle; arrays in results hold
a fixed number of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideboard.functions import text as T
from tideboard.operators.windows import failure_streak, first_n


def _some(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(values), lambda s: s["v"]), "|")


def run_summary(df: DataFrame, by: Sequence[str], kept: Column, order: Sequence[str], samples: int = 5) -> DataFrame:
    """Postings found and kept per search, and the first rejected locations in arrival order."""
    flagged = df.withColumn("_kept", kept)
    counts = flagged.groupBy(*by).agg(F.count("*").alias("found"), F.count_if("_kept").alias("kept"))
    shown = (
        first_n(flagged.filter(~F.col("_kept")).select(*by, *order, "location"), by, list(order), samples, rank="_rank")
        .groupBy(*by)
        .agg(
            F.collect_list(F.struct("_rank", F.coalesce("location", F.lit("none")).alias("v"))).alias("_samples")
        )
        .select(*by, _some(F.col("_samples")).alias("rejected_locations"))
    )
    return counts.join(shown, list(by), "left")


def url_report(runs: DataFrame) -> DataFrame:
    """One row over all runs (url, success, count, elapsed_seconds): totals, rates, mean time,
    fastest and slowest successful run."""
    seconds = F.col("elapsed_seconds").cast("decimal(18,4)")
    ok_run = F.when(F.col("success"), F.struct(seconds.alias("s"), "url"))
    report = runs.agg(
        F.count("*").alias("total_urls"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.when(F.col("success"), F.col("count")).otherwise(0)).alias("total_jobs_found"),
        F.sum(seconds).alias("_seconds"),
        F.min(ok_run).alias("_fastest"),
        F.max(ok_run).alias("_slowest"),
    )
    return report.select(
        "total_urls",
        "successful",
        "failed",
        F.round(F.col("successful") / F.nullif(F.col("total_urls"), F.lit(0)), 6).alias("success_rate"),
        "total_jobs_found",
        F.round(F.col("_seconds").cast("double") / F.nullif(F.col("total_urls"), F.lit(0)), 1).alias("average_time_seconds"),
        F.col("_fastest.url").alias("fastest_url"),
        F.col("_slowest.url").alias("slowest_url"),
    )


def crawl_metadata(df: DataFrame, site: str = "url") -> DataFrame:
    """Per site: postings, pages, success rate, counts of errors and warnings, time. Input has one
    row per page read: postings bigint, ok boolean, error string, warning string, seconds double."""
    return (
        df.groupBy(site)
        .agg(
            F.sum("postings").alias("total_jobs"),
            F.count("*").alias("pages_scraped"),
            F.count_if("ok").alias("_ok"),
            F.count("error").alias("n_errors"),
            F.count("warning").alias("n_warnings"),
            F.sum(F.col("seconds").cast("decimal(18,4)")).alias("_seconds"),
        )
        .select(
            site,
            "total_jobs",
            "pages_scraped",
            F.round(F.col("_ok") / F.col("pages_scraped"), 6).alias("success_rate"),
            "n_errors",
            "n_warnings",
            F.round(F.col("_seconds").cast("double"), 2).alias("time_taken"),
        )
    )


def crawl_messages(df: DataFrame, site: str = "url") -> DataFrame:
    """Errors and warnings per site as rows (site, level, message, n): the lists of the site
    record, whole, without putting a site's messages into one row."""
    levels = F.array(
        F.struct(F.lit("error").alias("level"), F.col("error").alias("message")),
        F.struct(F.lit("warning").alias("level"), F.col("warning").alias("message")),
    )
    return (
        df.select(site, F.explode(levels).alias("m"))
        .select(site, "m.level", "m.message")
        .filter(F.col("message").isNotNull())
        .groupBy(site, "level", "message")
        .agg(F.count("*").alias("n"))
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, array elements included, with their number of rows."""
    is_array = dict(df.dtypes)[col].startswith("array")
    values = T.explode_once(df, [], F.array_distinct(col), "_i", col) if is_array else df.select(col)
    return values.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def field_completeness(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Share of non-empty values of each field, all fields in one pass."""
    types = dict(df.dtypes)
    fields = list(fields or df.columns)

    def filled(c: str) -> Column:
        if types[c].startswith("array"):
            return F.coalesce(F.size(c), F.lit(0)) > 0
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(filled(c)).alias(c) for c in fields])
    return counts.unpivot(["_rows"], fields, "field", "n_filled").select(
        "field", "n_filled", F.round(F.col("n_filled") / F.nullif(F.col("_rows"), F.lit(0)), 6).alias("share")
    )


def cache_hit_rate(lookups: DataFrame) -> DataFrame:
    """Share of requests answered from the cache, over the result of ``ttl_lookup``."""
    return lookups.agg(F.count("*").alias("requests"), F.count_if("is_hit").alias("hits")).select(
        "requests", "hits", F.round(F.col("hits") / F.nullif(F.col("requests"), F.lit(0)), 6).alias("hit_rate")
    )


def source_health(events: DataFrame, source: str, order: Sequence[str], threshold: int = 3, **streak) -> DataFrame:
    """Per source: current failures, whether it is healthy now, its worst streak and its events."""
    at = F.struct(*order)
    rows = failure_streak(events, source, order, threshold=threshold, **streak)
    return (
        rows.groupBy(source)
        .agg(
            F.max(F.struct(at.alias("at"), F.col("streak"))).alias("_last"),
            F.max("streak").alias("worst_streak"),
            F.count("*").alias("n_events"),
        )
        .select(
            source,
            F.col("_last.streak").alias("failures"),
            (F.col("_last.streak") < threshold).alias("healthy"),
            "worst_streak",
            "n_events",
        )
    )


def reject_report(explained: DataFrame) -> DataFrame:
    """Rejected rows per reason and title, over the result of ``explain_postings``."""
    return (
        explained.filter(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason", "title")
        .agg(F.count("*").alias("n"))
    )
