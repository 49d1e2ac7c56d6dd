"""Postings and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_postings(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", by: str = "source") -> None:
    """Append postings, one folder per source. Rows of one source are not forced into one file:
    every task writes its own part, and AQE evens out the tasks, so a large source stays parallel."""
    df.hint("rebalance").write.mode(mode).partitionBy(by).format(fmt).save(path)


def write_run_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run report as JSON lines."""
    report.write.mode(mode).json(path)
