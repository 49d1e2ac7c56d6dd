"""Unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideboard.operators.limits import limit_results
from tideboard.operators.windows import dedup_first
from tideboard.schema import POSTING_SCHEMA


def union_sources(*parts: DataFrame) -> DataFrame:
    """Rows of many sources by column name; a column that a source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def as_postings(df: DataFrame) -> DataFrame:
    """The columns of the postings table, in its order and types; what the rows lack is NULL."""
    fields = StructType.fromDDL(POSTING_SCHEMA).fields
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*columns)


def union_paths(
    api_rows: DataFrame, html_rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None
) -> DataFrame:
    """API rows before HTML rows, first row of each key, at most ``n`` in that order."""
    both = union_sources(api_rows.withColumn("path_no", F.lit(0)), html_rows.withColumn("path_no", F.lit(1)))
    rows = dedup_first(both, keys, ["path_no", *order])
    return rows if n is None else limit_results(rows, n, ["path_no", *order])
