"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder: an input of several steps isn't computed again."""
    return cut_lineage(df, name)


def merged(df: DataFrame) -> DataFrame:
    """For a join with a table that Spark may size too low, as after an explode or from well compressed columns: it is
    sorted and merged, never gathered by the driver."""
    return df.hint("merge")


MAP_BITS = 24


def _place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in a map of 2 ** MAP_BITS bits."""
    place = F.xxhash64(key.cast("string")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def sieved(rows: DataFrame, keys: DataFrame, key: str = "doc_id", among: bool = True) -> DataFrame:
    """The rows whose key may be among the keys: all that are, and few others; or those whose key surely isn't. The map of
    the keys' bits has a fixed size, so it can travel, and the rows needn't move. Null is a key like others."""
    word, bit = _place(F.col(key))
    ones = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_ones"))
    found = rows.join(F.broadcast(ones), word == F.col("_word"), "inner" if among else "left")
    there = F.call_function("shiftright", F.col("_ones"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.filter(there if among else ~F.coalesce(there, F.lit(False))).select(*rows.columns)


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that only the seed and the key decide. MD5, so that any SQL engine gets the same one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most_bytes`` of a text column, or one longer text."""
    for batch in batches:
        lengths = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
