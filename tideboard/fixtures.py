"""Tables the registered queries read: the given Parquet files and posting views derived from them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.session import fresh_path, has_shared_folder

_VIEWS = Path(__file__).with_name("views")
POSTINGS_SQL = (_VIEWS / "postings.sql").read_text()
POSTING_PAGES_SQL = (_VIEWS / "posting_pages.sql").read_text()
DETAIL_PAGES_SQL = (_VIEWS / "detail_pages.sql").read_text()

BOARD = "board-a.example.com"
BOARD_URL = "https://www.board-a.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table has few splits, often one, and what is made of a row may be dear: the rows of a table with fewer
    splits than there are cores are dealt out to all of them. Larger tables have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(df_of, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written to the shared folder by the first query that needs it. The queries
    are about stored postings and pages: without a stored table the optimizer would push their
    filters into the derivation and repeat its long expressions."""
    if not has_shared_folder(spark):
        return df_of()
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = fresh_path(spark, name)
        df_of().write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw posting per order."""

    def derive() -> DataFrame:
        spread(table(spark, sf_dir, "orders")).createOrReplaceTempView("orders")
        table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
        return spark.sql(POSTINGS_SQL)

    return staged(derive, spark, sf_dir, "postings")


def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result page per posting: page_id, url, html, payload."""

    def derive() -> DataFrame:
        postings(spark, sf_dir).createOrReplaceTempView("postings")
        return spark.sql(POSTING_PAGES_SQL)

    return staged(derive, spark, sf_dir, "posting-pages")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each posting URL: page_id, url, html."""

    def derive() -> DataFrame:
        postings(spark, sf_dir).createOrReplaceTempView("postings")
        return spark.sql(DETAIL_PAGES_SQL)

    return staged(derive, spark, sf_dir, "detail-pages")


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page run per event: url, success, count, elapsed_seconds and the columns of a site record."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    is_error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://site-"), F.col("user_id").cast("string"), F.lit(".example.com/careers")).alias("url"),
        (~is_error).alias("success"),
        k.alias("count"),
        F.col("value").alias("elapsed_seconds"),
        F.when(is_error, F.lit(0)).otherwise(k).alias("postings"),
        (~is_error).alias("ok"),
        F.when(is_error, F.concat(F.lit("failed with code "), (k % 7).cast("string"))).alias("error"),
        F.when(F.col("event_type") == "view", F.lit("no link on the page")).alias("warning"),
        F.col("value").alias("seconds"),
    )
