"""Shapes of the physical plans, on tables without the local dealing-out of rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideboard import catalog
from tideboard import fixtures as fx
from tideboard.operators import filters as fl
from tideboard.operators import joins as jn
from tideboard.operators import limits as lm
from tideboard.operators import windows as wn
from tideboard.plans import searches as pn
from tideboard.sources import details as sd
from tideboard.sources import pages as sp
from tideboard.sources import payloads as pl

# Cards, elements of pages and detail pages are read by the tag scan.
WITH_PYTHON = (
    "h3_", "h5_", "h7_", "h8_", "x2_", "x4_location_of_card", "x8_salary_of_card", "x11_posted_of_card", "x13_description_of_card",
    "x15_requirement_items", "x17_benefit_items", "x18_industry_of_page", "x19_company_size_of_page", "j4_details", "j4_from_pages", "e1_with_details",
)
# These run when they are called: they write a table or a stream and return what was written.
EAGER = ("t1_", "t2_", "t3_", "t4_", "s6_", "s7_", "e1_board_search_from_pages")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not n.startswith(EAGER)])
def test_python_runs_only_where_it_must(spark, name):
    text = plan(catalog.queries()[name](spark, SMALL))
    assert any(p in text for p in ("MapInArrow", "InPandas", "ArrowEvalPython")) == name.startswith(WITH_PYTHON)
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.fixture(scope="module")
def postings(spark):
    return fx.postings(spark, SMALL)


def test_first_wins_is_limited_before_the_shuffle(postings):
    text = plan(wn.dedup_first(postings, ["title"], ["posting_id"]))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_limit_is_a_top_n(postings):
    assert "TakeOrderedAndProject" in plan(lm.limit_results(postings, 20, ["posting_id"]))


def test_rule_dimensions_are_broadcast_and_nothing_is_shuffled(postings):
    text = plan(jn.join_location_alias(postings))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_boards_need_no_join(postings):
    text = plan(jn.join_boards(postings))
    assert "Join" not in text and "Exchange" not in text


def test_columns_are_pruned(spark):
    pages = sp.read_pages(spark, f"{SMALL}/pages.parquet")
    text = plan(fl.classify_url(pages).select("page_id", "is_job_url"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_plain_tests_reach_the_scan(spark):
    pages = sp.read_pages(spark, f"{SMALL}/pages.parquet")
    assert "StringContains(html,hydrateJobCardsResponse)" in plan(pl.explode_embedded_json(pages))


def test_page_operators_do_not_shuffle(spark):
    pages = sp.read_pages(spark, f"{SMALL}/pages.parquet")
    for operator in (sp.pages_to_text, sp.pages_to_links, sp.pages_to_title, sp.classify_pages, sp.pagination_info):
        assert "Exchange" not in plan(operator(pages))


def test_links_are_found_once_per_page(spark):
    """The optimizer must not repeat the pattern search in a filter on the array's size."""
    text = plan(sp.pages_to_links(sp.read_pages(spark, f"{SMALL}/pages.parquet")))
    assert text.count("regexp_extract_all") == 1


def test_hot_keys_are_counted_before_they_are_shuffled(postings):
    text = plan(wn.page_flags(postings.withColumn("posting_key", F.col("title")), ["posting_id"]))
    assert "HashAggregate(keys=[query_id" in text and "partial_count" in text


def test_texts_are_not_gathered_for_a_lexicon(spark):
    texts = spark.range(50).selectExpr("id", "repeat('python and docker ', 50) AS text")
    for few in (True, False):
        jn.SMALL_LEXICON, before = (jn.SMALL_LEXICON if few else 0), jn.SMALL_LEXICON
        try:
            found = jn.match_lexicon(texts, "id", "text", jn.skills_dim(spark))
        finally:
            jn.SMALL_LEXICON = before
        assert "BuildLeft" not in plan(found) and plan(found).count("BroadcastHashJoin") == (2 if few else 0)
        assert [r.terms for r in found.collect()] == [["Docker", "Python"]] * 50


def test_detail_pages_are_read_once_for_all_and_again_for_results(spark):
    raw = fx.postings(spark, SMALL).withColumn("pos", F.col("posting_id"))
    pages = fx.detail_pages(spark, SMALL)
    text = plan(pn.board_search(raw, fx.BOARD, 200, lambda rows: sd.pages_to_details(sd.pages_of(pages, rows)), salary_min=40000))
    assert text.count("ArrowEvalPython") == 1
    assert "LeftSemi" in text.split("ArrowEvalPython")[1]


def test_small_tables_are_dealt_out_on_a_cluster_too(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    cores = spark.sparkContext.defaultParallelism
    assert fx.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores


def test_cards_of_result_pages_are_scanned_once(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(pn, "cut_lineage", lambda df, name, write=pn.cut_lineage: (plans.update({name: plan(df)}), write(df, name))[1])
    html = '<div data-jk="1"><h2 class="jobTitle"><a href="/jobs/1">Data Engineer</a></h2><span class="companyName">Acme</span></div>'
    pages = spark.createDataFrame([(1, "https://www.board-a.example.com/search?q=data&page=1", html)], "page_id long, url string, html string")
    found = pn.board_search_pages(pages, fx.BOARD, fx.BOARD_URL).collect()
    assert [(r["title"], r["company"]) for r in found] == [("Data Engineer", "Acme")]
    assert "MapInArrow" in plans["raw-cards"] and "ArrowEvalPython" not in plans["raw-cards"]
