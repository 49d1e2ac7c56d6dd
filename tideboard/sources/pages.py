"""Pages in: text, links, titles, labels and page numbers. All native column work, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import html as H
from tideboard.functions import posting as X
from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.rules import pages as R
from tideboard.rules import selectors as S
from tideboard.schema import PAGE_SCHEMA


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots (page_id, url, html). The schema is given, so no file is opened to infer it."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def pages_to_text(pages: DataFrame) -> DataFrame:
    """Visible text of each page without navigation, header, footer, scripts and styles."""
    return pages.withColumn("text", H.visible_text(F.col("html"))).drop("html")


def pages_to_links(pages: DataFrame, drop_chrome: bool = False) -> DataFrame:
    """One row per link: page_id, pos, href, abs_url, anchor."""
    source = H.drop_elements(F.col("html"), H.CHROME_TAGS) if drop_chrome else F.col("html")
    return T.explode_once(pages, ["page_id", "url"], H.links(source), "pos", "a").select(
        "page_id",
        "pos",
        F.col("a.href").alias("href"),
        U.resolve(F.col("url"), F.trim(F.col("a.href"))).alias("abs_url"),
        F.col("a.anchor").alias("anchor"),
    )


def with_job_link(pages: DataFrame, out: str = "job_link") -> DataFrame:
    """First link of a page that leads to a posting, else its first link. Chosen inside the row."""
    urls = F.transform(H.links(F.col("html")), lambda a: U.resolve(F.col("url"), F.trim(a["href"])))
    jobs = F.filter(urls, U.is_job_link)
    return pages.withColumn(out, F.coalesce(F.get(jobs, 0), F.get(urls, 0)))


def pages_to_title(pages: DataFrame, out: str = "title") -> DataFrame:
    return pages.withColumn(out, X.page_title(F.col("html")))


def _start(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.left(c, F.lit(chars))


def classify_pages(pages: DataFrame, landing_chars: int | None = None, search_chars: int | None = None) -> DataFrame:
    """Labels of each page: page_type, pagination_type and the flags is_landing, is_empty, is_end, is_blocked,
    has_job_terms. Whole pages are read; the two limits make the landing marks count in the first visible characters
    only, and a page a search page if "job" is missing in the first characters of its source."""
    html = F.col("html")
    source = F.lower(html)
    visible = F.lower(H.visible_text(html, H.HIDDEN_TAGS))
    challenge = T.contains_any(html, R.CHALLENGE_MARKS) | (
        F.contains(html, F.lit(R.CHALLENGE_PAIR[0])) & F.contains(html, F.lit(R.CHALLENGE_PAIR[1]))
    )
    starts_without_job = ~F.contains(_start(source, search_chars), F.lit("job"))
    return pages.select(
        "page_id",
        F.when(T.contains_any(source, R.MODAL_MARKS), "modal_first")
        .when(T.contains_any(source, R.SEARCH_MARKS) & starts_without_job, "search_first")
        .when(T.contains_any(source, R.FILTER_MARKS), "filter_required")
        .otherwise("direct_listing")
        .alias("page_type"),
        F.when(T.contains_any(source, R.NUMBERED_MARKS), "numbered")
        .when(T.contains_any(source, R.LOAD_MORE_MARKS), "load_more")
        .when(T.contains_any(source, R.SCROLL_MARKS), "infinite_scroll")
        .otherwise("none")
        .alias("pagination_type"),
        T.contains_any(_start(visible, landing_chars), R.LANDING_MARKS).alias("is_landing"),
        T.contains_any(source, R.EMPTY_MARKS).alias("is_empty"),
        T.contains_any(visible, R.END_MARKS).alias("is_end"),
        (challenge & ~T.contains_any(html, R.RESULT_MARKS)).alias("is_blocked"),
        T.contains_any(visible, R.JOB_WORDS).alias("has_job_terms"),
    )


def pagination_info(pages: DataFrame) -> DataFrame:
    """Page numbers offered by the first pagination element of each page, in the order of the container rules. Pages
    without the mark of a container are not scanned."""

    def read(e: Column) -> Column:
        """Label, page number and opening tag of one control; all quotes of the tag as double ones."""
        return F.struct(
            F.lower(e["text"]).alias("label"),
            F.regexp_extract(e["text"], r"^(\d{1,9})$", 1).try_cast("int").alias("number"),
            F.regexp_replace(F.lower(e["opening"]), r"=\s*(?:'([^']*)'|([^\s\"'>]+))", '="$1$2"').alias("opening"),
        )

    def is_current(e: Column) -> Column:
        return T.matches(e["opening"], r'class="[^"]*(?:active|current|selected|bold)|aria-current="page"')

    def is_next(e: Column) -> Column:
        named = T.matches(e["label"], "next|>") | T.matches(e["opening"], r'(?:aria-label|title)="[^"]*next')
        return named & ~T.matches(e["opening"], r'class="[^"]*disabled|aria-disabled="true"')

    def is_prev(e: Column) -> Column:
        return T.matches(e["label"], "prev|<") | T.matches(e["opening"], r'aria-label="[^"]*prev')

    def summary(controls: Column) -> Column:
        numbered = F.filter(controls, lambda e: e["number"] >= 1)
        numbers = F.array_sort(F.array_distinct(F.transform(numbered, lambda e: e["number"])))
        current = F.element_at(F.concat(F.array(F.lit(1)), F.transform(F.filter(numbered, is_current), lambda e: e["number"])), -1)
        return F.struct(
            numbers.alias("page_numbers"),
            current.alias("current_page"),
            F.exists(controls, is_next).alias("has_next"),
            F.exists(controls, is_prev).alias("has_prev"),
        )

    marked = F.when(T.matches(F.col("html"), r"(?i)paginat|paging|page-navigation|navigation"), F.col("html"))
    controls = E.parts(marked, {"controls": E.in_one(S.PAGINATION, S.CONTROL_TAGS, S.PAGINATION_WORDS)})["controls"]
    info = F.col("info")
    return pages.select("page_id", T.once(F.transform(controls, read), summary).alias("info")).select(
        "page_id",
        F.when(F.size(info["page_numbers"]) > 0, "numbered")
        .when(info["has_next"], "next_only")
        .otherwise("none")
        .alias("pagination_type"),
        info["current_page"].alias("current_page"),
        F.array_max(info["page_numbers"]).alias("total_pages"),
        info["page_numbers"].alias("page_numbers"),
        info["has_next"].alias("has_next"),
        info["has_prev"].alias("has_prev"),
    )


def page_plan(info: DataFrame, max_page: int | None = None, page_size: int = R.PAGE_SIZE) -> DataFrame:
    """One row per further page to read, up to ``max_page`` where one is given: page_id, page_no and the row offset of
    that page."""
    # Where nothing is left to read the array is NULL and gives no row: a filter would be pushed
    # below the expressions that find the page numbers and make them run twice.
    first = F.col("current_page") + 1
    last = F.when(F.col("total_pages").isNotNull(), F.least(F.col("total_pages"), F.lit(max_page).cast("int")))
    further = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return T.explode_once(info, ["page_id"], further, "_i", "page_no").select(
        "page_id", "page_no", ((F.col("page_no") - 1) * page_size).alias("row_offset")
    )
