"""Verdicts on titles and whole postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideboard.functions import text as T
from tideboard.rules import titles as R


@T.on_value
def is_job_title(title: Column) -> Column:
    """Whether a text looks like the title of one posting."""
    raw = F.coalesce(title, F.lit(""))
    t = T.strip_space(F.lower(raw))
    words = T.word_count(raw)
    digits = F.length(F.regexp_replace(raw, r"[^0-9]", ""))
    openings = "|".join(R.UI_OPENINGS)
    starts_upper = T.matches(raw, r"^\p{Lu}")
    long_navigation = (
        (words >= 3) & ~T.contains_any(t, R.ROLE_TERMS) & T.contains_any(t, R.LONG_TITLE_NAV)
    )
    return (
        F.when(~F.length(raw).between(5, 200), False)
        .when(T.matches(t, R.JOB_COUNT), False)
        .when(T.matches(t, T.whole_word(R.NAV_KEYWORDS)), False)
        .when(T.matches(t, rf"^(?:{openings})"), False)
        .when(~T.matches(raw, r"[a-zA-Z]"), False)
        .when(digits * 2 > F.length(raw), False)
        .when((words == 1) & T.is_one_of(t, R.SINGLE_WORD_NAV), False)
        .when((words <= 2) & starts_upper & T.is_one_of(t, R.PLACE_TITLES), False)
        .when(T.is_one_of(t, R.DEPARTMENT_TITLES), False)
        .when(long_navigation, False)
        .otherwise(True)
    )


def reject_reason(title: Column, url: Column) -> Column:
    """Why a posting is rejected; NULL when it is kept."""
    stripped = T.strip_space(F.coalesce(title, F.lit("")))
    t = F.lower(stripped)
    has_url = F.coalesce(url, F.lit("")) != ""
    count = T.matches(t, r"^\d+\s*jobs?$|\(?\d+\s*jobs?\)?$")
    return (
        F.when(~F.length(stripped).between(3, 200), "title length")
        .when(count, "job count")
        .when(has_url & T.is_one_of(t, R.REJECTED_WITH_URL), "navigation title")
        .when(~has_url & T.is_one_of(t, R.REJECTED_WITHOUT_URL), "navigation title")
        .when(~has_url & (T.word_count(t) < 2), "single word without url")
    )


def strict_reason(title: Column, description: Column) -> Column:
    """Further reasons of the strict rules; NULL when none applies."""
    same = (F.coalesce(description, F.lit("")) != "") & (
        F.lower(T.clean_text(description)) == F.lower(T.clean_text(title))
    )
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, description)]
    both = F.struct(lowered[0].alias("t"), lowered[1].alias("d"))
    return F.coalesce(
        F.when(same, "description repeats title"), T.once(both, lambda b: _strict_reason(b["t"], b["d"]))
    )


def _strict_reason(t: Column, d: Column) -> Column:
    """The strict rules on lower-cased title and description."""
    product = F.contains(d, F.lit("view all")) & (T.word_count(d) < R.PRODUCT_TEXT_MAX_WORDS)
    marketing = T.contains_any(d, R.MARKETING_TEXT) & ~T.contains_any(d, R.JOB_DETAIL_TEXT)
    retail = F.length(d) - F.length(F.replace(d, F.lit("retail"), F.lit("")))
    section = (t == "career opportunities") & (
        (F.contains(d, F.lit("retail sales associate")) & (retail > len("retail")))
        | F.contains(d, F.lit("view all"))
    )
    return (
        F.when(T.contains_any(d, R.CATEGORY_COUNT_TEXT) & T.contains_any(d, R.CATEGORY_TEXT), "category text")
        .when(product, "product text")
        .when(T.contains_any(d, R.CONTENT_TEXT), "content text")
        .when(T.contains_any(d, R.SERVICE_TEXT), "service text")
        .when(marketing, "marketing text")
        .when(T.matches(t, r"\s\(\d+\s*jobs?\)|\s\d+\s*jobs?$|^\d+\s*jobs?$"), "job count")
        .when(T.is_one_of(t, R.COUNTRY_TITLES), "place title")
        .when(T.is_one_of(t, R.PRODUCT_TITLES), "product title")
        .when(T.is_one_of(t, R.MARKETING_TITLES), "marketing title")
        .when(section, "section heading")
        .when(
            ~T.contains_any(t, R.JOB_TITLE_WORDS) & T.contains_any(t, R.PRODUCT_TITLE_WORDS), "product words"
        )
    )
