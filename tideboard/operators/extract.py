"""Operators that add one field. They are projections: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import posting as X
from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.operators import joins as jn

AS_OF = "2024-02-01 00:00:00"


def instant(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def first_match(df: DataFrame, out: str, candidates: list[Column]) -> DataFrame:
    return df.withColumn(out, T.first_match(*candidates))


def with_company_from_url(df, url="url", out="company"):
    return df.withColumn(out, U.company_from_url(F.col(url)))


def _given(parts: str | None) -> Column | None:
    return None if parts is None else F.col(parts)


def with_company(df, html="html", out="company", base_url="", parts: str | None = None):
    """Company name and company URL of a card. Here and below, a column may be named that has the card's elements."""
    source, given, parts = F.col(html), _given(parts), F.col("_parts")
    return (
        df.withColumn("_parts", X.card_parts(source, ["company"]) if given is None else given)
        .withColumns({out: X.company_of_card(source, parts), f"{out}_url": X.company_url_of_card(source, base_url, parts)})
        .drop("_parts")
    )


def with_clean_text(df, text="text", out="clean_text"):
    return df.withColumn(out, T.clean_text(F.col(text)))


def with_location(df, text="text", out="location", is_card=False, parts: str | None = None):
    c = F.col(text)
    return df.withColumn(out, X.location_of_card(c, _given(parts)) if is_card else X.location_in_text(c))


def with_remote_type(df, source="location", out="remote_type", from_location=True):
    read = X.work_mode_of_location if from_location else X.work_mode_in_text
    return df.withColumn(out, read(F.col(source)))


def with_employment_type(df, text="text", out="employment_type"):
    return df.withColumn(out, X.employment_type(F.col(text)))


def with_job_type(df, text="text", out="job_type"):
    return df.withColumn(out, X.job_type(F.col(text)))


def with_salary_text(df, text="text", out="salary_range", is_card=False, parts: str | None = None):
    c = F.col(text)
    return df.withColumn(out, X.salary_of_card(c, parts=_given(parts)) if is_card else X.salary_text(c))


def with_salary_bounds(df, text="salary_range"):
    bounds = X.salary_bounds(F.col(text))
    return df.withColumns({f: bounds[f] for f in ("salary_min", "salary_max", "salary_period")})


def with_experience_level(df, text="title", out="experience_level"):
    return df.withColumn(out, X.experience_level(F.col(text)))


def with_posted_text(df, text="text", out="posted_date", is_card=False, parts: str | None = None):
    c = F.col(text)
    return df.withColumn(out, X.posted_of_card(c, parts=_given(parts)) if is_card else X.posted_text(c))


def with_posted_at(df, text="posted_date", out="posted_at", as_of: str | Column = AS_OF):
    return df.withColumn(out, X.posted_at(F.col(text), instant(as_of)))


def with_description(df, source="text", out="description", kind="lines", parts: str | None = None):
    """``kind``: "lines" and "detail" read plain text, "card" reads card HTML and "page" the HTML of a detail page."""
    if kind in ("card", "page"):
        return df.withColumn(out, (X.description_of_card if kind == "card" else X.description_of_page)(F.col(source), _given(parts)))
    lines = F.filter(F.transform(F.split(F.col(source), "\n"), T.strip_space), lambda line: line != "")
    read = X.detail_description_line if kind == "detail" else X.description_line
    return df.withColumn(out, read(lines))


def with_formatted_description(df, text="description", out="description"):
    return df.withColumn(out, X.formatted_description(F.col(text)))


def with_requirements(df, source="text", out="requirements", kind="sentences"):
    """``kind``: "sentences" of a text, "section" after a heading, "items" of detail HTML."""
    c = F.col(source)
    read = {
        "sentences": X.requirements,
        "section": lambda t: F.array_compact(F.array(T.blank_to_null(X.requirement_section(t)))),
        "items": lambda h: X.requirement_items(E.texts(X.detail_parts(h, ["requirements"])["requirements"])),
    }[kind]
    return df.withColumn(out, read(c))


def with_skills(df, description="description", text=None, out="skills", limit: int | None = None):
    return df.withColumn(out, X.skills(F.col(description), None if text is None else F.col(text), limit))


def with_benefits(df, source="text", out="benefits", is_detail=False, limit: int | None = None):
    c = F.col(source)
    items = lambda: X.benefit_items(E.texts(X.detail_parts(c, ["benefits"])["benefits"]))
    return df.withColumn(out, items() if is_detail else X.benefits(c, limit))


def with_industry(df, source="text", out="industry", is_detail=False):
    return df.withColumn(out, (X.industry_of_page if is_detail else X.industry)(F.col(source)))


def with_company_size(df, text="text", out="company_size", is_detail=False):
    return df.withColumn(out, (X.company_size_of_page if is_detail else X.company_size)(F.col(text)))


def with_absolute_url(df, base: str, url="url", out="url"):
    return df.withColumn(out, U.absolute_or_null(F.col(url), base))


def with_resolved_url(df, base="page_url", href="href", out="url"):
    return df.withColumn(out, U.resolve(F.col(base), F.col(href)))


def with_board_job_id(df, url="url", html: str | None = None, out="job_id"):
    return df.withColumn(out, U.board_job_id(F.col(url), None if html is None else F.col(html)))


def with_posting_key(df, board_domain: str, out="posting_key"):
    key = U.posting_key(F.col("title"), F.col("company"), F.col("location"), F.col("url"), board_domain)
    return df.withColumn(out, key)


def searchable_postings(
    df: DataFrame, board_domain: str, as_of: str | Column = AS_OF, details: DataFrame | None = None
) -> DataFrame:
    """The key of raw posting rows and the fields that search criteria look at, in one projection. With ``details``,
    empty fields are filled from the detail pages before amounts and times are read from them."""
    read = df.withColumns(
        {
            "salary_range": X.salary_text(F.col("salary_text")),
            "employment_type": X.employment_type(F.col("employment_text")),
            "posted_date": X.posted_text(F.col("posted_text")),
            "remote_type": X.work_mode_of_location(F.col("location")),
            "experience_level": X.experience_level(F.col("title")),
        }
    )
    if details is not None:
        read = jn.enrich_details(read, details)
    return (
        read.transform(with_salary_bounds)
        .transform(with_posted_at, as_of=as_of)
        .transform(with_posting_key, board_domain)
        .drop("salary_text", "employment_text", "posted_text")
    )


def described_postings(df: DataFrame, description: str = "description") -> DataFrame:
    """The fields that are read from descriptions, and the board's id."""
    text = F.col(description)
    return df.withColumns(
        {
            "skills": X.skills(text),
            "requirements": X.requirements(text),
            "benefits": X.benefits(text),
            "industry": X.industry(text),
            "company_size": X.company_size(text),
            "job_id": U.board_job_id(F.col("url")),
        }
    )


def typed_postings(df: DataFrame, board_domain: str, as_of: str | Column = AS_OF) -> DataFrame:
    """All fields of raw posting rows (title, company, location, salary_text, employment_text,
    posted_text, description, url) in one projection."""
    return searchable_postings(df, board_domain, as_of).transform(described_postings)
