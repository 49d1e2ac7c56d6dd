"""Detail pages: the page of one posting, read into the columns that fill up a listed posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import html as H
from tideboard.functions import posting as X


def pages_of(pages: DataFrame, postings: DataFrame | None) -> DataFrame:
    """The pages of the postings' urls, found before any page is read; all pages without postings."""
    return pages if postings is None else pages.join(postings.select("url").distinct(), "url", "left_semi")


def pages_to_details(pages: DataFrame) -> DataFrame:
    """One row per page (url, html) with url and the fields of ``enrich_details``: salary_range, employment_type,
    posted_date, description, benefits, requirements, skills, industry and company_size. A field without a fitting
    element or text is NULL, a list is empty. Pages are expected once per URL."""
    html, parts, text = F.col("html"), F.col("parts"), F.col("text")
    read = pages.select("url", "html", X.detail_parts(html).alias("parts"), H.visible_text(html, H.HIDDEN_TAGS).alias("text"))
    return read.select(
        "url",
        X.salary_of_page(text, parts).alias("salary_range"),
        X.employment_type(text).alias("employment_type"),
        X.posted_of_page(text, parts).alias("posted_date"),
        X.description_of_page(html, parts).alias("description"),
        X.benefit_items(E.texts(parts["benefits"])).alias("benefits"),
        X.requirement_items(E.texts(parts["requirements"])).alias("requirements"),
        X.skills(F.array_join(E.texts(parts["skills"]), " ")).alias("skills"),
        X.industry_of_page(html, parts["industry"]).alias("industry"),
        X.company_size_of_page(html, parts["size"]).alias("company_size"),
    )
