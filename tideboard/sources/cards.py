"""Cards of a result page. Nesting cannot be expressed as a pattern, so this one operator runs
Python: a tag scan per page, fed by Arrow batches, and only for pages that carry a card mark."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import html as H
from tideboard.functions import posting as X
from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.rules import pages as R

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(R)

# Opening tags of every selector, as one cheap test in the scan.
CARD_MARKS = r"(?i)\bdata-jk\b|job_seen_beacon|resultContent|jobsearch-|data-testid|" + R.TITLE_LINK_CLASS


_TITLE_LINK = ("a", "class", "contains", R.TITLE_LINK_CLASS)


def _title_boxes(page: E.Page) -> set[int]:
    """The nearest div around each title link."""
    out = set()
    for i in page.matching(_TITLE_LINK):
        at = page.parents[i]
        while at >= 0 and page.tags[at] != "div":
            at = page.parents[at]
        out.add(at)
    return out - {-1}


def find_cards(html: str) -> list[str]:
    """Card sources of one page, in page order, however many there are."""
    page = E.Page(html)
    return [html[page.starts[i] : page.ends[i]] for i in card_elements(page)]


def card_elements(page: E.Page) -> list[int]:
    """The elements of one page that are cards, in page order, however many there are.

    An element's rank is the first selector that it meets: marked cards, then elements named like cards, then the boxes
    of title links, each family only on pages without the one before. An element that is nested with a card of a better
    rank, inside or around it, is a part of that card or the list that holds it, and no card of its own."""
    for family in (R.PRIMARY_CARDS, R.FALLBACK_CARDS):
        ranked: dict[int, int] = {}
        for rank, selector in enumerate(family):
            for i in page.matching(selector):
                ranked.setdefault(i, rank)
        if ranked:
            break
    else:
        ranked = dict.fromkeys(_title_boxes(page), 0)
    best_around: dict[int, int] = {}  # of the elements with cards inside or around them, the best rank there
    for i, rank in ranked.items():
        at = page.parents[i]
        while at >= 0:
            if at in ranked:
                best_around[at] = min(best_around.get(at, rank), rank)
                best_around[i] = min(best_around.get(i, ranked[at]), ranked[at])
            at = page.parents[at]
    return sorted(i for i, rank in ranked.items() if best_around.get(i, rank) >= rank)


_OUTPUT_CHARS, _OUTPUT_CARDS = 32_000_000, 1024


def _batches(wanted: dict[str, tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The page source is the last column; the columns before it go along with every card. Output
    batches end at a fixed size, however large the pages are. What is wanted of a card is read from its range of the
    page's elements, which are those of the card's own source."""
    kind, _ = E.parts_type(tuple(wanted))
    fitting = E.Fitting([*R.PRIMARY_CARDS, *R.FALLBACK_CARDS, _TITLE_LINK, *E.selectors_of(wanted)])
    for batch in batches:
        *kept, html = batch.columns
        rows, positions, sources, read, chars = [], [], [], [], 0

        def cards_so_far() -> pa.RecordBatch:
            taken = [column.take(pa.array(rows, pa.int32())) for column in kept]
            return pa.RecordBatch.from_arrays(
                [*taken, pa.array(positions, pa.int64()), pa.array(sources, pa.string()), *([pa.array(read, kind)] if wanted else [])],
                names=[*batch.schema.names[:-1], "pos", "html", *(["parts"] if wanted else [])],
            )

        for row in range(len(html)):
            source = html[row].as_py()
            page = E.Page(source)
            page.look_for(fitting)
            for pos, i in enumerate(card_elements(page)):
                rows.append(row)
                positions.append(pos)
                sources.append(source[page.starts[i] : page.ends[i]])
                if wanted:
                    read.append(E.read_parts(page, wanted, page.span(i)))
                chars += len(sources[-1])
            if chars > _OUTPUT_CHARS or len(rows) >= _OUTPUT_CARDS:
                yield cards_so_far()
                rows, positions, sources, read, chars = [], [], [], [], 0
        yield cards_so_far()


def pages_to_cards(pages: DataFrame, keep: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """One row per card: page_id, the page columns to keep, pos, html, text, links. With names of card elements also
    parts, as ``card_parts`` reads them, from the scan that finds the cards."""
    columns = ["page_id", *keep]
    types = dict(pages.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", pos bigint, html string"
    wanted = {name: X.CARD_ELEMENTS[name] for name in parts}
    if wanted:
        schema += f", parts {E.parts_type(tuple(wanted))[1]}"
    return (
        pages.filter(F.rlike("html", F.lit(CARD_MARKS)))
        .select(*columns, "html")
        .mapInArrow(partial(_batches, wanted), schema)
        .select(
            *columns,
            "pos",
            "html",
            H.strip_tags(F.col("html")).alias("text"),
            F.transform(H.links(F.col("html")), lambda a: a["href"]).alias("links"),
            *(["parts"] if wanted else []),
        )
    )


def cards_to_postings(cards: DataFrame, base_url: str = "") -> DataFrame:
    """Posting columns of cards. Only card-sized strings are searched here. Cards without parts are scanned for them."""
    html, text, parts, first_link = F.col("html"), F.col("text"), F.col("parts"), F.get("links", 0)
    kept = [c for c in cards.columns if c not in ("html", "text", "links", "parts")]
    read = (cards if "parts" in cards.columns else cards.withColumn("parts", X.card_parts(html))).select(
        *kept,
        "text",
        X.title_of_card(html, parts).alias("title"),
        X.company_of_card(html, parts).alias("company"),
        X.company_url_of_card(html, base_url, parts).alias("company_url"),
        X.location_of_card(html, parts).alias("location"),
        X.description_of_card(html, parts).alias("description"),
        U.absolute_or_null(first_link, base_url).alias("url"),
        X.salary_of_card(html, text, parts).alias("salary_range"),
        X.posted_of_card(html, text, parts).alias("posted_date"),
        U.board_job_id(first_link, html).alias("job_id"),
    )
    return read.withColumns(
        {
            "job_type": X.job_type(text),
            "benefits": X.benefits(text),
            "requirements": X.requirements(text),
            "skills": X.skills(F.col("description"), text),
            "remote_type": X.work_mode_of_location(F.col("location")),
            "employment_type": X.employment_type(text),
            "industry": X.industry(text),
            "company_size": X.company_size(text),
        }
    ).drop("text")
