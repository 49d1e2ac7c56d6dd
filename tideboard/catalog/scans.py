"""Queries for page, payload and card scans, and for the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideboard import fixtures as fx
from tideboard.catalog import sqltext as s
from tideboard.catalog.extraction import (
    EMPLOYMENT_SQL, INDUSTRY_SQL, LEVEL_SQL, SIZE_SQL, phrases_sql, requirements_sql, skills_sql,
)
from tideboard.functions import html as H
from tideboard.functions import posting as X
from tideboard.operators import extract as ex
from tideboard.rules import aliases as A
from tideboard.rules import lexicons as L
from tideboard.rules import pages as R
from tideboard.rules import titles as TT
from tideboard.rules import urls as U
from tideboard.session import fresh_path
from tideboard.sources import cards as sc
from tideboard.sources import pages as sp
from tideboard.sources import payloads as pl
from tideboard.sources import sinks

QUERIES, TWINS = {}, {}


def query(name, twin=None):
    def register(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn

    return register


def _pages(spark, sf_dir):
    return fx.spread(sp.read_pages(spark, f"{sf_dir}/pages.parquet"))


@query("s1_read_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def s1(spark, sf_dir):
    pages = sp.read_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


# --- JSON ----------------------------------------------------------------------------------

_ITEMS_SQL = f"""{s.POSTING_PAGES}, keys(list_key) AS (VALUES {', '.join(f'({s.q(k)})' for k in R.PAYLOAD_LISTS)}),
    lists AS (SELECT page_id, list_key, CAST(json_extract(CAST(payload AS JSON), '$.' || list_key) AS JSON[]) AS items
              FROM posting_pages, keys WHERE json_type(json_extract(CAST(payload AS JSON), '$.' || list_key)) = 'ARRAY'),
    items AS (SELECT page_id, list_key, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM lists)"""


@query(
    "s2_explode_payloads",
    f"""WITH {_ITEMS_SQL} SELECT page_id, list_key, pos, coalesce(item->>'$.title', item->>'$.jobTitle') AS title,
        item->>'$.salary.max' AS pay FROM items WHERE json_type(item) = 'OBJECT'""",
)
def s2(spark, sf_dir):
    items = pl.explode_payloads(fx.posting_pages(spark, sf_dir).select("page_id", "payload"))
    value = lambda path: F.try_variant_get("item", path, "string")
    return items.select(
        "page_id", "list_key", "pos", F.coalesce(value("$.title"), value("$.jobTitle")).alias("title"),
        value("$.salary.max").alias("pay"),
    )


@query(
    "s2_unparsable_payloads",
    f"""WITH {_ITEMS_SQL} SELECT page_id, pos, CAST(NULL AS VARCHAR) AS error FROM items JOIN postings ON posting_id = page_id
          WHERE json_type(item) = 'OBJECT' AND company IS NOT NULL
        UNION ALL SELECT posting_id, NULL, 'payload is not JSON' FROM postings WHERE company IS NULL""",
)
def s2_errors(spark, sf_dir):
    """Payloads of postings without a company are cut off in the middle."""
    cut = F.when(F.rlike("html", F.lit("companyName[\"']?></span>")), F.left("payload", F.lit(30))).otherwise(F.col("payload"))
    pages = fx.posting_pages(spark, sf_dir).select("page_id", cut.alias("payload"))
    return pl.explode_payloads(pages, keep_unparsable=True).select("page_id", "pos", "error")


def title_sql(x: str) -> str:
    t = s.strip(f"lower({x})")
    edge = r"[^\p{L}\p{N}_]"
    nav = rf"(^|{edge})(" + "|".join(s.literal(k) for k in TT.NAV_KEYWORDS) + rf")($|{edge})"
    return f"""CASE WHEN {x} IS NULL OR length({x}) < 5 OR length({x}) > 200 THEN false
        WHEN {s.has(t, TT.JOB_COUNT)} THEN false
        WHEN {s.has(t, nav)} THEN false
        WHEN {s.has(t, '^(' + '|'.join(TT.UI_OPENINGS) + ')')} THEN false
        WHEN NOT {s.has(x, '[a-zA-Z]')} THEN false
        WHEN length({s.sub(x, '[^0-9]')}) * 2 > length({x}) THEN false
        WHEN {s.words(x)} = 1 AND {t} IN ({s.strings(TT.SINGLE_WORD_NAV)}) THEN false
        WHEN {s.words(x)} <= 2 AND {s.has(x, chr(94) + chr(92) + 'p{Lu}')} AND {t} IN ({s.strings(TT.PLACE_TITLES)}) THEN false
        WHEN {t} IN ({s.strings(TT.DEPARTMENT_TITLES)}) THEN false
        WHEN {s.words(x)} >= 3 AND NOT {s.has(t, s.one_of(TT.ROLE_TERMS))} AND {s.has(t, s.one_of(TT.LONG_TITLE_NAV))} THEN false
        ELSE true END"""


@query(
    "s3_project_payload",
    f"""WITH {_ITEMS_SQL}, raw AS (SELECT page_id, pos, coalesce(item->>'$.title', item->>'$.jobTitle') AS t,
          item->>'$.city' AS city, item->>'$.hostedUrl' AS url, item->>'$.salary.min' || ' - ' || (item->>'$.salary.max') AS salary_range
          FROM items WHERE json_type(item) = 'OBJECT')
        SELECT page_id, pos, {s.clean('t')} AS title, nullif({s.clean('city')}, '') AS location, url, salary_range
        FROM raw WHERE {title_sql('t')}""",
)
def s3(spark, sf_dir):
    items = pl.explode_payloads(fx.posting_pages(spark, sf_dir).select("page_id", "payload"))
    return pl.project_payload(items).select("page_id", "pos", "title", "location", "url", "salary_range")


_CARDS_SQL = f"""{s.POSTING_PAGES}, scripts AS (SELECT page_id,
      regexp_extract(html, '(?is)<script\\b[^>]*type=["'']application/json["''][^>]*>(.*?)</script\\s*>', 1) AS body FROM posting_pages),
    lists AS (SELECT page_id, CAST(json_extract(CAST(body AS JSON), '$.hydrateJobCardsResponse.jobCards') AS JSON[]) AS items
      FROM scripts WHERE body <> ''),
    cards AS (SELECT page_id, unnest(items) AS card, generate_subscripts(items, 1) - 1 AS pos FROM lists)"""


@query(
    "s4_explode_embedded_json",
    f"""WITH {_CARDS_SQL} SELECT page_id, pos, card->>'$.title' AS title, card->>'$.location.displayName' AS place,
        CAST(card->>'$.pay.min' AS BIGINT) AS pay_min, card->>'$.listingKey' AS listing_key FROM cards""",
)
def s4(spark, sf_dir):
    cards = pl.explode_embedded_json(fx.posting_pages(spark, sf_dir).select("page_id", "html"))
    return cards.select(
        "page_id", "pos", F.col("card.title").alias("title"), F.col("card.location.displayName").alias("place"),
        F.col("card.pay.min").alias("pay_min"), F.col("card.listingKey").alias("listing_key"),
    )


@query(
    "s5_project_board_cards",
    f"""WITH {_CARDS_SQL}, t AS (SELECT *, card->>'$.title' AS title FROM cards)
        SELECT page_id, title, card->>'$.location.displayName' AS location,
          '$' || format('{{:,}}', CAST(card->>'$.pay.min' AS BIGINT)) || ' - $' || format('{{:,}}', CAST(card->>'$.pay.max' AS BIGINT)) AS salary_range,
          {LEVEL_SQL} AS experience_level, CAST(NULL AS VARCHAR) AS remote_type, CAST(NULL AS VARCHAR) AS employment_type,
          CAST(NULL AS VARCHAR) AS posted_date, card->>'$.listingKey' AS job_id FROM t""",
)
def s5(spark, sf_dir):
    cards = pl.explode_embedded_json(fx.posting_pages(spark, sf_dir).select("page_id", "html"))
    return pl.project_board_cards(cards).select(
        "page_id", "title", "location", "salary_range", "experience_level", "remote_type", "employment_type",
        "posted_date", "job_id",
    )


# --- pages ---------------------------------------------------------------------------------

VISIBLE_SQL = s.plain(s.drop_tags("html", s.CHROME))


@query("h1_pages_to_text", f"SELECT page_id, md5({VISIBLE_SQL}) AS text_md5, length({VISIBLE_SQL}) AS n_chars FROM pages")
def h1(spark, sf_dir):
    text = sp.pages_to_text(_pages(spark, sf_dir))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


_HREF = r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
_ORIGIN = s.extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
_LINKS_SQL = f"""found AS (SELECT page_id, url, regexp_extract_all(html, {s.q(H.LINK)}) AS l FROM pages),
    one AS (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM found),
    links AS (SELECT page_id, pos, {s.decode(s.extract('a', _HREF, 1))} AS href, {s.plain('a')} AS anchor, {_ORIGIN} AS origin FROM one)"""
# Every link of the given pages is root-relative; the other forms are covered by unit tests.
_ABS = "CASE WHEN href LIKE '/%' THEN origin || href ELSE href END"


@query("h2_pages_to_links", f"WITH {_LINKS_SQL} SELECT page_id, pos, href, {_ABS} AS abs_url, anchor FROM links")
def h2(spark, sf_dir):
    return sp.pages_to_links(_pages(spark, sf_dir))


_BODY = s.drop_tags("html", s.CHROME)
_BODY_LINKS = _LINKS_SQL.replace(f"regexp_extract_all(html, {s.q(H.LINK)})", f"regexp_extract_all({_BODY}, {s.q(H.LINK)})")
_BODY_LINKS = _BODY_LINKS.replace("FROM pages", "FROM posting_pages")


@query("h2_body_links", f"WITH {s.POSTING_PAGES}, {_BODY_LINKS} SELECT page_id, pos, href, anchor FROM links")
def h2_body(spark, sf_dir):
    return sp.pages_to_links(fx.posting_pages(spark, sf_dir), drop_chrome=True).select("page_id", "pos", "href", "anchor")


@query(
    "h2_job_link",
    f"""WITH {_LINKS_SQL}, marked AS (SELECT page_id, pos, {_ABS} AS abs_url FROM links)
        SELECT p.page_id, coalesce(arg_min(abs_url, pos) FILTER (WHERE {s.has('lower(abs_url)', s.one_of(U.JOB_LINK_FRAGMENTS))}),
          arg_min(abs_url, pos)) AS job_link FROM pages p LEFT JOIN marked m ON p.page_id = m.page_id GROUP BY p.page_id""",
)
def h2_job(spark, sf_dir):
    return sp.with_job_link(_pages(spark, sf_dir)).select("page_id", "job_link")


def _cards(spark, sf_dir, parts=tuple(X.CARD_ELEMENTS)):
    return sc.pages_to_cards(fx.posting_pages(spark, sf_dir).select("page_id", "html"), parts=parts)


@query(
    "h3_pages_to_cards",
    f"WITH {s.CARDS} SELECT page_id, pos, {s.squeeze('title')} AS title, company, {s.squeeze('location')} AS location FROM cards",
)
def h3(spark, sf_dir):
    cards = sc.cards_to_postings(_cards(spark, sf_dir), fx.BOARD_URL)
    return cards.select("page_id", "pos", "title", "company", "location")


def _card_field(name, out, column, part, operator):
    """A field read from card source equals the posting's own text where the card shows one."""

    @query(name, f"WITH {s.CARDS} SELECT page_id, pos, {column} AS {out} FROM cards")
    def run(spark, sf_dir):
        return _cards(spark, sf_dir, [part]).transform(operator).select("page_id", "pos", out)


_card_field("x4_location_of_card", "location", "location", "location", lambda d: ex.with_location(d, "html", "location", is_card=True, parts="parts"))
_card_field(
    "x8_salary_of_card", "salary_text", "salary_text", "salary", lambda d: ex.with_salary_text(d, "html", "salary_text", is_card=True, parts="parts")
)
_card_field("x2_title_of_card", "title", "title", "title", lambda d: d.withColumn("title", X.title_of_card(F.col("html"), F.col("parts"))))
_POSTED = """CASE WHEN posted_text LIKE 'Posted %' THEN substr(posted_text, 8)
    WHEN posted_text LIKE 'Active %' THEN substr(posted_text, 8) ELSE posted_text END"""
_card_field("x11_posted_of_card", "posted", _POSTED, "posted", lambda d: ex.with_posted_text(d, "html", "posted", is_card=True, parts="parts"))


def _of_text(sql: str, column: str) -> str:
    return sql.replace(column, "card_text")


_CARD_SKILLS = f"CASE WHEN len({skills_sql('description')}) > 0 THEN {skills_sql('description')} ELSE {skills_sql('card_text')} END"


@query(
    "h3_card_postings",
    f"""WITH {s.CARDS} SELECT page_id, pos, {s.squeeze('title')} AS title, company, company_url, {s.squeeze('location')} AS location,
        {s.squeeze('description')} AS description, url, salary_text AS salary_range, {_POSTED} AS posted_date, job_id,
        {s.ladder("lower(card_text)", [(n, w) for w, n in A.JOB_TYPES])} AS job_type, array_to_string({phrases_sql('card_text', L.BENEFITS)}, '|') AS benefits,
        array_to_string({requirements_sql('card_text')}, '|') AS requirements, array_to_string({_CARD_SKILLS}, '|') AS skills,
        CASE WHEN lower(location) LIKE '%remote%' AND lower(location) LIKE '%hybrid%' THEN 'Hybrid' WHEN lower(location) LIKE '%remote%' THEN 'Remote'
          WHEN location <> '' THEN 'On-site' END AS remote_type, {_of_text(EMPLOYMENT_SQL, 'employment_text')} AS employment_type,
        {_of_text(INDUSTRY_SQL, 'description')} AS industry, {_of_text(SIZE_SQL, 'description')} AS company_size FROM cards""",
)
def h3_postings(spark, sf_dir):
    postings = sc.cards_to_postings(_cards(spark, sf_dir), fx.BOARD_URL)
    lists = [c for c, t in postings.dtypes if t.startswith("array")]
    return postings.withColumns({c: F.array_join(c, "|") for c in lists})


def _title_candidates():
    shown = s.drop_tags("html", s.HIDDEN)
    any_tag = "[a-z][a-z0-9]*"
    classes = lambda *names: [(any_tag, rf'\bclass="[^"]*{n}[^"]*"') for n in names]
    selectors = [
        (any_tag, r'\bdata-automation-id="[^"]*jobTitle[^"]*"'),
        (any_tag, r'\bdata-testid="[^"]*job[^"]*"'),
        (any_tag, r'\bdata-testid="[^"]*title[^"]*"'),
        *classes("job-title", "jobTitle", "JobTitle", "position-title", "opening-title"),
        ("h1", ""), ("h2", ""), ("h3", ""), ("h4", ""), ("h5", ""),
        *[("a", rf'\bhref="[^"]*{n}[^"]*"') for n in ("job", "position", "career")],
        *classes("title", "job", "position"),
        ("a", ""),
    ]
    for tag, attribute in selectors:
        opening = rf"<(?:{tag})\b[^>]*{attribute}[^>]*>" if attribute else rf"<(?:{tag})\b[^>]*>"
        yield s.plain(s.extract(shown, rf"(?is){opening}(.*?)</(?:{tag})\s*>", 1))


@query(
    "h5_pages_to_title",
    f"""WITH c AS (SELECT page_id, unnest([{', '.join(_title_candidates())}]) AS title, unnest(range(20)) AS i FROM pages)
        SELECT page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(title) DESC, i) AS rn
          FROM c WHERE length(title) BETWEEN 3 AND 200) WHERE rn = 1""",
)
def h5(spark, sf_dir):
    return sp.pages_to_title(_pages(spark, sf_dir)).select("page_id", "title")


def _classify_sql(source: str) -> str:
    v = f"lower({s.plain(s.drop_tags('html', s.HIDDEN))})"
    has = lambda x, words: s.has(x, s.one_of(words))
    h = "lower(html)"
    return f"""page_id,
        CASE WHEN {has(h, R.MODAL_MARKS)} THEN 'modal_first'
          WHEN {has(h, R.SEARCH_MARKS)} AND instr({h}, 'job') = 0 THEN 'search_first'
          WHEN {has(h, R.FILTER_MARKS)} THEN 'filter_required' ELSE 'direct_listing' END AS page_type,
        CASE WHEN {has(h, R.NUMBERED_MARKS)} THEN 'numbered' WHEN {has(h, R.LOAD_MORE_MARKS)} THEN 'load_more'
          WHEN {has(h, R.SCROLL_MARKS)} THEN 'infinite_scroll' ELSE 'none' END AS pagination_type,
        {has(v, R.LANDING_MARKS)} AS is_landing,
        {has(h, R.EMPTY_MARKS)} AS is_empty, {has(v, R.END_MARKS)} AS is_end,
        ({has('html', R.CHALLENGE_MARKS)} OR (instr(html, {s.q(R.CHALLENGE_PAIR[0])}) > 0 AND instr(html, {s.q(R.CHALLENGE_PAIR[1])}) > 0))
          AND NOT {has('html', R.RESULT_MARKS)} AS is_blocked,
        {has(v, R.JOB_WORDS)} AS has_job_terms FROM {source}"""


@query("h6_classify_pages", f"SELECT {_classify_sql('pages')}")
def h6(spark, sf_dir):
    return sp.classify_pages(_pages(spark, sf_dir))


@query("h6_classify_result_pages", f"WITH {s.POSTING_PAGES} SELECT {_classify_sql('posting_pages')}")
def h6_results(spark, sf_dir):
    return sp.classify_pages(fx.posting_pages(spark, sf_dir))


@query(
    "h7_pagination_info",
    f"""WITH {s.POSTINGS} SELECT posting_id AS page_id, 'numbered' AS pagination_type, CAST(1 AS BIGINT) AS current_page,
        CAST(greatest(2, 2 + query_id % 9) AS BIGINT) AS total_pages,
        array_to_string(list_sort(list_distinct([1, 2, CAST(2 + query_id % 9 AS BIGINT)])), ',') AS page_numbers,
        true AS has_next, false AS has_prev FROM postings""",
)
def h7(spark, sf_dir):
    info = sp.pagination_info(fx.posting_pages(spark, sf_dir))
    return info.select(
        "page_id", "pagination_type", F.col("current_page").cast("bigint").alias("current_page"),
        F.col("total_pages").cast("bigint").alias("total_pages"),
        F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"), "has_next", "has_prev",
    )


@query(
    "h8_page_plan",
    f"""WITH {s.POSTINGS}, n AS (SELECT posting_id, CAST(2 + query_id % 9 AS BIGINT) AS last FROM postings)
        SELECT posting_id AS page_id, p AS page_no, (p - 1) * {R.PAGE_SIZE} AS row_offset
        FROM (SELECT posting_id, unnest(range(2, last + 1)) AS p FROM n)""",
)
def h8(spark, sf_dir):
    plan = sp.page_plan(sp.pagination_info(fx.posting_pages(spark, sf_dir)))
    return plan.select(
        "page_id", F.col("page_no").cast("bigint").alias("page_no"), F.col("row_offset").cast("bigint").alias("row_offset")
    )


# --- sinks ---------------------------------------------------------------------------------

@query(
    "s6_write_postings",
    f"WITH {s.POSTINGS} SELECT source, count(*) AS n, count(company) AS n_company, min(title) AS first_title FROM postings GROUP BY source",
)
def s6(spark, sf_dir):
    path = fresh_path(spark, "postings")
    sinks.write_postings(fx.postings(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.count("*").alias("n"), F.count("company").alias("n_company"), F.min("title").alias("first_title")
    )


@query(
    "s7_write_run_report",
    "SELECT count(*) AS total_urls, count(*) FILTER (WHERE event_type <> 'error') AS successful,"
    " count(*) FILTER (WHERE event_type = 'error') AS failed FROM events",
)
def s7(spark, sf_dir):
    from tideboard.operators.aggregates import url_report

    path = fresh_path(spark, "report")
    report = url_report(fx.page_runs(spark, sf_dir))
    sinks.write_run_report(report, path)
    return spark.read.schema(report.schema).json(path).select("total_urls", "successful", "failed")
