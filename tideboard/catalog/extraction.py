"""Queries for the field operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideboard import fixtures as fx
from tideboard.catalog import sqltext as s
from tideboard.operators import extract as op
from tideboard.rules import aliases as A
from tideboard.rules import lexicons as L
from tideboard.rules import patterns as P
from tideboard.sources import cards as sc
from tideboard.sources import details as sd

QUERIES, TWINS = {}, {}


def query(name, twin=None):
    def register(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn

    return register


def _postings(*columns):
    """Query on postings that keeps the id and the named columns; arrays become text."""

    def wrap(transform):
        def run(spark, sf_dir):
            df = transform(fx.postings(spark, sf_dir))
            types = dict(df.dtypes)
            return df.select(
                "posting_id",
                *[F.array_join(c, "|").alias(c) if types[c].startswith("array") else F.col(c) for c in columns],
            )

        return run

    return wrap


def _twin(select: str) -> str:
    return f"WITH {s.POSTINGS} SELECT posting_id, {select} FROM postings"


_TITLE_CASE = (
    "array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1),"
    " lambda w: upper(w[1]) || w[2:]), '')"
)
_HOST = s.extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


@query(
    "x1_company_from_url",
    "SELECT page_id, "
    + _TITLE_CASE.format(x=s.sub(f"string_split(replace({_HOST}, 'www.', ''), '.')[1]", "[-_]", " "))
    + " AS company FROM pages",
)
def x1(spark, sf_dir):
    return fx.spread(fx.table(spark, sf_dir, "pages")).transform(op.with_company_from_url).select("page_id", "company")


@query("x2_company_of_card", f"WITH {s.CARDS} SELECT page_id, pos, company, company_url FROM cards")
def x2(spark, sf_dir):
    cards = sc.pages_to_cards(fx.posting_pages(spark, sf_dir).select("page_id", "html"), parts=["company"])
    return cards.transform(op.with_company, base_url=fx.BOARD_URL, parts="parts").select("page_id", "pos", "company", "company_url")


@query("x3_clean_text", f"SELECT doc_id, md5({s.clean('text')}) AS clean_md5, length({s.clean('text')}) AS n_chars FROM documents")
def x3(spark, sf_dir):
    df = fx.spread(fx.table(spark, sf_dir, "documents")).transform(op.with_clean_text)
    return df.select("doc_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").cast("bigint").alias("n_chars"))


@query("x4_location_in_text", _twin(s.first_found("location", P.LOCATION_PATTERNS) + " AS place"))
@_postings("place")
def x4(df):
    return op.with_location(df, "location", "place")


@query(
    "x5_remote_type",
    _twin(
        """CASE WHEN lower(location) LIKE '%remote%' AND lower(location) LIKE '%hybrid%' THEN 'Hybrid'
        WHEN lower(location) LIKE '%remote%' THEN 'Remote' WHEN location <> '' THEN 'On-site' END AS remote_type, """
        + s.ladder("title", P.WORK_MODE_PATTERNS)
        + " AS title_mode"
    ),
)
@_postings("remote_type", "title_mode")
def x5(df):
    return df.transform(op.with_remote_type).transform(op.with_remote_type, "title", "title_mode", False)


_EDGE = r"[^\p{L}\p{N}_]"
EMPLOYMENT_SQL = s.ladder(
    "lower(employment_text)", [(n, rf"(^|{_EDGE})({w})($|{_EDGE})") for n, w in A.EMPLOYMENT_WORDS]
)


@query("x6_employment_type", _twin(EMPLOYMENT_SQL + " AS employment_type"))
@_postings("employment_type")
def x6(df):
    return op.with_employment_type(df, "employment_text")


@query("x7_job_type", _twin(s.ladder("lower(employment_text)", [(n, w) for w, n in A.JOB_TYPES]) + " AS job_type"))
@_postings("job_type")
def x7(df):
    return op.with_job_type(df, "employment_text")


# The postings' own pay texts are phrases as a whole.
@query("x8_salary_text", _twin("salary_text AS salary_range"))
@_postings("salary_range")
def x8(df):
    return op.with_salary_text(df, "salary_text")


def bounds_sql(x: str) -> str:
    number = r"\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*([kK]?)"
    both = rf"{number}\s*(?:-|–|to)\s*{number}"

    def amount(pattern, group):
        return (
            f"CAST(TRY_CAST(replace({s.extract(x, pattern, group)}, ',', '') AS DECIMAL(18,2))"
            f" * CASE WHEN lower({s.extract(x, pattern, group + 1)}) = 'k' THEN 1000 ELSE 1 END"
            f" * CASE WHEN {s.has(x, '(?i)(?:/|per|an)' + chr(92) + 's*(?:hour|hr)|hourly')} THEN 2080 ELSE 1 END AS BIGINT)"
        )

    low = f"CASE WHEN {s.has(x, both)} THEN {amount(both, 1)} WHEN NOT {s.has(x, '(?i)up' + chr(92) + 's+to')} THEN {amount(number, 1)} END"
    at_least = r"(?i)\bfrom\b|starting\s+at"
    high = f"CASE WHEN {s.has(x, both)} THEN {amount(both, 3)} WHEN NOT {s.has(x, at_least)} THEN {amount(number, 1)} END"
    period = (
        f"CASE WHEN {s.has(x, number)} AND {s.has(x, '(?i)(?:/|per|an)' + chr(92) + 's*(?:hour|hr)|hourly')} THEN 'hour'"
        f" WHEN {s.has(x, number)} AND {s.has(x, '(?i)(?:/|per|a)' + chr(92) + 's*(?:year|yr)|annual|yearly')} THEN 'year' END"
    )
    return f"{low} AS salary_min, {high} AS salary_max, {period} AS salary_period"


@query("x9_salary_bounds", _twin(bounds_sql("salary_text")))
@_postings("salary_min", "salary_max", "salary_period")
def x9(df):
    return op.with_salary_bounds(df, "salary_text")


LEVEL_SQL = s.ladder("lower(title)", [(n, s.one_of(w)) for n, w in A.LEVEL_WORDS])


@query("x10_experience_level", _twin(LEVEL_SQL + " AS experience_level"))
@_postings("experience_level")
def x10(df):
    return op.with_experience_level(df)


# The postings' own ages are phrases, some after a word.
POSTED_TEXT_SQL = """CASE WHEN posted_text LIKE 'Posted %' THEN substr(posted_text, 8)
    WHEN posted_text LIKE 'Active %' THEN substr(posted_text, 8) ELSE posted_text END"""


@query("x11_posted_text", _twin(POSTED_TEXT_SQL + " AS posted_date"))
@_postings("posted_date")
def x11(df):
    return op.with_posted_text(df, "posted_text")


_AGO = r"(\d+)\+?\s+(day|hour|min)[a-z]*\s+ago"
_NOW = f"TIMESTAMP '{op.AS_OF}'"


def posted_at_sql(x: str) -> str:
    n = f"TRY_CAST({s.extract(f'lower(trim({x}))', _AGO, 1)} AS INT)"
    unit = s.extract(f"lower(trim({x}))", _AGO, 2)
    return f"""CASE WHEN {s.has(f'lower({x})', 'today|just posted|just now')} THEN {_NOW}
        WHEN lower({x}) LIKE '%yesterday%' THEN {_NOW} - INTERVAL 1 DAY
        WHEN {unit} = 'day' THEN {_NOW} - to_days({n}) WHEN {unit} = 'hour' THEN {_NOW} - to_hours({n})
        WHEN {unit} = 'min' THEN {_NOW} - to_minutes({n})
        ELSE TRY_CAST(nullif({s.extract(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}')}, '') AS TIMESTAMP) END"""


@query("x12_posted_at", _twin(f"strftime({posted_at_sql('posted_text')}, '%Y-%m-%d %H:%M:%S') AS posted_at"))
@_postings("posted_at")
def x12(df):
    df = op.with_posted_at(df, "posted_text")
    return df.withColumn("posted_at", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"))


def _line_sql(min_length, min_words, stop, pick):
    return f"""WITH lines AS (SELECT doc_id, i, {s.strip('line')} AS line
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
        fit AS (SELECT doc_id, i, {{shown}} AS line FROM lines WHERE length(line) > {min_length}
          AND NOT {s.has('lower(line)', s.one_of(stop))} AND upper(line) <> line
          AND NOT {s.has('line', P.NOT_A_DESCRIPTION)} AND {s.words('line')} > {min_words})
        SELECT d.doc_id, md5(f.line) AS line_md5, length(f.line) AS n_chars FROM documents d LEFT JOIN
          (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {pick}) AS rn FROM fit) WHERE rn = 1) f
          ON d.doc_id = f.doc_id"""


def _description(kind):
    def run(spark, sf_dir):
        df = fx.spread(fx.table(spark, sf_dir, "documents")).transform(op.with_description, "text", "line", kind)
        return df.select("doc_id", F.md5("line").alias("line_md5"), F.length("line").cast("bigint").alias("n_chars"))

    return run


def formatted_sql(x: str) -> str:
    body = s.sub(s.decode(x), f"(?i)^{s.one_of(P.DESCRIPTION_LABELS)}:\\s*")
    lines = f"list_transform(string_split({body}, chr(10)), lambda l: CASE WHEN {s.has('lower(l)', '^' + s.one_of(P.CHROME_LINES))} THEN '' ELSE l END)"
    passages = "|".join(".*?".join(map(s.literal, p)) for p in P.BOILERPLATE)
    out = s.sub(f"array_to_string({lines}, chr(10))", f"(?is){passages}")
    out = s.sub(out, "([.!?a-z])([A-Z])", r"\1 \2")
    out = s.sub(out, s.one_of(P.LINE_HEADINGS), "\n\\1")
    out = s.sub(out, s.one_of(P.PARAGRAPH_HEADINGS), "\n\n\\1")
    return s.strip(s.sub(s.sub(out, r"[ \t]+", " "), r"\n(?:\s*\n){2,}", "\n\n"))


query("x13_description_line", _line_sql(40, 6, P.CARD_LINE_STOP_WORDS, "i").replace("{shown}", s.squeeze("line")))(_description("lines"))
query(
    "x13_detail_description_line",
    _line_sql(200, 15, P.DETAIL_LINE_STOP_WORDS, "length(line) DESC, i").replace("{shown}", formatted_sql("line")),
)(_description("detail"))


@query("x13_description_of_card", f"WITH {s.CARDS} SELECT page_id, pos, {s.squeeze('description')} AS description FROM cards")
def x13_card(spark, sf_dir):
    cards = sc.pages_to_cards(fx.posting_pages(spark, sf_dir).select("page_id", "html"), parts=["description"])
    return cards.transform(op.with_description, "html", "description", "card", "parts").select("page_id", "pos", "description")


@query(
    "x14_formatted_description",
    f"""SELECT doc_id, md5({formatted_sql('text')}) AS text_md5, length({formatted_sql('text')}) AS n_chars FROM documents""",
)
def x14(spark, sf_dir):
    df = fx.spread(fx.table(spark, sf_dir, "documents")).transform(op.with_formatted_description, "text", "shown")
    return df.select("doc_id", F.md5("shown").alias("text_md5"), F.length("shown").cast("bigint").alias("n_chars"))


def requirements_sql(x: str) -> str:
    found = " || ".join(f"regexp_extract_all({x}, {s.q(p)}, 1)" for p in P.REQUIREMENT_PATTERNS)
    stripped = f"list_transform({found}, lambda r: {s.strip('r')})"
    return f"list_filter({stripped}, lambda r: length(r) > 10 AND length(r) < 200)"


@query("x15_requirements", _twin(f"array_to_string({requirements_sql('description')}, '|') AS requirements"))
@_postings("requirements")
def x15(df):
    return op.with_requirements(df, "description")


_SECTION = "CASE " + " ".join(
    f"WHEN instr(lower(description), {s.q(h)}) > 0 THEN substr(description, instr(lower(description), {s.q(h)}))"
    for h in L.REQUIREMENT_HEADINGS
) + " END"


@query("x15_requirement_section", _twin(f"coalesce({s.clean(_SECTION)}, '') AS requirements"))
@_postings("requirements")
def x15_section(df):
    return op.with_requirements(df, "description", kind="section")


def _item_page():
    """Each page with its sentences as list items, so that the item operators see real text."""
    return F.concat(
        F.lit("<ul class='benefits requirements'><li>"), F.regexp_replace(F.col("description"), r"[.:,]\s*", "</li><li>"), F.lit("</li></ul>")
    )


_ITEMS_SQL = (
    "list_transform(regexp_extract_all('<ul><li>' || " + s.sub("description", r"[.:,]\s*", "</li><li>")
    + " || '</li></ul>', '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), lambda i: " + s.squeeze("i") + ")"
)


def _items_twin(words, longer, shorter, out):
    fits = f"{s.has('lower(i)', s.one_of(words))} AND length(i) > {longer} AND length(i) < {shorter}"
    return _twin(f"array_to_string(list_sort(list_distinct(list_filter({_ITEMS_SQL}, lambda i: {fits}))), '|') AS {out}")


@query("x15_requirement_items", _items_twin(L.REQUIREMENT_ITEM_WORDS, 10, 200, "requirements"))
@_postings("requirements")
def x15_items(df):
    return op.with_requirements(df.withColumn("html", _item_page()), "html", kind="items")




def skills_sql(x: str, lexicon=L.SKILLS) -> str:
    text = s.sub(f"lower({x})", r"([^\p{L}\p{N}_])", r"\1\1")
    arms = [
        f"CASE WHEN {s.has(text, r'(^|[^\p{L}\p{N}_])' + s.literal(_doubled(t)) + r'($|[^\p{L}\p{N}_+#])')} THEN {s.q(shown)} END"
        for t, shown in lexicon
    ]
    return f"list_filter([{', '.join(arms)}], lambda k: k IS NOT NULL)"


def _doubled(term: str) -> str:
    return "".join(c if c.isalnum() else c + c for c in term)


@query("x16_skills", _twin(f"array_to_string({skills_sql('description')}, '|') AS skills"))
@_postings("skills")
def x16(df):
    return op.with_skills(df)


def phrases_sql(x: str, lexicon) -> str:
    arms = [f"CASE WHEN instr(lower({x}), {s.q(t)}) > 0 THEN {s.q(shown)} END" for t, shown in lexicon]
    return f"list_filter([{', '.join(arms)}], lambda k: k IS NOT NULL)"


@query("x17_benefits", _twin(f"array_to_string({phrases_sql('description', L.BENEFITS)}, '|') AS benefits"))
@_postings("benefits")
def x17(df):
    return op.with_benefits(df, "description")


@query("x17_benefit_items", _items_twin(L.BENEFIT_ITEM_WORDS, 5, 100, "benefits"))
@_postings("benefits")
def x17_items(df):
    return op.with_benefits(df.withColumn("html", _item_page()), "html", is_detail=True)


INDUSTRY_SQL = s.ladder("lower(description)", [(shown, t) for t, shown in L.INDUSTRIES])


@query("x18_industry", _twin(INDUSTRY_SQL + " AS industry"))
@_postings("industry")
def x18(df):
    return op.with_industry(df, "description")


@query(
    "x18_industry_of_page",
    f"WITH {s.DETAIL_PAGES} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Health care' END AS industry FROM detail_pages",
)
def x18_page(spark, sf_dir):
    return fx.detail_pages(spark, sf_dir).transform(op.with_industry, "html", is_detail=True).select("page_id", "industry")


@query(
    "x19_company_size_of_page",
    f"WITH {s.DETAIL_PAGES} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '51-200' END AS company_size FROM detail_pages",
)
def x19_page(spark, sf_dir):
    return fx.detail_pages(spark, sf_dir).transform(op.with_company_size, "html", is_detail=True).select("page_id", "company_size")


SIZE_SQL = s.first_found("description", P.COMPANY_SIZE_PATTERNS)


@query("x19_company_size", _twin(SIZE_SQL + " AS company_size"))
@_postings("company_size")
def x19(df):
    return op.with_company_size(df, "description")


@query(
    "x20_absolute_url",
    _twin(f"CASE WHEN url LIKE '/%' THEN '{fx.BOARD_URL}' || url WHEN url LIKE 'http%' THEN url END AS abs_url"),
)
@_postings("abs_url")
def x20(df):
    return op.with_absolute_url(df, fx.BOARD_URL, out="abs_url")


@query(
    "x21_board_job_id",
    f"""WITH {s.POSTINGS} SELECT posting_id AS page_id, CAST(posting_id AS VARCHAR) AS card_id,
        coalesce(nullif({s.extract('url', '[?&]jk=([^&#]+)', 1)}, ''), nullif({s.extract('url', '[?&]id=([^&#]+)', 1)}, '')) AS url_id FROM postings""",
)
def x21(spark, sf_dir):
    pages = fx.posting_pages(spark, sf_dir).withColumn("link", F.regexp_extract("html", r'<h2 class="jobTitle"><a href="([^"]*)"', 1))
    df = pages.transform(op.with_board_job_id, "link", "html", "card_id").transform(op.with_board_job_id, "link", None, "url_id")
    return df.select("page_id", "card_id", "url_id")


def key_sql() -> str:
    parts = " || '|' || ".join(s.squeeze(f"lower(coalesce({c}, ''))") for c in ("title", "company", "location"))
    jk = s.extract("lower(trim(url))", "jk=([^&]*)", 1)
    return (
        f"CASE WHEN instr(lower(trim(url)), '{fx.BOARD}') > 0 AND {jk} <> '' THEN 'board_' || {jk}"
        f" WHEN instr(lower(trim(url)), '{fx.BOARD}') > 0 THEN lower(trim(url)) ELSE {parts} END"
    )


@query("x22_posting_key", _twin(key_sql() + " AS posting_key"))
@_postings("posting_key")
def x22(df):
    return op.with_posting_key(df, fx.BOARD)


@query(
    "h4_first_match",
    _twin("coalesce(nullif(trim(salary_text), ''), nullif(trim(employment_text), ''), nullif(trim(posted_text), '')) AS first_text"),
)
@_postings("first_text")
def h4(df):
    return op.first_match(df, "first_text", [F.col("salary_text"), F.col("employment_text"), F.col("posted_text")])


_PAGE_TEXT = s.plain("html")
_DETAIL_LINE = "'We build tools. ' || substr(p.description, 17) || ' Our people ship every week and care about craft and calm on-call shifts, number ' || p.posting_id || '.'"
DETAILS_SQL = f"""{s.DETAIL_PAGES}, details AS (SELECT d.url, p.salary_text AS salary_range,
      {EMPLOYMENT_SQL.replace('employment_text', 'page_text')} AS employment_type, {POSTED_TEXT_SQL.replace('posted_text', 'p.posted_text')} AS posted_date,
      {formatted_sql(s.squeeze(_DETAIL_LINE))} AS description, ['Free lunch', 'Health insurance for all ' || d.page_id % 50] AS benefits,
      ['Bachelor degree or ' || (d.page_id % 7 + 2) || ' years of experience', 'Strong knowledge of Python and Docker'] AS requirements, ['Python', 'Docker'] AS skills,
      CASE WHEN d.page_id % 3 = 0 THEN 'Health care' END AS industry, CASE WHEN d.page_id % 2 = 0 THEN '51-200' END AS company_size
    FROM (SELECT *, {_PAGE_TEXT} AS page_text FROM detail_pages) d JOIN postings p ON p.posting_id = d.page_id)"""


@query(
    "j4_details_from_pages",
    f"""WITH {DETAILS_SQL} SELECT * REPLACE (array_to_string(benefits, '|') AS benefits, array_to_string(requirements, '|') AS requirements,
        array_to_string(skills, '|') AS skills) FROM details""",
)
def details_of_pages(spark, sf_dir):
    details = sd.pages_to_details(fx.detail_pages(spark, sf_dir))
    return details.withColumns({c: F.array_join(c, "|") for c in ("benefits", "requirements", "skills")})
