"""Queries for filters, verdicts, joins, windows, limits, unions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideboard import fixtures as fx
from tideboard.catalog import sqltext as s
from tideboard.catalog.extraction import (
    EMPLOYMENT_SQL, INDUSTRY_SQL, LEVEL_SQL, SIZE_SQL, bounds_sql, key_sql, phrases_sql, posted_at_sql,
    requirements_sql, skills_sql,
)
from tideboard.catalog.scans import title_sql
from tideboard.operators import aggregates as ag
from tideboard.operators import extract as ex
from tideboard.operators import filters as fl
from tideboard.operators import joins as jn
from tideboard.operators import limits as lm
from tideboard.operators import sets as st
from tideboard.operators import windows as wn
from tideboard.rules import aliases as A
from tideboard.rules import lexicons as L
from tideboard.rules import pages as R
from tideboard.rules import places as PL
from tideboard.rules import titles as TT
from tideboard.rules import urls as U

QUERIES, TWINS = {}, {}
ARRIVAL = ["query_id", "page_no", "posting_id"]


def query(name, twin=None):
    def register(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn

    return register


def typed(spark, sf_dir):
    return fx.postings(spark, sf_dir).transform(ex.typed_postings, fx.BOARD).withColumn("pos", F.col("posting_id"))


MODE_SQL = """CASE WHEN lower(location) LIKE '%remote%' AND lower(location) LIKE '%hybrid%' THEN 'Hybrid'
    WHEN lower(location) LIKE '%remote%' THEN 'Remote' WHEN location <> '' THEN 'On-site' END"""
TYPED = f"""{s.POSTINGS}, typed AS (SELECT *, {MODE_SQL} AS remote_type, {EMPLOYMENT_SQL} AS employment_type,
    {LEVEL_SQL} AS experience_level, {bounds_sql('salary_text')}, {posted_at_sql('posted_text')} AS posted_at,
    {key_sql()} AS posting_key, {requirements_sql('description')} AS requirements FROM postings)"""


def _kept(condition: str, columns: str = "posting_id") -> str:
    return f"WITH {TYPED} SELECT {columns} FROM typed WHERE {condition}"


# --- filters -------------------------------------------------------------------------------

_TEXT = "lower(concat_ws(' ', title, description, location, employment_type, remote_type, array_to_string(requirements, ' ')))"


@query("f1_filter_keyword", _kept(f"instr({_TEXT}, 'remote') > 0", "posting_id, title"))
def f1(spark, sf_dir):
    return fl.filter_keyword(typed(spark, sf_dir), "Remote").select("posting_id", "title")


def _place(words: str, codes: str = "", capitals: str = "") -> str:
    tests = [s.has("lower(location)", rf"(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])")]
    if codes:
        tests.append(s.has("lower(location)", rf",\s*({codes})($|[^\p{{L}}\p{{N}}_])"))
    if capitals:
        tests.append(s.has("location", rf"\b{capitals}\b"))
    return f"(location IS NULL OR location = '' OR coalesce(remote_type = 'Remote', false) OR {' OR '.join(tests)})"




def _location_query(place, condition):
    @query(f"f2_filter_location_{place.replace(' ', '_')}", _kept(condition, "posting_id, location"))
    def run(spark, sf_dir):
        return fl.filter_location(typed(spark, sf_dir), place).select("posting_id", "location")


_location_query("usa", f"""(location IS NULL OR coalesce(remote_type = 'Remote', false) OR {s.has('lower(location)',
    'united states|(^|[^a-z])usa?($|[^a-z])|, *(' + '|'.join(PL.US_STATES.values()) + ')( +(usa?|united states))? *$')})""")
_location_query("texas", _place("texas", "tx", "TX"))
_location_query("ca", _place("california", "ca", "CA"))
_location_query("canada", _place("canada"))
_location_query("new york", _place("new york", "ny", "NY"))
_location_query("uk", _place("united kingdom|england", "uk"))
_location_query("remote", "location IS NULL OR remote_type = 'Remote'")
_location_query("denver", _place("denver"))


def _mode(mode, modes, words):
    text = "lower(concat_ws(' ', title, description))"
    condition = f"coalesce(lower(remote_type), '') IN ({s.strings(modes)}) OR {s.has(text, s.one_of(words))}"

    @query(f"f3_filter_work_mode_{mode}", _kept(condition, "posting_id, remote_type"))
    def run(spark, sf_dir):
        return fl.filter_work_mode(typed(spark, sf_dir), mode).select("posting_id", "remote_type")


for _spellings, _modes, _words in A.WORK_MODES:
    _mode(_spellings[0], _modes, _words)


@query(
    "f4_filter_salary",
    _kept("coalesce(salary_max >= 60000, true) AND coalesce(salary_min <= 120000, true)", "posting_id, salary_min, salary_max"),
)
def f4(spark, sf_dir):
    return fl.filter_salary(typed(spark, sf_dir), 60000, 120000).select("posting_id", "salary_min", "salary_max")


@query("f5_filter_experience", _kept("coalesce(experience_level = 'Senior', true)", "posting_id, experience_level"))
def f5(spark, sf_dir):
    return fl.filter_experience(typed(spark, sf_dir), "Lead").select("posting_id", "experience_level")


@query("f6_filter_employment", _kept("coalesce(employment_type = 'Full-time', true)", "posting_id, employment_type"))
def f6(spark, sf_dir):
    return fl.filter_employment(typed(spark, sf_dir), "full time").select("posting_id", "employment_type")


_NOW = f"TIMESTAMP '{ex.AS_OF}'"


@query(
    "f7_filter_recency",
    _kept(f"coalesce(floor((epoch({_NOW}) - epoch(posted_at)) / 86400) <= 7, true)", "posting_id, strftime(posted_at, '%Y-%m-%d %H:%M') AS posted_at"),
)
def f7(spark, sf_dir):
    rows = fl.filter_recency(typed(spark, sf_dir), 7)
    return rows.select("posting_id", F.date_format("posted_at", "yyyy-MM-dd HH:mm").alias("posted_at"))


SEARCH = dict(
    location="new york", job_type="office", salary_min=40000, salary_max=150000, employment_type="full-time",
    experience_level="senior", days_old=30,
)
SEARCH_SQL = f"""{_place('new york', 'ny', 'NY')}
    AND (coalesce(lower(remote_type), '') IN ('on-site', 'onsite') OR {s.has("lower(concat_ws(' ', title, description))", 'onsite|on-site|office|in-person')})
    AND coalesce(salary_max >= 40000, true) AND coalesce(salary_min <= 150000, true)
    AND coalesce(employment_type = 'Full-time', true) AND coalesce(experience_level = 'Senior', true)
    AND coalesce(floor((epoch({_NOW}) - epoch(posted_at)) / 86400) <= 30, true)"""


@query("f8_search", _kept(SEARCH_SQL, "posting_id, posting_key"))
def f8(spark, sf_dir):
    return fl.search(typed(spark, sf_dir), **SEARCH).select("posting_id", "posting_key")


def url_sql(x: str) -> str:
    u = f"lower({x})"
    words = "|".join(U.NUMBERED_PATHS)
    ends = "|".join(s.literal(e) for e in U.BARE_ENDINGS)
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN true
        WHEN {s.has(u, s.one_of(U.BLOCKED_FRAGMENTS))} THEN false
        WHEN {s.has(u, s.one_of(U.CATEGORY_FRAGMENTS))} THEN false
        WHEN instr({u}, '/c/') > 0 AND instr({u}, '-jobs') > 0 THEN false
        WHEN instr({u}, '/pages/careers') > 0 AND len(string_split({u}, '/')) > 4 AND NOT {s.has(u, '/jobs?/')} THEN false
        WHEN {s.has(u, s.one_of(U.SEARCH_FRAGMENTS))} AND NOT {s.has(u, s.one_of(U.SEARCH_ID_MARKS))} THEN false
        WHEN {s.has(u, f'/({words})/[0-9]+')} THEN true
        WHEN {s.has(u, '/jobs?/[^/]+')} AND NOT {s.has(u, '/jobs?/?$')} THEN true
        WHEN {s.has(u, '/careers/?$')} THEN false
        WHEN {s.has(u, f'({ends})/?$')} AND len(string_split(rtrim({x}, '/'), '/')) <= 2 THEN false
        ELSE true END"""


@query("f9_classify_url", f"WITH {s.POSTINGS} SELECT posting_id, {url_sql('url')} AS is_job_url FROM postings")
def f9(spark, sf_dir):
    return fl.classify_url(fx.postings(spark, sf_dir)).select("posting_id", "is_job_url")


@query("f9_classify_page_url", f"SELECT page_id, {url_sql('url')} AS is_job_url FROM pages")
def f9_pages(spark, sf_dir):
    return fl.classify_url(fx.table(spark, sf_dir, "pages")).select("page_id", "is_job_url")


@query("f10_classify_title", f"WITH {s.POSTINGS} SELECT posting_id, {title_sql('title')} AS is_job_title FROM postings")
def f10(spark, sf_dir):
    return fl.classify_title(fx.postings(spark, sf_dir)).select("posting_id", "is_job_title")


_FIRST_LINE = "string_split(text, chr(10))[1]"


@query("f10_classify_line", f"SELECT doc_id, {title_sql(_FIRST_LINE)} AS is_job_title FROM documents")
def f10_lines(spark, sf_dir):
    lines = fx.spread(fx.table(spark, sf_dir, "documents")).withColumn("title", F.get(F.split("text", "\n"), 0))
    return fl.classify_title(lines).select("doc_id", "is_job_title")


_T = s.strip("title")
REASON_SQL = f"""CASE WHEN length({_T}) NOT BETWEEN 3 AND 200 THEN 'title length'
    WHEN {s.has(f'lower({_T})', '^[0-9]+[ ]*jobs?$|[(]?[0-9]+[ ]*jobs?[)]?$')} THEN 'job count'
    WHEN coalesce(url, '') <> '' AND lower({_T}) IN ({s.strings(TT.REJECTED_WITH_URL)}) THEN 'navigation title'
    WHEN coalesce(url, '') = '' AND lower({_T}) IN ({s.strings(TT.REJECTED_WITHOUT_URL)}) THEN 'navigation title'
    WHEN coalesce(url, '') = '' AND {s.words(_T)} < 2 THEN 'single word without url' END"""
_D = "lower(coalesce(description, ''))"
STRICT_SQL = f"""CASE WHEN {_D} <> '' AND lower({s.clean('description')}) = lower({s.clean('title')}) THEN 'description repeats title'
    WHEN {s.has(_D, s.one_of(TT.CATEGORY_TEXT))} AND {s.has(_D, s.one_of(TT.CATEGORY_COUNT_TEXT))} THEN 'category text'
    WHEN instr({_D}, 'view all') > 0 AND {s.words(_D)} < {TT.PRODUCT_TEXT_MAX_WORDS} THEN 'product text'
    WHEN {s.has(_D, s.one_of(TT.CONTENT_TEXT))} THEN 'content text'
    WHEN {s.has(_D, s.one_of(TT.SERVICE_TEXT))} THEN 'service text'
    WHEN {s.has(_D, s.one_of(TT.MARKETING_TEXT))} AND NOT {s.has(_D, s.one_of(TT.JOB_DETAIL_TEXT))} THEN 'marketing text'
    WHEN {s.has('lower(title)', '[ ][(][0-9]+[ ]*jobs?[)]|[ ][0-9]+[ ]*jobs?$|^[0-9]+[ ]*jobs?$')} THEN 'job count'
    WHEN lower(title) IN ({s.strings(TT.COUNTRY_TITLES)}) THEN 'place title'
    WHEN lower(title) IN ({s.strings(TT.PRODUCT_TITLES)}) THEN 'product title'
    WHEN lower(title) IN ({s.strings(TT.MARKETING_TITLES)}) THEN 'marketing title'
    WHEN lower(title) = 'career opportunities' AND instr({_D}, 'view all') > 0 THEN 'section heading'
    WHEN NOT {s.has('lower(title)', s.one_of(TT.JOB_TITLE_WORDS))} AND {s.has('lower(title)', s.one_of(TT.PRODUCT_TITLE_WORDS))} THEN 'product words' END"""


@query("f11_validate_postings", f"WITH {s.POSTINGS} SELECT posting_id, title, {REASON_SQL} AS reject_reason FROM postings")
def f11(spark, sf_dir):
    return fl.explain_postings(fx.postings(spark, sf_dir)).select("posting_id", "title", "reject_reason")


@query(
    "f12_validate_strict",
    f"WITH {s.POSTINGS} SELECT posting_id, coalesce({REASON_SQL}, {STRICT_SQL}) AS reject_reason FROM postings",
)
def f12(spark, sf_dir):
    return fl.explain_postings(fx.postings(spark, sf_dir), strict=True).select("posting_id", "reject_reason")


_DOC = "(SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS description, CAST(NULL AS VARCHAR) AS url FROM documents)"


@query("f12_validate_documents", f"SELECT doc_id, coalesce({REASON_SQL}, {STRICT_SQL}) AS reject_reason FROM {_DOC}")
def f12_documents(spark, sf_dir):
    docs = fx.spread(fx.table(spark, sf_dir, "documents")).select(
        "doc_id", F.get(F.split("text", "\n"), 0).alias("title"), F.col("text").alias("description"),
        F.lit(None).cast("string").alias("url"),
    )
    return fl.explain_postings(docs, strict=True).select("doc_id", "reject_reason")


@query("f13_filter_cards", f"WITH {s.POSTINGS} SELECT posting_id AS page_id FROM postings")
def f13(spark, sf_dir):
    card = F.regexp_extract("html", r"(?s)(<div data-jk.*?</span></div>)", 1)
    return fl.filter_cards(fx.posting_pages(spark, sf_dir).select("page_id", card.alias("html"))).select("page_id")


_SHOWN = "lower(text)"


@query(
    "f14_prefilter_elements",
    f"""WITH {s.POSTINGS}, e AS (SELECT posting_id, title || ' ' || coalesce(employment_text, '') AS text FROM postings)
        SELECT posting_id FROM e WHERE NOT ({s.has(_SHOWN, s.one_of(R.HEADER_MARKS))} AND len(string_split({_SHOWN}, chr(10))) < 3)
          AND length({_SHOWN}) >= 10 AND ({s.has(_SHOWN, s.one_of(R.ELEMENT_JOB_MARKS))} OR length({_SHOWN}) >= 30)""",
)
def f14(spark, sf_dir):
    text = F.concat("title", F.lit(" "), F.coalesce("employment_text", F.lit("")))
    return fl.prefilter_elements(fx.postings(spark, sf_dir).withColumn("text", text)).select("posting_id")


# --- joins ---------------------------------------------------------------------------------

_BOARD_URL = """CASE posting_id % 9 WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' WHEN 1 THEN 'https://jobs.lever.co/acme/'
    WHEN 2 THEN 'https://acme.wd1.myworkdayjobs.com/en-US/' WHEN 3 THEN 'https://acme.bamboohr.com/careers/' WHEN 4 THEN 'https://acme.ultipro.com/'
    WHEN 5 THEN 'https://Jobs.AshbyHQ.com/acme/' WHEN 6 THEN 'https://apply.workable.com/acme/j/' WHEN 7 THEN NULL
    ELSE 'https://acme-corp.example.org/careers/' END || CAST(posting_id AS STRING)"""


def _board_sql(rows, column, default="NULL"):
    arms = " ".join(f"WHEN instr(lower(url), {s.q(r[1])}) > 0 THEN {s.q(r[column])}" for r in rows)
    return f"CASE {arms} ELSE {default} END"


@query(
    "j1_join_boards",
    f"""WITH {s.POSTINGS}, u AS (SELECT posting_id, {_BOARD_URL} AS url FROM postings)
        SELECT posting_id, {_board_sql(U.BOARDS, 0)} AS board, {_board_sql(U.PLATFORMS, 0)} AS platform,
          {_board_sql(U.PLATFORMS, 2, "'direct_listing'")} AS page_type, {_board_sql(U.PLATFORMS, 3, "'none'")} AS pagination_type FROM u""",
)
def j1(spark, sf_dir):
    urls = fx.postings(spark, sf_dir).select("posting_id", F.expr(_BOARD_URL).alias("url"))
    return jn.join_boards(urls).drop("url")


def _values(rows) -> str:
    return ", ".join("(" + s.strings(r) + ")" for r in rows)


@query(
    "j2_join_location_alias",
    f"""WITH {s.POSTINGS}, dim(spelling, kind, canonical, words) AS (VALUES {_values([(a, k, c, '|'.join(w)) for a, k, c, w in PL.alias_rows()])}),
        parts AS (SELECT posting_id, unnest(string_split(location, ',')) AS part FROM postings)
        SELECT posting_id, trim(part) AS part, kind, canonical, words FROM parts LEFT JOIN dim ON lower(trim(part)) = spelling""",
)
def j2(spark, sf_dir):
    parts = fx.postings(spark, sf_dir).select("posting_id", F.explode(F.split("location", ",")).alias("part"))
    joined = jn.join_location_alias(parts.withColumn("part", F.trim("part")), "part")
    return joined.withColumn("words", F.array_join("words", "|"))


@query(
    "j3_join_level_alias",
    f"""WITH {s.POSTINGS}, levels(spelling, level) AS (VALUES {_values(A.EXPERIENCE_ROWS)}), kinds(spelling, employment) AS (VALUES {_values(A.EMPLOYMENT_ROWS)})
        SELECT posting_id, level, employment FROM postings LEFT JOIN levels ON lower(string_split(title, ' ')[1]) = levels.spelling
        LEFT JOIN kinds ON lower(trim(employment_text)) = kinds.spelling""",
)
def j3(spark, sf_dir):
    df = fx.postings(spark, sf_dir).withColumn("first_word", F.get(F.split("title", " "), 0))
    df = df.transform(jn.join_level_alias, "first_word").transform(jn.join_employment_alias)
    return df.select("posting_id", "level", "employment")


_DETAIL_TEXT = (
    "description || ' We are a team that ships every week and cares about craft, people and calm on-call shifts. '"
    " || 'Must have: curiosity about ' || coalesce(location, 'remote') || ' customers.'"
)


@query(
    "j4_enrich_details",
    f"""WITH {TYPED}, raw AS (SELECT *, {_DETAIL_TEXT} AS detail_text, row_number() OVER (PARTITION BY url ORDER BY query_id, page_no, posting_id) AS rn
          FROM typed WHERE url IS NOT NULL),
        details AS (SELECT url, detail_text, {INDUSTRY_SQL.replace('description', 'detail_text')} AS industry, {SIZE_SQL.replace('description', 'detail_text')} AS company_size,
          {skills_sql('detail_text')} AS skills, {requirements_sql('detail_text')} AS requirements,
          coalesce(employment_type, 'Full-time') AS employment_type FROM raw WHERE rn = 1)
        SELECT posting_id, coalesce(t.employment_type, d.employment_type) AS employment_type, d.industry, d.company_size,
          CASE WHEN length(d.detail_text) > 100 THEN d.detail_text ELSE t.description END AS description,
          array_to_string(CASE WHEN len(t.requirements) = 0 AND len(d.requirements) > 0 THEN d.requirements ELSE t.requirements END, '|') AS requirements,
          array_to_string(CASE WHEN len({skills_sql('t.description')}) < 3 AND len(d.skills) > 0 THEN d.skills ELSE {skills_sql('t.description')} END, '|') AS skills
        FROM typed t LEFT JOIN details d ON t.url = d.url""",
)
def j4(spark, sf_dir):
    rows = typed(spark, sf_dir)
    first = jn.latest_details(rows, "url", ARRIVAL).withColumn("description", F.expr(_DETAIL_TEXT))
    details = (
        first.transform(ex.with_industry, "description")
        .transform(ex.with_company_size, "description")
        .transform(ex.with_skills, limit=None)
        .transform(ex.with_requirements, "description")
        .select(
            "url", "description", "industry", "company_size", "skills", "requirements",
            F.coalesce("employment_type", F.lit("Full-time")).alias("employment_type"),
        )
    )
    listed = rows.withColumns({"industry": F.lit(None).cast("string"), "company_size": F.lit(None).cast("string")})
    return jn.enrich_details(listed, details).select(
        "posting_id", "employment_type", "industry", "company_size", "description",
        F.array_join("requirements", "|").alias("requirements"), F.array_join("skills", "|").alias("skills"),
    )


def _lexicon_sql(source, id_col, text):
    """Every text against every term: the twin may be slow where the query must not be."""
    padded = s.sub(f"lower({text})", r"[^\p{L}\p{N}_+#./]+", " ")
    padded = s.sub(f"' ' || {padded} || ' '", r"([./]+) ", " ")
    padded = s.sub(padded, r" ([./]+)", " ")
    padded = s.sub(padded, r" +", " ")
    return f"""lex(term, shown) AS (VALUES {_values(L.SKILLS)}), padded AS (SELECT {id_col}, {padded} AS p FROM {source})
        SELECT {id_col}, array_to_string(list_sort(list(shown)), '|') AS terms FROM padded JOIN lex ON instr(p, ' ' || term || ' ') > 0 GROUP BY {id_col}"""


@query("j5_match_lexicon", f"WITH {_lexicon_sql('documents', 'doc_id', 'text')}")
def j5(spark, sf_dir):
    docs = fx.spread(fx.table(spark, sf_dir, "documents")).select("doc_id", "text")
    hits = jn.match_lexicon(docs, "doc_id", "text", jn.skills_dim(spark))
    return hits.withColumn("terms", F.array_join("terms", "|"))


@query("j5_match_lexicon_postings", f"WITH {s.POSTINGS}, {_lexicon_sql('postings', 'posting_id', 'description')}")
def j5_postings(spark, sf_dir):
    rows = fx.postings(spark, sf_dir).select("posting_id", "description")
    hits = jn.match_lexicon(rows, "posting_id", "description", jn.skills_dim(spark))
    return hits.withColumn("terms", F.array_join("terms", "|"))


_EARLIER = "1996-01-01"


@query(
    "j6_anti_seen",
    f"""WITH {TYPED} SELECT posting_id, posting_key FROM typed t WHERE fetched_at >= TIMESTAMP '{_EARLIER}' AND NOT EXISTS
        (SELECT 1 FROM typed e WHERE e.fetched_at < TIMESTAMP '{_EARLIER}' AND e.posting_key = t.posting_key)""",
)
def j6(spark, sf_dir):
    rows, cut = typed(spark, sf_dir), F.lit(_EARLIER).cast("timestamp_ntz")
    seen = rows.filter(F.col("fetched_at") < cut)
    return jn.anti_seen(rows.filter(F.col("fetched_at") >= cut), seen).select("posting_id", "posting_key")


TTL = 86_400
# Fixed TTL per key, followed request by request.
TTL_SQL = f"""RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, ts, rn, false AS is_hit, ts AS stored_at FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.event_id, r.ts, r.rn, epoch_us(r.ts) - epoch_us(f.stored_at) <= {TTL}000000,
        CASE WHEN epoch_us(r.ts) - epoch_us(f.stored_at) <= {TTL}000000 THEN f.stored_at ELSE r.ts END
      FROM r JOIN f ON r.user_id = f.user_id AND r.rn = f.rn + 1)"""
TTL_TWIN = f"WITH {TTL_SQL} SELECT user_id, event_id, is_hit, epoch_us(stored_at) AS stored_us FROM f"


def micros(c):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def _lookups(spark, sf_dir, **options):
    events = fx.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return jn.ttl_lookup(events, "user_id", TTL, **options)


@query("j7_ttl_lookup", TTL_TWIN)
def j7(spark, sf_dir):
    return _lookups(spark, sf_dir).select("user_id", "event_id", "is_hit", micros(F.col("stored_at")).alias("stored_us"))


@query("j7_ttl_lookup_long_keys", TTL_TWIN)
def j7_long(spark, sf_dir):
    """Every key treated as too long to fold."""
    rows = _lookups(spark, sf_dir, fold_limit=0)
    return rows.select("user_id", "event_id", "is_hit", micros(F.col("stored_at")).alias("stored_us"))


_EMPTY_TWIN = f"""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, event_type = 'signup' AS none,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, false AS is_hit, ts AS stored_at, CASE WHEN NOT none THEN ts END AS good FROM r WHERE rn = 1
      UNION ALL SELECT user_id, event_id, rn, hit, CASE WHEN hit THEN good ELSE ts END, CASE WHEN hit THEN good WHEN NOT none THEN ts END FROM
        (SELECT r.*, f.good, coalesce(epoch_us(r.ts) - epoch_us(f.good) <= {TTL}000000, false) AS hit FROM r JOIN f ON r.user_id = f.user_id AND r.rn = f.rn + 1))
    SELECT user_id, event_id, is_hit, epoch_us(stored_at) AS stored_us FROM f"""


@query("j7_ttl_lookup_empty_results", _EMPTY_TWIN)
def j7_empty(spark, sf_dir):
    """Sign-ups give an empty result; keys with more than 50 requests count as long."""
    events = fx.table(spark, sf_dir, "events").withColumn("none", F.col("event_type") == "signup")
    rows = jn.ttl_lookup(events, "user_id", TTL, empty="none", fold_limit=50)
    return rows.select("user_id", "event_id", "is_hit", micros(F.col("stored_at")).alias("stored_us"))


@query(
    "j8_with_fallback",
    f"""WITH {s.POSTINGS} SELECT posting_id, source, query_id, page_no FROM postings WHERE source = 'board_a' UNION ALL
        SELECT posting_id, source, query_id, page_no FROM postings s WHERE source = 'career_page' AND NOT EXISTS
        (SELECT 1 FROM postings p WHERE p.source = 'board_a' AND p.company = s.company AND p.title = s.title)""",
)
def j8(spark, sf_dir):
    rows = fx.postings(spark, sf_dir)
    primary, secondary = rows.filter("source = 'board_a'"), rows.filter("source = 'career_page'")
    return jn.with_fallback(primary, secondary, ["company", "title"]).select("posting_id", "source", "query_id", "page_no")


# Searches of this table: the key is coarse, so that pages repeat earlier postings.
_COARSE = "title || '|' || coalesce(company, '')"
_FLAGS_SQL = f"""base AS (SELECT posting_id, query_id, page_no, {_COARSE} AS posting_key, url IS NOT NULL AS fits FROM postings),
    firsts AS (SELECT *, min(page_no) OVER (PARTITION BY query_id, posting_key) AS first_page,
      row_number() OVER (PARTITION BY query_id, page_no ORDER BY posting_id) AS rn FROM base),
    flags AS (SELECT query_id, page_no, count(*) AS n_rows, count(DISTINCT posting_key) FILTER (WHERE rn <= 5) AS n_leading,
      bool_and(first_page < page_no) FILTER (WHERE rn <= 5) AS all_seen,
      count(DISTINCT posting_key) FILTER (WHERE fits AND first_page = page_no) AS n_new FROM firsts GROUP BY query_id, page_no)"""


def _searches(spark, sf_dir):
    return fx.postings(spark, sf_dir).withColumn("posting_key", F.expr(_COARSE))


@query("j9_page_flags", f"WITH {s.POSTINGS}, {_FLAGS_SQL} SELECT * FROM flags")
def j9_flags(spark, sf_dir):
    return wn.page_flags(_searches(spark, sf_dir), ["posting_id"], F.expr("url IS NOT NULL"))


_TITLE_FLAGS = _FLAGS_SQL.replace(_COARSE, "title")


@query("j9_duplicate_pages", f"WITH {s.POSTINGS}, {_TITLE_FLAGS} SELECT query_id, page_no, n_leading FROM flags WHERE all_seen")
def j9(spark, sf_dir):
    return wn.duplicate_pages(fx.postings(spark, sf_dir), ["posting_id"], key="title")


# --- windows -------------------------------------------------------------------------------

@query(
    "w1_dedup_first",
    f"""WITH {TYPED} SELECT posting_id, posting_key FROM (SELECT *, row_number() OVER (PARTITION BY posting_key ORDER BY query_id, page_no, posting_id) AS rn
        FROM typed) WHERE rn = 1""",
)
def w1(spark, sf_dir):
    return wn.dedup_first(typed(spark, sf_dir), ["posting_key"], ARRIVAL).select("posting_id", "posting_key")


@query(
    "w1_dedup_titles",
    f"""WITH {s.POSTINGS} SELECT posting_id, title, company FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(company)
        ORDER BY query_id, page_no, posting_id) AS rn FROM postings) WHERE rn = 1""",
)
def w1_titles(spark, sf_dir):
    return wn.dedup_titles(fx.postings(spark, sf_dir), ARRIVAL).select("posting_id", "title", "company")


@query(
    "w1_dedup_documents",
    """SELECT doc_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def w1_documents(spark, sf_dir):
    docs = wn.dedup_text_start(fx.spread(fx.table(spark, sf_dir, "documents")), "text", ["doc_id"])
    return docs.select("doc_id", F.md5("text").alias("text_md5"))


def _cap_sql(n, total):
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_no, posting_id) AS rn FROM postings),
    counts AS (SELECT query_id, least(count(*), {n}) AS n FROM ranked GROUP BY query_id),
    befores AS (SELECT query_id, coalesce(sum(n) OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
    capped AS (SELECT r.* FROM ranked r JOIN befores USING (query_id) WHERE rn <= least({n}, {total} - before))"""


_DEDUP = """SELECT posting_id, query_id, title, company FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(company)
    ORDER BY query_id, page_no, posting_id) AS d FROM {}) WHERE d = 1"""


@query("w2_cap_per_url", f"WITH {s.POSTINGS}, {_cap_sql(20, 330)} {_DEDUP.format('capped')}")
def w2(spark, sf_dir):
    capped = wn.cap_per_url(fx.postings(spark, sf_dir), "query_id", ["page_no", "posting_id"], 20, 330)
    return capped.select("posting_id", "query_id", "title", "company")


@query(
    "w2_cap_per_url_dedup_first",
    f"""WITH raw AS (WITH {s.POSTINGS} SELECT * FROM postings), postings AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(company)
        ORDER BY query_id, page_no, posting_id) AS d FROM raw) WHERE d = 1), {_cap_sql(15, 100)} SELECT posting_id, query_id FROM capped""",
)
def w2_dedup_first(spark, sf_dir):
    capped = wn.cap_per_url(fx.postings(spark, sf_dir), "query_id", ["page_no", "posting_id"], 15, 100, dedup_before_cap=True)
    return capped.select("posting_id", "query_id")


@query(
    "w3_cut_pages",
    f"""WITH {s.POSTINGS}, {_FLAGS_SQL}, stops AS (SELECT query_id, page_no FROM flags WHERE all_seen OR (n_leading <= 2 AND page_no > 1) OR n_new = 0
          UNION ALL SELECT query_id, page_no + 1 FROM flags f WHERE NOT EXISTS (SELECT 1 FROM flags g WHERE g.query_id = f.query_id AND g.page_no = f.page_no + 1)
          UNION ALL SELECT 3, 4),
        first_stop AS (SELECT query_id, min(page_no) AS stop FROM stops GROUP BY query_id)
        SELECT posting_id, b.query_id, page_no FROM base b JOIN first_stop f ON b.query_id = f.query_id WHERE page_no < stop""",
)
def w3(spark, sf_dir):
    rows = _searches(spark, sf_dir)
    marks = rows.select("query_id", "page_no", F.expr("query_id = 3 AND page_no = 4").alias("is_end")).distinct()
    cut = wn.cut_pages(rows, ["posting_id"], F.expr("url IS NOT NULL"), marks)
    return cut.select("posting_id", "query_id", "page_no")


STREAK_SQL = """marked AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok,
      sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    streaks AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM marked)"""


def _source_events(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))


STREAK_TWIN = f"WITH {STREAK_SQL} SELECT event_id, user_id, streak, streak < 3 AS healthy FROM streaks"


@query("w4_failure_streak", STREAK_TWIN)
def w4(spark, sf_dir):
    rows = wn.failure_streak(_source_events(spark, sf_dir), "user_id", ["ts", "event_id"])
    return rows.select("event_id", "user_id", "streak", "healthy")


# --- limits and unions ---------------------------------------------------------------------

@query("l1_limit_results", f"WITH {s.POSTINGS} SELECT posting_id, query_id, page_no FROM postings ORDER BY query_id, page_no, posting_id LIMIT 20")
def l1(spark, sf_dir):
    return lm.limit_results(fx.postings(spark, sf_dir), 20, ARRIVAL).select("posting_id", "query_id", "page_no")


@query("l2_prefer_linked", f"WITH {s.POSTINGS} SELECT posting_id, url FROM postings ORDER BY coalesce(url, '') <> '' DESC, posting_id")
def l2(spark, sf_dir):
    return lm.prefer_linked(fx.postings(spark, sf_dir), order=["posting_id"]).select("posting_id", "url")


_MANY = "description || ' Python, Java, Go, Rust, Docker, AWS, Azure, Git, SQL, Linux, CSS, PHP. Dental, vision, 401k, PTO, bonus, training, vacation, retirement, stock options.'"


@query(
    "l3_cap_arrays",
    f"""WITH {s.POSTINGS}, m AS (SELECT posting_id, {_MANY} AS t FROM postings)
        SELECT posting_id, array_to_string({skills_sql('t')}[1:10], '|') AS skills, array_to_string({phrases_sql('t', L.BENEFITS)}[1:8], '|') AS benefits FROM m""",
)
def l3(spark, sf_dir):
    rows = fx.postings(spark, sf_dir).withColumn("t", F.expr(_MANY))
    rows = rows.transform(ex.with_skills, "t", limit=None).transform(ex.with_benefits, "t", limit=None)
    return lm.cap_arrays(rows).select(
        "posting_id", F.array_join("skills", "|").alias("skills"), F.array_join("benefits", "|").alias("benefits")
    )


@query(
    "u1_union_sources",
    f"""WITH {s.POSTINGS} SELECT posting_id, title, location, url FROM postings WHERE source = 'board_a'
        UNION ALL SELECT posting_id, title, NULL, url FROM postings WHERE source = 'board_b'
        UNION ALL SELECT posting_id, title, location, NULL FROM postings WHERE source = 'career_page'""",
)
def u1(spark, sf_dir):
    rows = fx.postings(spark, sf_dir)
    return st.union_sources(
        rows.filter("source = 'board_a'").select("posting_id", "title", "location", "url"),
        rows.filter("source = 'board_b'").select("posting_id", "title", "url"),
        rows.filter("source = 'career_page'").select("posting_id", "title", "location"),
    )


@query(
    "u2_union_paths",
    f"""WITH {s.POSTINGS}, both_paths AS (SELECT 0 AS path_no, * FROM postings WHERE source = 'board_b' UNION ALL SELECT 1, * FROM postings WHERE source = 'career_page'),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY title, company ORDER BY path_no, posting_id) AS rn FROM both_paths)
        SELECT posting_id, source, path_no FROM firsts WHERE rn = 1 ORDER BY path_no, posting_id LIMIT 400""",
)
def u2(spark, sf_dir):
    rows = fx.postings(spark, sf_dir)
    api, html = rows.filter("source = 'board_b'"), rows.filter("source = 'career_page'")
    return st.union_paths(api, html, ["title", "company"], ["posting_id"], 400).select("posting_id", "source", "path_no")


# --- reports -------------------------------------------------------------------------------

@query(
    "a1_run_summary",
    f"""WITH {TYPED}, flagged AS (SELECT query_id, posting_id, page_no, location, ({SEARCH_SQL}) AS k FROM typed),
        samples AS (SELECT query_id, array_to_string(list(coalesce(location, 'none') ORDER BY rn), '|') AS rejected_locations FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_no, posting_id) AS rn FROM flagged WHERE NOT k) WHERE rn <= 5 GROUP BY query_id)
        SELECT f.query_id, count(*) AS found, count(*) FILTER (WHERE k) AS kept, any_value(rejected_locations) AS rejected_locations
        FROM flagged f LEFT JOIN samples s ON f.query_id = s.query_id GROUP BY f.query_id""",
)
def a1(spark, sf_dir):
    rows = typed(spark, sf_dir)
    return ag.run_summary(rows, ["query_id"], fl.search_condition(rows, **SEARCH), ["page_no", "posting_id"])


_RUNS = """runs AS (SELECT 'https://site-' || CAST(user_id AS STRING) || '.example.com/careers' AS url, event_type <> 'error' AS success,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_type FROM events)"""


@query(
    "a2_url_report",
    f"""WITH {_RUNS} SELECT count(*) AS total_urls, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
        round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate, CAST(sum(CASE WHEN success THEN k ELSE 0 END) AS BIGINT) AS total_jobs_found,
        round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 1) AS average_time_seconds,
        (SELECT url FROM runs WHERE success ORDER BY CAST(value AS DECIMAL(18,4)), url LIMIT 1) AS fastest_url,
        (SELECT url FROM runs WHERE success ORDER BY CAST(value AS DECIMAL(18,4)) DESC, url DESC LIMIT 1) AS slowest_url FROM runs""",
)
def a2(spark, sf_dir):
    return ag.url_report(fx.page_runs(spark, sf_dir))


@query(
    "a3_crawl_metadata",
    f"""WITH {_RUNS} SELECT url, CAST(sum(CASE WHEN success THEN k ELSE 0 END) AS BIGINT) AS total_jobs, count(*) AS pages_scraped,
        round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate, count(*) FILTER (WHERE NOT success) AS n_errors,
        count(*) FILTER (WHERE event_type = 'view') AS n_warnings, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS time_taken FROM runs GROUP BY url""",
)
def a3(spark, sf_dir):
    return ag.crawl_metadata(fx.page_runs(spark, sf_dir))


@query(
    "a3_crawl_messages",
    f"""WITH {_RUNS} SELECT url, 'error' AS level, 'failed with code ' || CAST(k % 7 AS STRING) AS message, count(*) AS n FROM runs WHERE NOT success GROUP BY ALL
        UNION ALL SELECT url, 'warning', 'no link on the page', count(*) FROM runs WHERE event_type = 'view' GROUP BY ALL""",
)
def a3_messages(spark, sf_dir):
    return ag.crawl_messages(fx.page_runs(spark, sf_dir))


@query("a4_distinct_values", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a4(spark, sf_dir):
    return ag.distinct_values(fx.spread(fx.table(spark, sf_dir, "documents")), "lang")


@query(
    "a4_distinct_skills",
    f"""WITH {s.POSTINGS}, k AS (SELECT posting_id, unnest(list_distinct({skills_sql('description')}[1:10])) AS skills FROM postings)
        SELECT skills, count(*) AS n FROM k GROUP BY skills""",
)
def a4_skills(spark, sf_dir):
    return ag.distinct_values(ex.with_skills(fx.postings(spark, sf_dir)), "skills")


_FIELDS = ["title", "company", "location", "salary_text", "employment_text", "posted_text", "url"]


@query(
    "a5_field_completeness",
    f"WITH {s.POSTINGS} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE coalesce({f}, '') <> '') AS n_filled,"
        f" round(count(*) FILTER (WHERE coalesce({f}, '') <> '') / count(*), 6) AS share FROM postings"
        for f in _FIELDS
    ),
)
def a5(spark, sf_dir):
    return ag.field_completeness(fx.postings(spark, sf_dir), _FIELDS)


@query(
    "a6_cache_hit_rate",
    f"""WITH {TTL_SQL} SELECT count(*) AS requests, count(*) FILTER (WHERE is_hit) AS hits, round(count(*) FILTER (WHERE is_hit) / count(*), 6) AS hit_rate FROM f""",
)
def a6(spark, sf_dir):
    return ag.cache_hit_rate(_lookups(spark, sf_dir))


HEALTH_TWIN = f"""WITH {STREAK_SQL} SELECT user_id, arg_max(streak, (ts, event_id)) AS failures, arg_max(streak, (ts, event_id)) < 3 AS healthy,
    max(streak) AS worst_streak, count(*) AS n_events FROM streaks GROUP BY user_id"""


@query("a7_source_health", HEALTH_TWIN)
def a7(spark, sf_dir):
    return ag.source_health(_source_events(spark, sf_dir), "user_id", ["ts", "event_id"])


@query(
    "a8_reject_report",
    f"""WITH {s.POSTINGS}, r AS (SELECT title, coalesce({REASON_SQL}, {STRICT_SQL}) AS reject_reason FROM postings)
        SELECT reject_reason, title, count(*) AS n FROM r WHERE reject_reason IS NOT NULL GROUP BY reject_reason, title""",
)
def a8(spark, sf_dir):
    return ag.reject_report(fl.explain_postings(fx.postings(spark, sf_dir), strict=True))
