"""Joins, windows, filters and reports against plain Python, with hot groups in the data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideboard.functions import posting as X
from tideboard.operators import aggregates as ag
from tideboard.operators import extract as ex
from tideboard.operators import filters as fl
from tideboard.operators import joins as jn
from tideboard.operators import limits as lm
from tideboard.operators import sets as st
from tideboard.operators import windows as wn

T0 = dt.datetime(2024, 1, 1)


# --- cache lookup --------------------------------------------------------------------------

def cache_by_hand(requests, ttl):
    """{(key, tie): (hit, stored second)} for (key, second, tie, empty) rows."""
    out, cache = {}, {}
    for key, second, tie, empty in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        good = cache.get(key)
        hit = good is not None and second - good <= ttl
        out[key, tie] = (hit, good if hit else second)
        if not hit:
            cache[key] = None if empty else second
    return out


@pytest.mark.parametrize("fold_limit, chunks", [(10_000, None), (0, 1), (0, 13), (50, None)])
def test_ttl_lookup(spark, fold_limit, chunks):
    rng = random.Random(5)
    requests = [(0, rng.randrange(0, 4000), i, rng.random() < 0.1) for i in range(400)]  # one key has most rows
    requests += [(rng.randrange(1, 8), rng.randrange(0, 100_000), 1000 + i, rng.random() < 0.2) for i in range(200)]
    requests += [(9, 60 * i, 3000 + i, False) for i in range(100)]  # exactly one TTL apart: still hits
    rows = [(k, T0 + dt.timedelta(seconds=s), i, e) for k, s, i, e in requests]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, event_id bigint, none boolean")
    got = jn.ttl_lookup(df, "k", 60, empty="none", fold_limit=fold_limit, chunks=chunks).collect()
    assert {(r.k, r.event_id): (r.is_hit, (r.stored_at - T0).total_seconds()) for r in got} == cache_by_hand(requests, 60)
    rate = ag.cache_hit_rate(jn.ttl_lookup(df, "k", 60, empty="none")).collect()[0]
    assert (rate.requests, rate.hits) == (len(requests), sum(h for h, _ in cache_by_hand(requests, 60).values()))


# --- streaks -------------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"chunks": 7}, {"chunks": 40}])
def test_failure_streak(spark, options):
    rng = random.Random(7)
    # Most events of the hot source fall on a few instants.
    events = [("hot", rng.choice([5, 5, rng.randrange(0, 3000)]), i, rng.random() < 0.25) for i in range(600)]
    events += [(None, rng.randrange(0, 3000), 2000 + i, rng.random() < 0.3) for i in range(300)]
    events += [(f"s{i % 5}", rng.randrange(0, 3000), 1000 + i, rng.random() < 0.5) for i in range(200)]
    want, open_streak = {}, {}
    for source, second, i, ok in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        open_streak[source] = 0 if ok else open_streak.get(source, 0) + 1
        want[i] = open_streak[source]
    rows = [(s, T0 + dt.timedelta(seconds=t), i, ok) for s, t, i, ok in events]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, event_id bigint, ok boolean")
    got = wn.failure_streak(df, "source", ["ts", "event_id"], **options).collect()
    assert {r.event_id: r.streak for r in got} == want
    assert all(r.healthy == (r.streak < 3) for r in got)
    health = {r.source: r for r in ag.source_health(df, "source", ["ts", "event_id"], **options).collect()}
    assert {s: r.failures for s, r in health.items()} == open_streak
    assert health["hot"].worst_streak == max(want[e[2]] for e in events if e[0] == "hot")


# --- first wins, caps, totals --------------------------------------------------------------

def listings(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = 0 if i % 3 == 0 else rng.randrange(1, 40)
        rows.append((url, i, f"T{rng.randrange(60)}", rng.choice(["Acme", "ACME", "Beta", None])))
    return rows


LISTING = "url_ord bigint, pos bigint, title string, company string"


def first_per_key(rows, key):
    seen, out = set(), []
    for r in rows:
        if key(r) not in seen:
            seen.add(key(r))
            out.append(r)
    return out


def title_key(r):
    return (r[2].lower(), r[3].lower() if r[3] else None)


def test_dedup_first(spark):
    rows = listings()
    df = spark.createDataFrame(rows, LISTING)
    got = {tuple(r) for r in wn.dedup_titles(df, ["url_ord", "pos"]).collect()}
    assert got == set(first_per_key(sorted(rows, key=lambda r: r[:2]), title_key))
    once = wn.dedup_titles(df, ["url_ord", "pos"])
    assert wn.dedup_titles(once, ["url_ord", "pos"]).count() == len(got)


@pytest.mark.parametrize("n", [1, 7, 1200])
def test_first_n_of_hot_groups(spark, n):
    rows = [(0 if i % 2 else i % 5, i, "t", None) for i in range(4000)]
    got = wn.first_n(spark.createDataFrame(rows, LISTING), ["url_ord"], ["pos"], n).collect()
    want = []
    for url in range(5):
        want += sorted(r for r in rows if r[0] == url)[:n]
    assert sorted((r.url_ord, r.pos) for r in got) == sorted(r[:2] for r in want)


@pytest.mark.parametrize("n, total, dedup_first", [(20, 330, False), (20, None, False), (5, 12, False), (20, 50, True), (2000, 2500, False)])
def test_cap_per_url(spark, n, total, dedup_first):
    rows = sorted(listings(), key=lambda r: r[:2])
    kept = []
    for url in sorted({r[0] for r in rows}):
        source = first_per_key(rows, title_key) if dedup_first else rows
        room = n if total is None else min(n, total - len(kept))
        kept += [r for r in source if r[0] == url][: max(room, 0)]
    want = kept if dedup_first else first_per_key(kept, title_key)
    df = spark.createDataFrame(rows, LISTING)
    got = wn.cap_per_url(df, "url_ord", ["pos"], n, total, dedup_before_cap=dedup_first).collect()
    assert sorted(tuple(r)[:2] for r in got) == sorted(r[:2] for r in want)


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([(i, i % 7 + 1) for i in range(0, 500, 3)], "p bigint, v bigint")
    got = {r.p: r.t for r in wn.running_total(df, "p", "v", "t", block=20).collect()}
    total, want = 0, {}
    for i in range(0, 500, 3):
        want[i] = total
        total += i % 7 + 1
    assert got == want


# --- page cut ------------------------------------------------------------------------------

def cut_by_hand(rows, ends):
    """Page by page, as a crawler that stops: rows are (query, page, pos, key, fits)."""
    out = []
    for query in {r[0] for r in rows}:
        seen, page = set(), 1
        while True:
            here = sorted(r for r in rows if r[0] == query and r[1] == page)
            leading = {r[3] for r in here[:5]}
            if not here or (query, page) in ends or leading <= seen or (len(leading) <= 2 and page > 1):
                break
            if not any(r[4] and r[3] not in seen for r in here):
                break
            out += here
            seen |= {r[3] for r in here}
            page += 1
    return out


def test_cut_pages(spark):
    rng = random.Random(11)
    rows, pos = [], 0
    for query in range(30):
        for page in range(1, rng.randrange(2, 9)):
            if rng.random() < 0.08:
                continue  # a missing page
            for _ in range(rng.choice([1, 4, 8, 12])):
                rows.append((query, page, pos, f"k{rng.randrange(12)}", rng.random() < 0.6))
                pos += 1
    ends = {(q, 3) for q in range(0, 30, 6)}
    df = spark.createDataFrame(rows, "query_id bigint, page_no bigint, pos bigint, posting_key string, fits boolean")
    marks = spark.createDataFrame([(q, p, True) for q, p in ends], "query_id bigint, page_no bigint, is_end boolean")
    # A search whose first page is missing has no start; the cut takes given pages as they are.
    starts = {r[0] for r in rows if r[1] == 1}
    got = [tuple(r) for r in wn.cut_pages(df, ["pos"], F.col("fits"), marks).collect() if r.query_id in starts]
    assert sorted(got) == sorted(r for r in cut_by_hand(rows, ends) if r[0] in starts)


def test_duplicate_pages(spark):
    rows = [(1, 1, i, f"k{i}") for i in range(6)] + [(1, 2, 10 + i, f"k{i}") for i in range(5)] + [(1, 2, 20, "new")] + [(1, 3, 30, "k0"), (1, 3, 31, "z")]
    df = spark.createDataFrame(rows, "query_id bigint, page_no bigint, pos bigint, posting_key string")
    assert [tuple(r) for r in wn.duplicate_pages(df, ["pos"]).collect()] == [(1, 2, 5)]


# --- joins ---------------------------------------------------------------------------------

def test_enrich_details(spark):
    listed = spark.createDataFrame(
        [(1, "u1", None, "short", ["a"], []), (2, None, None, "d", [], None), (3, "u3", "$1", "d", ["a", "b", "c"], ["r"]), (4, "u9", "", "d", [], [])],
        "id int, url string, salary_range string, description string, skills array<string>, requirements array<string>",
    )
    details = spark.createDataFrame(
        [("u1", "$9", "x" * 101, ["p", "q"], ["need"]), ("u3", "$9", "x" * 100, ["p"], ["need"]), (None, "$0", "y" * 200, ["n"], ["n"])],
        "url string, salary_range string, description string, skills array<string>, requirements array<string>",
    )
    got = {r.id: r for r in jn.enrich_details(listed, details).collect()}
    assert (got[1].salary_range, len(got[1].description), got[1].skills, got[1].requirements) == ("$9", 101, ["p", "q"], ["need"])
    assert (got[2].salary_range, got[2].description, got[2].requirements) == (None, "d", None)
    assert (got[3].salary_range, got[3].description, got[3].skills, got[3].requirements) == ("$1", "d", ["a", "b", "c"], ["r"])
    assert (got[4].salary_range, got[4].skills) == (None, [])
    assert len(got) == 4


def test_match_lexicon(spark):
    texts = [(1, "Machine learning with C++/Go. REST API, node.js."), (2, "machine, and learning"), (3, ""), (4, "we use go."), (5, "go")]
    df = spark.createDataFrame(texts, "id int, text string")
    lexicon = spark.createDataFrame(
        [("machine learning", "ML"), ("go", "Go"), ("node.js", "Node"), ("rest api", "REST"), ("learning", "L"), ("we use go", "Phrase")], "term string, shown string"
    )
    got = {r.id: r.terms for r in jn.match_lexicon(df, "id", "text", lexicon).collect()}
    assert got == {1: ["L", "ML", "Node", "REST"], 2: ["L"], 4: ["Go", "Phrase"], 5: ["Go"]}


def test_anti_seen_and_fallback(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "posting_key string, n int")
    seen = spark.createDataFrame([("a",)] * 50 + [(None,)], "posting_key string")
    assert sorted(r.n for r in jn.anti_seen(new, seen).collect()) == [2, 3]
    first = spark.createDataFrame([("a", 10)], "posting_key string, n int")
    assert sorted(r.n for r in jn.with_fallback(first, new, ["posting_key"]).collect()) == [2, 3, 10]


def test_unions(spark):
    a = spark.createDataFrame([("x", 1)], "title string, pos int")
    b = spark.createDataFrame([("x", 0, "u"), ("y", 5, "u")], "title string, pos int, url string")
    assert st.union_sources(a, b).columns == ["title", "pos", "url"]
    rows = st.union_paths(a, b, ["title"], ["pos"], 5).collect()
    assert [(r.title, r.path_no) for r in rows] == [("x", 0), ("y", 1)]


def test_postings_schema(spark):
    df = st.as_postings(spark.createDataFrame([("t", 7, "x")], "title string, page_no int, other string"))
    assert df.columns[:3] == ["title", "company", "company_url"] and dict(df.dtypes)["skills"] == "array<string>"
    row = df.collect()[0]
    assert (row.title, row.page_no, row.company, row.skills) == ("t", 7, None, None)


def test_place_aliases(spark):
    df = spark.createDataFrame([("NYC ",), ("CA",), ("nowhere",), (None,)], "location string")
    got = [(r.kind, r.canonical) for r in jn.join_location_alias(df).collect()]
    assert sorted(got, key=str) == sorted([("city", "New York, NY"), ("state", "California"), (None, None), (None, None)], key=str)


# --- filters -------------------------------------------------------------------------------

PLACES = ["Chicago, IL US", "Austin, TX", "Austin TX", "San Jose, CA", "Chicago, IL", "London, UK", "Manchester, England", "Remote", None, "Lahore, Pakistan", "Bengaluru, India", "Berlin, DE", "Hybrid remote in Denver, CO"]


@pytest.mark.parametrize(
    "wanted, fits",
    [
        ("usa", {"Chicago, IL US", "Austin, TX", "San Jose, CA", "Chicago, IL", "Berlin, DE", "Hybrid remote in Denver, CO"}),
        ("TX", {"Austin, TX", "Austin TX"}), ("california", {"San Jose, CA"}), ("ca", {"San Jose, CA"}), ("indiana", set()),
        ("UK", {"London, UK", "Manchester, England"}), ("pakistan", {"Lahore, Pakistan"}), ("bangalore", {"Bengaluru, India"}),
        ("Springfield", set()), ("manchester", {"Manchester, England"}),
    ],
)
def test_places(spark, wanted, fits):
    df = spark.createDataFrame([(p,) for p in PLACES], "location string").transform(ex.with_remote_type)
    got = {r.location for r in fl.filter_location(df, wanted).collect()}
    assert got == fits | {"Remote", None}
    assert {r.location for r in fl.filter_location(df, "wfh").collect()} == {"Remote", None}


def test_salary_filter_lets_unknown_pass_and_zero_is_a_value(spark):
    rows = [("$80,000 - $120,000",), ("From $50K",), ("Up to $60,000",), ("$15.50 per hour",), (None,)]
    df = spark.createDataFrame(rows, "salary_range string").transform(ex.with_salary_bounds)
    keep = lambda *a: {r.salary_range for r in fl.filter_salary(df, *a).collect()}
    assert keep(100000, None) == {"$80,000 - $120,000", "From $50K", None}
    assert keep(None, 40000) == {"Up to $60,000", "$15.50 per hour", None}
    assert keep(None, 0) == {"Up to $60,000", None}
    assert keep() == {r[0] for r in rows}


def test_other_filters(spark):
    df = spark.createDataFrame(
        [(1, "Senior Dev (remote)", "office", "Remote", "Senior", "Full-time", dt.datetime(2024, 1, 25)), (2, "Clerk", None, "On-site", None, None, None), (3, "Intern", "flexible", "Hybrid", "Entry-level", "Freelance", dt.datetime(2023, 1, 1))],
        "id int, title string, description string, remote_type string, experience_level string, employment_type string, posted_at timestamp_ntz",
    ).withColumns({"location": F.lit(None).cast("string"), "salary_min": F.lit(None).cast("bigint"), "salary_max": F.lit(None).cast("bigint")})
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(fl.filter_work_mode(df, "WFH")) == [1]
    assert ids(fl.filter_work_mode(df, "flexible")) == [3]
    assert ids(fl.filter_work_mode(df, "office")) == [1, 2]
    assert ids(fl.filter_work_mode(df, "anything")) == [1, 2, 3]
    assert ids(fl.filter_experience(df, "Sr")) == [1, 2]
    assert ids(fl.filter_employment(df, "contractor")) == [2, 3]
    assert ids(fl.filter_employment(df, "unheard of")) == [1, 2, 3]
    assert ids(fl.filter_recency(df, 7)) == [1, 2]
    assert ids(fl.filter_recency(df, 6)) == [2]
    assert ids(fl.filter_keyword(df, "CLERK")) == [2]
    assert ids(fl.search(df, experience_level="senior", days_old=30, job_type="remote")) == [1]


def test_kept_and_rejected_make_the_input(spark):
    rows = [("View all", "https://a.example"), ("Software Engineer", None), ("word", None), ("Careers", None), ("5 Jobs", "u")]
    df = spark.createDataFrame(rows, "title string, url string").withColumn("description", F.lit("text"))
    for strict in (False, True):
        kept, rejected = fl.validate_postings(df, strict), fl.rejected_postings(df, strict)
        assert kept.count() + rejected.count() == len(rows)
        assert fl.validate_postings(kept, strict).count() == kept.count()


def test_element_filters(spark):
    texts = ["Current openings", "short", "a text of middling size", "Remote role", "x" * 40, "search\nfor\nan engineer position"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text for r in fl.prefilter_elements(df).collect()} == {"Remote role", "x" * 40, texts[-1]}
    cards = ['<div data-jk="1">', '<div><h2><a href="/x">T</a></h2></div>', '<p><span class="companyName">A</span></p>', '<li class="job-item">x</li>', "<div>x</div>"]
    df = spark.createDataFrame([(c,) for c in cards], "html string")
    assert fl.filter_cards(df).count() == 4


def test_limits(spark):
    df = spark.createDataFrame([(1, "u", 3), (2, None, 1), (3, "v", 2), (4, "", 0)], "id int, url string, pos int")
    assert [r.id for r in lm.prefer_linked(df).collect()] == [3, 1, 4, 2]
    assert [r.id for r in lm.limit_results(df, 2, ["pos"]).collect()] == [4, 2]
    many = spark.createDataFrame([(list("abcdefghijkl"), list("abcdefg"), list("abcdefghij"))], "skills array<string>, requirements array<string>, benefits array<string>")
    assert [len(x) for x in lm.cap_arrays(many).collect()[0]] == [10, 5, 8]


def test_reports(spark):
    runs = spark.createDataFrame([("a", True, 10, 16.9), ("b", True, 2, 20.1), ("c", False, 0, 4.1), ("d", True, 6, 27.0)], "url string, success boolean, count bigint, elapsed_seconds double")
    r = ag.url_report(runs).collect()[0]
    assert tuple(r) == (4, 3, 1, 0.75, 18, 17.0, "a", "d")
    done = ag.field_completeness(spark.createDataFrame([("x", None, ["a"]), ("", "y", [])], "a string, b string, c array<string>")).collect()
    assert {x.field: x.share for x in done} == {"a": 0.5, "b": 0.5, "c": 0.5}
    values = ag.distinct_values(spark.createDataFrame([(["x", "x", "y"],), (["y"],)], "v array<string>"), "v").collect()
    assert {x.v: x.n for x in values} == {"x": 1, "y": 2}
    df = spark.createDataFrame([(1, i, f"L{i}", i % 4 == 0) for i in range(20)] + [(2, 0, None, True)], "q int, pos int, location string, k boolean")
    rows = {x.q: x for x in ag.run_summary(df, ["q"], F.col("k"), ["pos"]).collect()}
    assert (rows[1].found, rows[1].kept, rows[1].rejected_locations) == (20, 5, "L1|L2|L3|L5|L6")
    assert (rows[2].found, rows[2].kept, rows[2].rejected_locations) == (1, 1, None)


def test_experience_codes_cover_the_levels(value):
    assert value(X.experience_level, ["Staff Engineer", "Mid dev", "Jr. dev", "Director", "Dev"]) == ["Senior", "Mid-level", "Entry-level", "Executive", None]


def test_page_cut_keeps_rows_without_query(spark):
    from tideboard.operators import windows as wn

    rows = [(None, 1, None, 1), (None, 1, "k", 2), (None, 3, "m", 3), ("q", 1, "a", 4)]
    df = spark.createDataFrame(rows, "query_id string, page_no long, posting_key string, pos long")
    flags = {(r["query_id"], r["page_no"]): r["n_rows"] for r in wn.page_flags(df, ["pos"]).collect()}
    assert flags == {(None, 1): 2, (None, 3): 1, ("q", 1): 1}
    assert sorted(r["pos"] for r in wn.cut_pages(df, ["pos"]).collect()) == [1, 2, 4]
    stops = spark.createDataFrame([("q", 1)], "query_id string, page_no long")
    assert sorted(r["pos"] for r in wn.before_stop(df, stops).collect()) == [1, 2, 3]


def test_running_total_over_levels(spark):
    """Gaps, negative positions and several levels of blocks; the window without a key has a row for each top block."""
    rng = random.Random(4)
    rows = [(p, rng.randrange(-5, 9)) for p in rng.sample(range(-3000, 9000), 700)]
    df = spark.createDataFrame(rows, "place long, n long")
    want, so_far = {}, 0
    for p, n in sorted(rows):
        want[p], so_far = so_far, so_far + n
    for block, levels in ((7, 3), (10, 1), (10_000, 3)):
        got = wn.running_total(df, "place", "n", "before", block, levels)
        assert {r.place: r.before for r in got.collect()} == want
    top = wn.running_total(df, "place", "n", "before", 100, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert top.count("windowspecdefinition(_place") == 1  # all other windows have a block


def test_page_flags_read_their_input_once(spark):
    """What the caller's fields are made of is computed for the flags once, and once more for the rows that are kept."""
    from tests.conftest import SMALL
    from tideboard import catalog

    text = catalog.queries()["e1_board_search"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [posting_id") == 1  # all others are the flags, as written


def test_match_lexicon_of_long_terms(spark):
    """Terms of any length, overlapping ones, and one that a text ends too early for."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(6)]
    terms = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(60)} | {"w1 w1 w1 w1 w1 w1 w1 w1 w1"}
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, "w1 " * 9), (81, "w1 " * 8), (82, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    lexicon = spark.createDataFrame([(t, t.upper()) for t in terms], "term string, shown string")
    want = {i: sorted(t.upper() for t in terms if f" {t} " in f" {' '.join((x or '').split())} ") for i, x in texts}
    got = {r.id: r.terms for r in jn.match_lexicon(df, "id", "text", lexicon).collect()}
    assert got == {i: t for i, t in want.items() if t}
