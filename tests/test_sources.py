"""Page, payload and card scans on literal inputs."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideboard import fixtures as fx
from tideboard.functions import elements as E
from tideboard.functions import posting as X
from tideboard.sources import cards as sc
from tideboard.sources import details as sd
from tideboard.sources import pages as sp
from tideboard.sources import payloads as pl
from tideboard.sources import sinks


def page(spark, html, url="https://a.example/x"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def test_payload_shapes(spark):
    docs = [
        json.dumps([{"title": "A"}, 7, "x"]), json.dumps({"jobs": [{"name": "B"}], "items": [{"name": "C"}], "data": {"no": 1}}),
        json.dumps({"other": [{"title": "D"}]}), "not json", json.dumps({"results": []}),
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, payload string")
    got = pl.explode_payloads(df, keep_unparsable=True).select("id", "list_key", "pos", F.to_json("item").alias("j"), "error").collect()
    rows = sorted((r.id, r.list_key or "", r.pos, r.j, r.error) for r in got if r.error is None)
    assert rows == [(0, "", 0, '{"title":"A"}', None), (1, "items", 0, '{"name":"C"}', None), (1, "jobs", 0, '{"name":"B"}', None)]
    assert [(r.id, r.error) for r in got if r.error] == [(3, "payload is not JSON")]


def test_payload_projection(spark):
    items = [
        {"title": "Data Engineer", "city": ["Austin", "Paris"], "summary": "x" * 600, "link": "/a", "pay": {"min": 1, "max": 2}, "createdAt": 20240105},
        {"name": "Platform Engineer", "title": None, "location": "L"},  # present but null: no title
        {"positionTitle": "Nurse Manager", "salary": "10 to 20", "type": "Full-time"},
        {"title": "Careers"},
    ]
    df = spark.createDataFrame([(1, json.dumps({"jobs": items}))], "id int, payload string")
    got = {r.pos: r for r in pl.project_payload(pl.explode_payloads(df)).collect()}
    assert sorted(got) == [0, 2]
    assert (got[0].location, got[0].salary_range, got[0].posted_date, len(got[0].description)) == ("Austin, Paris", "1 - 2", "20240105", 600)
    assert (got[2].title, got[2].salary_range, got[2].employment_type) == ("Nurse Manager", "10 to 20", "Full-time")


CARD = {
    "title": "Senior Dev", "company": {"name": "Acme"}, "companyUrl": "/co/acme", "location": {"displayName": "Austin, TX"},
    "locationTypes": [{"name": 3}], "pay": {"min": 80000, "max": 1200000}, "employmentTypes": [{"name": 9}],
    "shortDescription": "Python and Docker", "jobRedirectPageUrl": "https://x.example/1", "listingKey": "k1",
    "benefits": [{"name": 2}, {"name": 99}, {"name": 7}], "status": {"postedAtUtc": "2024-01-05T10:00:00Z"},
}


@pytest.mark.parametrize(
    "html",
    [
        '<script type="application/json">{"x":1}</script><script type="application/json">%s</script>'
        % json.dumps({"hydrateJobCardsResponse": {"jobCards": [CARD, {"title": ""}]}}),
        "<script>window.state = {\"a\": {}, \"hydrateJobCardsResponse\": %s, \"z\": [1]}; run();</script>"
        % json.dumps({"jobCards": [CARD, {"title": ""}]}),
    ],
)
def test_embedded_cards(spark, html):
    rows = pl.project_board_cards(pl.explode_embedded_json(page(spark, html)), "https://b.example").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.company, r.company_url, r.url) == ("Acme", "https://b.example/co/acme", "https://x.example/1")
    assert (r.salary_range, r.remote_type, r.employment_type) == ("$80,000 - $1,200,000", "Remote", "Full-time")
    assert (r.posted_date, r.experience_level, r.benefits, r.skills) == ("2024-01-05", "Senior", ["Dental", "PTO"], ["Python", "Docker"])


def test_embedded_card_gaps(spark):
    card = {"title": "Clerk", "pay": {"min": 0, "max": 5}, "locationTypes": [{"name": 77}], "status": {"postedAtUtc": "soon"}}
    html = '<script type="application/json">%s</script>' % json.dumps({"hydrateJobCardsResponse": {"jobCards": [card]}})
    r = pl.project_board_cards(pl.explode_embedded_json(page(spark, html))).collect()[0]
    assert (r.salary_range, r.remote_type, r.employment_type, r.posted_date, r.benefits, r.skills) == (None, "On-site", None, "soon", None, None)


def card(i, inner=""):
    return f'<div data-jk="{i}" class="c"><div><h2 class="jobTitle"><a href="/v?jk={i}">Role {i}</a></h2></div>{inner}</div>'


def test_nested_and_many_cards():
    assert sc.find_cards("<body>" + card(1, "<p>x</p>") + "<p>out</p>" + card(2) + "</body>") == [card(1, "<p>x</p>"), card(2)]
    assert len(sc.find_cards("".join(card(i) for i in range(25)))) == 25
    assert len(sc.find_cards("".join(card(i) for i in range(40)))) == 40
    assert sc.find_cards('<script>var a = "<div data-jk=1>";</script><!-- <div data-jk="2"></div> -->') == []


def test_card_fallbacks():
    by_class = '<div class="jobsearch-SerpJobCard x"><b>A</b></div>'
    assert sc.find_cards(by_class) == [by_class]
    by_link = '<div><span><a class="jcs-JobTitle" href="/1">T</a></span></div>'
    assert sc.find_cards(by_link) == [by_link]
    both = '<div class="job_seen_beacon" data-jk="1">x</div>'
    assert sc.find_cards(both) == [both]


def test_cards_of_result_pages_equal_the_postings_they_were_built_from(spark):
    cards = sc.pages_to_cards(fx.posting_pages(spark, SMALL).select("page_id", "html"))
    got = {r.page_id: r for r in sc.cards_to_postings(cards, fx.BOARD_URL).filter("pos = 0").collect()}
    want = fx.postings(spark, SMALL).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.posting_id]
        assert g.title == w.title
        assert g.job_id == str(w.posting_id)
        if w.company is not None:
            assert g.company == w.company
        if w.location is not None:
            assert g.location == w.location
        if w.salary_text is not None:
            assert g.salary_range == w.salary_text
        assert g.description == w.description.strip()


GOLDEN_CARDS = [
    ("<div data-jk='a'><h2 class='jobTitle'><a href='/v?jk=a'>Nurse</a></h2><span class='companyName'>Acme Inc</span><p>Other words</p></div>", ("Nurse", "Acme Inc", None, None, None)),
    ('<div data-jk="b"><h2>Clerk</h2><span class="companyName"><a href="/cmp/Acme">Acme</a></span></div>', ("Clerk", "Acme", "https://b.example/cmp/Acme", None, None)),
    ('<div data-jk=c><h2>Cook</h2><div class=companyLocation><div>Austin, TX</div> (on site)</div><div class="salary-snippet"><span>$20.00</span> - $30.00 an hour</div></div>', ("Cook", None, None, "Austin, TX (on site)", "$20.00 - $30.00 an hour")),
]


def test_nested_and_differently_quoted_cards(spark):
    """Values written by hand, independent of the rule lists."""
    pages = spark.createDataFrame(list(enumerate(h for h, _ in GOLDEN_CARDS)), "page_id bigint, html string")
    rows = sc.cards_to_postings(sc.pages_to_cards(pages), "https://b.example").orderBy("page_id").collect()
    for r, (_, want) in zip(rows, GOLDEN_CARDS, strict=True):
        got = (r.title, r.company, r.company_url, r.location, r.salary_range)
        assert got[:1] + tuple(g for g, w in zip(got[1:], want[1:]) if w is not None) == want[:1] + tuple(w for w in want[1:] if w is not None)


def test_whole_nested_description(spark):
    html = '<div data-jk="1"><h2>Role here</h2><div class="job-snippet"><div>First part of it.</div><div>Second part.</div></div></div>'
    r = sc.cards_to_postings(sc.pages_to_cards(page(spark, html).select("page_id", "html"))).collect()[0]
    assert r.description == "First part of it. Second part."


def test_many_cards_stay(spark):
    html = "".join(f"<div data-jk='{i}'><h2>Role {i}</h2></div>" for i in range(40))
    assert sc.pages_to_cards(page(spark, html).select("page_id", "html")).count() == 40


def test_detail_page(spark):
    html = (
        "<div class='company-info'>x</div><span class=industry>Retail</span><div class=\"company-size\">51-200</div>"
        "<div class='jobsearch-jobDescriptionText'><div>" + "We bake bread. " * 8 + "</div><div>Come by.</div></div>"
        "<ul class='perks'><li>Dental <b>plan</b></li></ul><div class='qualifications'><p>Minimum one year</p></div>"
        "<div data-testid='job-details'><span>$45,000 a year</span></div>"
    )
    pages = spark.createDataFrame([("u", html), ("v", None), ("w", "")], "url string, html string")
    got = {r.url: r for r in sd.pages_to_details(pages).collect()}
    u = got["u"]
    assert (u.industry, u.company_size, u.benefits, u.requirements) == ("Retail", "51-200", ["Dental plan"], ["Minimum one year"])
    assert u.salary_range == "$45,000 a year" and u.description.endswith("Come by.")
    for other in ("v", "w"):
        assert got[other].industry is None and got[other].salary_range is None and not got[other].benefits


def test_links(spark):
    html = '<nav><a href="/about">About</a></nav><a class=x href="jobs/7?a=1&amp;b=2"><b>Dev</b> role</a><a name="n">no</a>'
    rows = [tuple(r) for r in sp.pages_to_links(page(spark, html)).orderBy("pos").collect()]
    assert rows == [(1, 0, "/about", "https://a.example/about", "About"), (1, 1, "jobs/7?a=1&b=2", "https://a.example/jobs/7?a=1&b=2", "Dev role")]
    assert sp.pages_to_links(page(spark, html), drop_chrome=True).count() == 1
    assert sp.with_job_link(page(spark, html)).collect()[0].job_link == "https://a.example/jobs/7?a=1&b=2"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>Checking your browser</p>", {"is_blocked": True}),
        ("<p>Checking your browser</p><div data-jk=1>", {"is_blocked": False}),
        ("<title>Just a moment</title><script>challenge-platform</script>", {"is_blocked": True}),
        ("<p>Sorry, no results found.</p>", {"is_empty": True, "is_end": True}),
        ("<h1>Life at Acme</h1><p>load more</p>", {"is_landing": True, "pagination_type": "load_more"}),
        ('<div class="modal">x</div>', {"page_type": "modal_first"}),
        ("<p>find jobs</p>", {"page_type": "direct_listing", "has_job_terms": True}),
        ("find positions: search positions", {"page_type": "search_first"}),
        ("<p>select location</p><ul class='pagination'>", {"page_type": "filter_required", "pagination_type": "numbered"}),
        ("<div class='infinite-scroll'>", {"pagination_type": "infinite_scroll"}),
    ],
)
def test_page_labels(spark, html, want):
    row = sp.classify_pages(page(spark, html)).collect()[0].asDict()
    assert {k: row[k] for k in want} == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="pagination"><a>1</a><a class="active">2</a><a>10</a><a>2</a><a>Prev</a><a>Next</a></div>', ("numbered", 2, 10, [1, 2, 10], True, True)),
        ('<nav role="navigation"><button aria-label="next page">&gt; page</button></nav>', ("next_only", 1, None, [], True, False)),
        ('<ul class="paging"><a class="disabled">Next</a><a>1000</a></ul>', ("numbered", 1, 1000, [1000], False, False)),
        ("<nav role='navigation'><a>About</a></nav><div class='x pagination'><ul><li><div><a>1</a></div></li><li><div><a aria-current='page'>2</a></div></li><li><a title=next>Next</a></li></ul></div>", ("numbered", 2, 2, [1, 2], True, False)),
        ("<p>1 2 3</p>", ("none", 1, None, [], False, False)),
    ],
)
def test_pagination(spark, html, want):
    r = sp.pagination_info(page(spark, html)).collect()[0]
    assert (r.pagination_type, r.current_page, r.total_pages, r.page_numbers, r.has_next, r.has_prev) == want


def test_page_plan(spark):
    html = '<div class="pagination"><a>1</a><a class="current">3</a><a>60</a></div>'
    rows = [tuple(r)[1:] for r in sp.page_plan(sp.pagination_info(page(spark, html)), max_page=19).orderBy("page_no").collect()]
    assert rows == [(n, (n - 1) * 15) for n in range(4, 20)]
    assert sp.page_plan(sp.pagination_info(page(spark, "<p>x</p>"))).count() == 0


def test_sinks_append_per_source(spark, tmp_path):
    rows = fx.postings(spark, SMALL).select("posting_id", "source", "title")
    sinks.write_postings(rows, str(tmp_path / "p"))
    sinks.write_postings(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 * rows.count()
    sinks.write_run_report(rows.limit(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_nested_elements_are_one_card():
    inner = '<td class="resultContent"><a class="jcs-JobTitle" href="/1">T</a></td>'
    nested = f'<div class="job_seen_beacon">{inner}</div>'
    marked = f'<div class="job_seen_beacon"><div data-jk="7">{inner}</div></div>'
    assert sc.find_cards(nested) == [nested]
    assert sc.find_cards(marked) == [f'<div data-jk="7">{inner}</div>']


def test_positions_of_result_pages(spark):
    from tideboard.plans.searches import with_page_position

    urls = {
        "https://b.example/jobs?q=software+engineer&l=Austin%2C+TX": ("software engineer", 1),
        "https://b.example/jobs?q=c%2B%2B&start=30": ("c++", 3),
        "https://b.example/find?search=nurse&page=4": ("nurse", 4),
        "https://b.example/jobs?q=100%": ("100%", 1),
        "https://b.example/jobs": (None, 1),
    }
    rows = with_page_position(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {r["url"]: (r["query_id"], r["page_no"]) for r in rows} == urls


def test_parts_of_cards_come_from_the_scan_that_finds_them(spark, monkeypatch):
    odd = [
        '<div data-jk="1"><h2 CLASS=jobTitle>One</h2><span class=companyName><a href="/company/x&amp;y">A &amp; B</a></div><div class="date">out</div>',
        '<section><div data-jk=2><div class=\'sal&#97;ry\'>$5 an hour<p>open</section><div class="companyLocation">out</div>',
        '<div data-jk="3"><!-- <span class="companyName">no</span> --><div data-jk="4"><script>"<h2>no</h2>"</script><h2>Two</h2></div></div>',
        '<div data-jk="5"/><h2>out</h2><div class="jobsearch-x">no card</div>',
    ]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").unionByName(fx.posting_pages(spark, SMALL).select("page_id", "html").limit(50))
    names = list(X.CARD_ELEMENTS)
    cards = sc.pages_to_cards(pages, parts=names)
    both = cards.select("parts", X.card_parts(F.col("html"), names).alias("again")).collect()
    assert len(both) > 50 and all(r.parts == r.again for r in both)
    scans = []
    monkeypatch.setattr(E.Page, "__init__", lambda self, source, made=E.Page.__init__: (scans.append(source), made(self, source))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["".join(f'<div data-jk="{k}"><h2>Title {k}</h2></div>' for k in range(30))])], ["page_id", "html"])
    (out,) = sc._batches({"title": X.CARD_ELEMENTS["title"]}, iter([batch]))
    assert [p["title"][4]["text"] for p in out.column("parts").to_pylist()] == [f"Title {k}" for k in range(30)]
    assert len(scans) == 1  # a page's cards are not scanned again


def test_elements_written_alike_are_judged_once(monkeypatch):
    read = []
    monkeypatch.setattr(E, "_attributes", lambda written, made=E._attributes: (read.append(written), made(written))[1])
    pages = [f'<div data-jk="{k}"><h2 class="jobTitle"><a href="/jobs/{k}">Title {k}</a></h2><span class=companyName>Acme {k}</span></div>' for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(pages)], ["page_id", "html"])
    (out,) = sc._batches({name: X.CARD_ELEMENTS[name] for name in ("title", "company")}, iter([batch]))
    assert [(p["title"][0]["text"], p["title"][0]["link"], p["company"][1]["text"]) for p in out.column("parts").to_pylist()] == [
        (f"Title {k}", f"/jobs/{k}", f"Acme {k}") for k in range(50)
    ]
    assert read.count(' class="jobTitle"') == read.count(" class=companyName") == 1  # on all pages of a task


def test_what_is_held_of_attributes_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "_HELD_FITS", 8)
    fitting = E.Fitting([("div", "data-jk", "present", ""), ("h2", "", "", ""), ("", "class", "word", "b")])
    for k in range(100):
        assert fitting["div", f' data-jk="{k}" class="a b"'] == (0, 2) and fitting["h2", f" id={k}"] == (1,) and fitting["p", " class=bb"] == ()
        assert len(fitting) <= 8
    assert fitting["h2", " title=x class='b " + "y" * 500 + "'"] == (1, 2) and len(fitting) <= 8
