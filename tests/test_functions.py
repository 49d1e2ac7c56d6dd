"""Field functions against known values and against the standard library."""

import datetime as dt
import html as stdlib_html
from html.entities import html5
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import html as H
from tideboard.functions import posting as X
from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.functions import verdicts as V


def test_clean_text_keeps_words_and_basic_punctuation(value):
    inputs = ["  a\t b\n c ", "café <b>№5</b> – 100% (sure)", "x@y #1 *z*", ""]
    expected = [re.sub(r"[^\w\s\-.,;:!?()/&$%]", "", re.sub(r"\s+", " ", t)).strip() for t in inputs]
    assert value(T.clean_text, inputs) == expected


def test_title_case_follows_every_non_letter(value):
    inputs = ["acme corp", "3com", "node.js ci/cd", "o'neil's"]
    assert value(T.title_case, inputs) == [t.title() for t in inputs]


def test_entities(value):
    inputs = ["a &amp; b", "&lt;p&gt; &quot;x&quot;", "caf&#233; &#x41;&#66;", "&#0; &#xD800; &#abc", "no entity", "&amp;lt;", "&#8364;5 &#128512;"]
    got = value(T.decode_entities, inputs)
    for text, shown in zip(inputs, got):
        if text != "&#0; &#xD800; &#abc":  # not characters: left as they are
            assert shown == stdlib_html.unescape(text)
    assert got[3] == inputs[3]


def test_entities_of_all_names(value):
    names = sorted(html5)
    inputs = [f"a &{n} b" for n in names] + [f"x&{n}9z&&{n}" for n in names if not n.endswith(";")]
    inputs += ["&#128;&#x9f;&#129;", "&#65 &#x41z", "&#11;|&#7;|&#127;|&#xfdd0;|&#x1ffff;", "&#13;&#000065;", "&notit; &notin; &nosuchname; &; & &&amp", "&CounterClockwiseContourIntegral;&x;"]
    got = value(T.decode_entities, inputs)
    for text, shown in zip(inputs, got, strict=True):
        assert shown == (stdlib_html.unescape(text) if "nbsp" not in text else stdlib_html.unescape(text).replace("\xa0", " ")), text
    assert value(T.decode_entities, ["&#1114112; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFF;", None]) == ["&#1114112; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFF;", None]


def test_attributes_keep_names_that_go_on(value):
    inputs = ["/jobs?q=1&region=us&copy=2&amp;x=3", "/a?b&reg", "/a?b&eacute;&notin;c", "/a&lt /b"]
    assert value(lambda c: T.decode_entities(c, in_attribute=True), inputs) == ["/jobs?q=1&region=us&copy=2&x=3", "/a?b®", "/a?bé∉c", "/a< /b"]


def test_links_of_every_quoting(value):
    page = """<a href=/viewjob?jk=a1>One</a> <A class=x HREF = '/b"2' >Tw&ouml;</A> <a href="/c'3">3</a><a href=/d/ id=4>4</a> <a name=x>no</a> <a href="">5</a>"""
    (found,) = value(H.links, [page])
    assert [tuple(x) for x in found] == [("/viewjob?jk=a1", "One"), ('/b"2', "Twö"), ("/c'3", "3"), ("/d/", "4"), ("", "5")]
    assert value(lambda c: H.attribute_value(c, "href"), [page, "<a href='x y'>", "<a>"]) == ["/viewjob?jk=a1", "x y", None]


def test_company_from_url(value):
    urls = ["https://www.burton.com/us/en/careers", "https://acme-corp.example.org/x", "http://user@a_b.io:8080/", "not a url"]
    assert value(U.company_from_url, urls) == ["Burton", "Acme Corp", "A B", None]


BASES = ["https://a.example/x/y/page.html?q=1#top", "http://a.example", "http://a.example/dir/"]
HREFS = [
    "/root", "rel.html", "../up", "../../up/../z", "./here", "?p=2", "#frag", "//other.example/x", "https://b.example/",
    "mailto:careers@a.example", "", "a/./b/../c?x=../y", "/a/../b", "sub/", "..",
]


def test_resolve_agrees_with_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("got")).collect():
        assert r["got"] == urljoin(r["b"], r["h"]), (r["b"], r["h"])


def test_absolute_or_null(value):
    got = value(lambda c: U.absolute_or_null(c, "https://b.example"), ["/jobs/1", "https://x.example/1", "jobs/1", None])
    assert got == ["https://b.example/jobs/1", "https://x.example/1", None, None]


def test_board_job_id(spark):
    rows = [
        ("https://b.example/v?jk=77&from=x", None), ("https://b.example/v?a=1&id=9#f", None), ("https://b.example/v?kid=9", None),
        ("https://b.example/v?jk=77", '<div data-jk="5">'), ("https://b.example/v", '<a data-job-id="z1">'),
    ]
    df = spark.createDataFrame(rows, "u string, h string")
    got = [r[0] for r in df.select(U.board_job_id(F.col("u"), F.col("h"))).collect()]
    assert got == ["77", "9", None, "5", "z1"]


def test_posting_key(spark):
    rows = [
        ("T", "C", "L", "https://www.b.example/viewjob?jk=AB1&x=2"), ("T", "C", "L", "https://www.b.example/other "),
        (" Senior  Dev ", None, "Austin, TX", "https://else.example/1"), ("T", "C", "L", None),
    ]
    df = spark.createDataFrame(rows, "t string, c string, l string, u string")
    key = U.posting_key(F.col("t"), F.col("c"), F.col("l"), F.col("u"), "b.example")
    assert [r[0] for r in df.select(key).collect()] == ["board_ab1", "https://www.b.example/other", "senior dev||austin, tx", "t|c|l"]


def test_location_in_text(value):
    texts = ["Berlin, Germany office", "We are in Austin, TX now", "fully remote", "Toronto, ON, CAN", "nothing, here", "say hello, tx"]
    assert value(X.location_in_text, texts) == ["Berlin, Germany", "Austin, TX", "remote", "Toronto, ON", None, None]


def test_work_mode_of_location(value):
    places = ["Remote", "Hybrid remote in Denver, CO", "Austin, TX", "", None]
    assert value(X.work_mode_of_location, places) == ["Remote", "Hybrid", "On-site", None, None]


def test_employment_type_needs_whole_words(value):
    texts = ["Full-time", "software after-hours shift", "PT role", "Contractor", "summer internship", "temp to hire", "Freelance", "capture"]
    assert value(X.employment_type, texts) == [
        "Full-time", None, "Part-time", "Contract", "Internship", "Temporary", "Freelance", None,
    ]


def test_salary_text(value):
    texts = [
        "Pay: $80,000 - $120,000 a year plus", "$20 / hour", "80k - 100k", "up to $90,000", "$15.50 per hour", "no pay here", "$5", None,
    ]
    assert value(X.salary_text, texts) == [
        "$80,000 - $120,000 a year", "$20 / hour", "80k - 100k", "up to $90,000", "$15.50 per hour", None, None, None,
    ]


@pytest.mark.parametrize(
    "text, low, high, period",
    [
        ("$80,000 - $120,000 a year", 80000, 120000, "year"),
        ("$80K - $120K", 80000, 120000, None),
        ("From $50K", 50000, None, None),
        ("Up to $60,000", None, 60000, None),
        ("$15.50 per hour", 32240, 32240, "hour"),
        ("$20 - $30 hourly", 41600, 62400, "hour"),
        ("competitive", None, None, None),
    ],
)
def test_salary_bounds(value, text, low, high, period):
    assert tuple(value(X.salary_bounds, [text])[0]) == (low, high, period)


def test_posted_at(value):
    as_of = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    texts = ["Just posted", "Yesterday", "3 days ago", "5 hours ago", "10 minutes ago", "30+ days ago", "2024-01-05", "1/9/2024", "Jan 7, 2024", "8 January 2024", "soon", None]
    d = dt.datetime
    assert value(lambda c: X.posted_at(c, as_of), texts) == [
        d(2024, 2, 1, 12), d(2024, 1, 31, 12), d(2024, 1, 29, 12), d(2024, 2, 1, 7), d(2024, 2, 1, 11, 50), d(2024, 1, 2, 12),
        d(2024, 1, 5), d(2024, 1, 9), d(2024, 1, 7), d(2024, 1, 8), None, None,
    ]


def test_posted_text(value):
    texts = ["Posted 3 days ago by X", "Active 30+ days ago", "posted on 2024-01-05", "within the last 3 days", "none"]
    assert value(X.posted_text, texts) == ["3 days ago", "30+ days ago", "2024-01-05", "within the last 3 days", None]


def test_forms_of_pay(value):
    """Text around the phrase, the phrase. A fuller form goes before an earlier one."""
    forms = {
        "earn $80,000 - $120,000 per year now": "$80,000 - $120,000 per year",
        "$80,000.00 - $95,500.50 yearly": "$80,000.00 - $95,500.50 yearly",
        "$ 80k-$ 95k, dental": "$ 80k-$ 95k",
        "$20 - $30 hourly": "$20 - $30",
        "$80k – 100k": "$80k – 100k",
        "60K to 70K": "60K to 70K",
        "60k - 70k a  year": "60k - 70k a year",
        "from $50,000, or $90,000 - $95,000": "$90,000 - $95,000",
        "$70,000/yr": "$70,000/yr",
        "$70k per year": "$70k per year",
        "From $70k per year": "$70k per year",
        "$24.75 / hour": "$24.75 / hour",
        "$31 hourly": "$31 hourly",
        "$90,000 annually": "$90,000 annually",
        "50,000 - 60,000 EUR": "50,000 - 60,000 EUR",
        "40,000-45,000 per year": "40,000-45,000 per year",
        "starting  at $45,000": "starting at $45,000",
        "Base salary $88k plus": "Base salary $88k",
        "10 - 20 people": None,
        "401k and PTO": None,
        "raised $5,000,000": None,
        "10km - 20km": None,
    }
    assert value(X.salary_text, list(forms)) == list(forms.values())


def test_forms_of_age(value):
    forms = {
        "1 day ago": "1 day ago", "Active 45 mins  ago": "45 mins ago", "12 HOURS AGO": "12 HOURS AGO", "Just  Posted": "Just Posted",
        "just now!": "just now", "posted today, 2 days ago elsewhere": "2 days ago", "Recently posted": "Recently posted",
        "in the last 24 hours": "in the last 24 hours", "on 3/14/2024.": "3/14/2024", "January 5, 2024": "January 5, 2024",
        "Sept 15 2024": "Sept 15 2024", "7 Dec 2023": "7 Dec 2023", "2 weeks": None, "3 days": None,
    }
    assert value(X.posted_text, list(forms)) == list(forms.values())


def test_skills_are_tokens_in_lexicon_order(value):
    texts = ["Go, R and C++ with C#; Java not JavaScript? Rest API!", "software research engineer", "ci/cd node.js", "python python"]
    assert value(X.skills, texts) == [
        ["Javascript", "Java", "Rest Api", "Go", "C++", "C#", "R"], [], ["Node.Js", "Ci/Cd"], ["Python"],
    ]


def test_skills_fall_back_to_the_whole_text(spark):
    df = spark.createDataFrame([("nothing", "Python"), ("Java", "Python")], "d string, t string")
    assert [r[0] for r in df.select(X.skills(F.col("d"), F.col("t"))).collect()] == [["Python"], ["Java"]]


def test_terms_that_contain_other_terms(value):
    lexicon = [("machine learning", "ML"), ("machine", "M"), ("learning", "L")]
    assert value(lambda c: X.terms_in(c, lexicon), ["machine learning", "learning"]) == [["ML", "M", "L"], ["L"]]


def test_requirements(value):
    texts = ["Requirements: Python and AWS, 5 years. Must have: a sense of humour. Required: x."]
    assert value(X.requirements, texts) == [["Python and AWS, 5 years", "a sense of humour"]]


def test_detail_items(value):
    page = "<ul class='benefits requirements'><li>Health insurance</li><li>Free <b>lunch</b> daily</li><li>x</li><li>Health insurance</li><li>Bachelor degree needed</li></ul>"
    assert value(lambda c: X.benefit_items(E.texts(X.detail_parts(c)["benefits"])), [page]) == [["Free lunch daily", "Health insurance"]]
    assert value(lambda c: X.requirement_items(E.texts(X.detail_parts(c)["requirements"])), [page]) == [["Bachelor degree needed"]]


def test_company_size_and_industry(value):
    assert value(X.company_size, ["11-50 employees", "500+ employees", "an Enterprise", "big"]) == ["11-50 employees", "500+ employees", "Enterprise", None]
    assert value(X.industry, ["retail technology", "media", "none"]) == ["Technology", "Media", None]
    page = '<div class="company-info">ab</div><span class="x-industry">Health care</span>'
    assert value(X.industry_of_page, [page, "<p>x</p>"]) == ["Health care", None]
    assert value(X.company_size_of_page, ['<div class="company-size">51-200</div>', "<div class=size>big</div>"]) == ["51-200", None]


def test_formatted_description(value):
    text = "Description: We build.Apply nowHere &amp; there\n\n\n\nABOUT US we  do\tthings Location:Here"
    assert value(X.formatted_description, [text]) == ["We build. Apply now Here & there\n\nABOUT US we do things \nLocation:Here"]


def test_formatted_description_drops_boilerplate(value):
    texts = {
        "Salary: high\nIndeed home page\nWe sail.Ships": "high\n\nWe sail. Ships",
        "a Profile insights x\nSkills y Do you have experience in sailing? YesNo b": "a b",
        "Job details here Job type there Full-time work": "work",
        "one\n \n\n\t\n two": "one\n\n two",
        "x POSITION OVERVIEW yReports To: z": "x \n\nPOSITION OVERVIEW y \nReports To: z",
        "QUALIFICATIONS first": "QUALIFICATIONS first",
        "": "",
    }
    assert value(X.formatted_description, [*texts, None]) == [*texts.values(), None]


def test_description_lines(value):
    good = "our people make quality boards for riders in every mountain town"
    text = "VIEW THIS PAGE NOW IN CAPITAL LETTERS ONLY PLEASE DO IT\napply here because this line has the wrong words in it today\n" + good
    lines = lambda c: F.split(c, "\n")
    assert value(lambda c: X.description_line(lines(c)), [text, "short"]) == [good, None]


def test_visible_text(value):
    page = "<html><head><style>p{}</style><script>var a='</p>';</script></head><body><nav>Menu</nav><p>Hello<br>big</p><!-- no --><footer>f</footer></body>"
    assert value(H.visible_text, [page]) == ["Hello big"]


def test_page_title_takes_the_longest(value):
    pages = [
        "<h1>Role</h1><h2>Senior Role at Acme</h2><a href='/x'>go</a>",
        "<p>ab</p><p>First fitting line</p>",
        "<p>x</p>",
    ]
    assert value(X.page_title, pages) == ["Senior Role at Acme", "First fitting line", None]


NEGATIVE = ["VIEW ALL JOBS", "Careers", "Log in", "Products", "Support", "Engineering (5 Jobs)", "12", "Japan", "Sales", "New York", "See our roles and more", "View locations"]
POSITIVE = ["Software Engineer", "Research Scientist", "Retail Sales Associate", "DevOps Engineer (Remote)", "Head of People Ops", "Warehouse Operator"]


def test_titles(value):
    assert value(V.is_job_title, NEGATIVE) == [False] * len(NEGATIVE)
    assert value(V.is_job_title, POSITIVE) == [True] * len(POSITIVE)
    assert value(V.is_job_title, [None, "abcd", "x" * 201]) == [False, False, False]


@pytest.mark.parametrize(
    "url, verdict",
    [
        (None, True), ("https://a.example/careers/40", True), ("https://a.example/jobs/software-engineer", True),
        ("https://a.example/about", False), ("https://a.example/careers", False), ("https://a.example/careers/", False),
        ("https://a.example/c/design-jobs", False), ("https://a.example/search?q=x", False),
        ("https://a.example/search?jobid=5", True), ("https://a.example/pages/careers", False), ("/jobs", False),
        ("https://a.example/products/1", False), ("https://a.example/en/role", True), ("https://a.example/x.pdf", False),
    ],
)
def test_urls(value, url, verdict):
    assert value(U.is_job_url, [url]) == [verdict]


def test_reject_reasons(spark):
    rows = [
        ("ok title", None, None), ("word", None, "single word without url"), ("word", "https://a.example", None),
        ("View all", "https://a.example", "navigation title"), ("Current openings", None, "navigation title"),
        ("5 Jobs", "https://a.example", "job count"), ("ab", "https://a.example", "title length"),
    ]
    df = spark.createDataFrame(rows, "t string, u string, want string")
    for r in df.select("want", V.reject_reason(F.col("t"), F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize(
    "title, description, reason",
    [
        ("Barista", "Barista", "description repeats title"), ("Sales", "open roles (3 jobs) in this team", "category text"),
        ("Shirts", "view all shirts", "product text"), ("Dogs", "read our stories", "content text"),
        ("Care", "see order status", "service text"), ("Join", "thanks for visiting", "marketing text"),
        ("Join", "thanks for visiting. salary good", None), ("Japan", "text", "place title"), ("Catalog", "text", "product title"),
        ("Apply today", "text", "marketing title"), ("Fly fishing", "text", "product words"), ("Store Manager", "text", None),
    ],
)
def test_strict_reasons(spark, title, description, reason):
    df = spark.createDataFrame([(title, description)], "t string, d string")
    assert df.select(V.strict_reason(F.col("t"), F.col("d"))).collect()[0][0] == reason


def test_boards_and_platforms(value):
    urls = ["https://boards.greenhouse.io/x", "https://Jobs.Lever.co/x", "https://a.example"]
    assert value(U.board_of, urls) == ["greenhouse", "lever", None]
    assert [tuple(p) for p in value(U.platform_of, urls)] == [
        ("greenhouse", "direct_listing", "numbered"), ("lever", "direct_listing", "infinite_scroll"), (None, "direct_listing", "none"),
    ]


def test_a_field_asks_for_its_own_elements_only(spark, monkeypatch):
    asked = []
    parts = E.parts
    monkeypatch.setattr(E, "parts", lambda html, wanted: asked.append(list(wanted)) or parts(html, wanted))
    for of in (X.title_of_card, X.company_of_card, X.location_of_card, X.salary_of_card, X.posted_of_card, X.description_of_card, X.description_of_page):
        of(F.col("html"))
    assert asked == [["title"], ["company"], ["location"], ["salary"], ["posted"], ["description"], ["description"]]


def test_an_element_is_read_once(monkeypatch):
    read = []
    attributes = E._attributes
    monkeypatch.setattr(E, "_attributes", lambda source: read.append(source) or attributes(source))
    page = E.Page("<!-- <b> --><div class='a b' id=\"x>y\"><h2 data-z==1>T &amp; t</h2><br/><a href=/q>q</a></div>")
    assert E._first(page, [("h2", "", "", "")], "", ())[0]["text"] == "T & t" and len(read) == 0
    assert [list(page.matching(s)) for s in (("div", "class", "word", "b"), ("", "id", "is", "x>y"), ("a|h2", "href", "present", ""), ("", "data-z", "present", ""))] == [[0], [0], [3], [1]]
    assert len(read) == 4 and page.part(0) is page.part(0)
    assert page.part(0) == {"text": "T & t q", "link": "/q", "opening": "<div class='a b' id=\"x>y\">"}
