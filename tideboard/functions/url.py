"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideboard.functions import text as T
from tideboard.rules import urls as U


def host(url: Column) -> Column:
    """Host with port, without user information; NULL when the URL has none."""
    return T.blank_to_null(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def company_from_url(url: Column) -> Column:
    """First host label after "www." as a name: "acme-corp.example.org" gives "Acme Corp"."""
    label = F.get(F.split(F.replace(host(url), F.lit("www."), F.lit("")), r"\."), 0)
    return T.title_case(F.regexp_replace(label, r"[-_]", " "))


def absolute_or_null(url: Column, base: str) -> Column:
    """Root-relative paths get the base, http URLs stay, anything else is NULL."""
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).when(
        F.startswith(url, F.lit("http")), url
    )


def resolve(base: Column, href: Column) -> Column:
    """A link as the browser resolves it against the page URL."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_extract(F.when(base_path == "", "/").otherwise(base_path), r"^(.*/)", 1)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base)
        .when(T.matches(href, r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, base_path, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, _collapse_dots(href_path), href_tail))
        .otherwise(F.concat(origin, _collapse_dots(F.concat(folder, href_path)), href_tail))
    )


def _collapse_dots(path: Column) -> Column:
    """Path without "." and ".." segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.array_append(done, s)),
    )
    ends_in_dots = T.matches(path, r"/\.{1,2}$")
    return F.when(
        T.matches(path, r"/\.{1,2}(?:/|$)"),
        F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_dots & (F.size(kept) > 0), "/").otherwise("")),
    ).otherwise(path)


def parameter(url: Column, name: str) -> Column:
    return T.blank_to_null(F.regexp_extract(url, rf"[?&]{name}=([^&#]+)", 1))


def board_job_id(url: Column, html: Column | None = None) -> Column:
    """Posting id of a board: card attribute, else URL parameter, else the other attribute."""
    from_url = [parameter(url, "jk"), parameter(url, "id")]
    if html is None:
        return F.coalesce(*from_url)
    attribute = [
        T.blank_to_null(F.regexp_extract(html, rf"(?i)\b{name}=[\"']([^\"']+)[\"']", 1))
        for name in ("data-jk", "data-job-id")
    ]
    return F.coalesce(attribute[0], *from_url, attribute[1])


def posting_key(title: Column, company: Column, location: Column, url: Column, board_domain: str) -> Column:
    """Identity of a posting: board id, else board URL, else title, company and place."""
    link = F.lower(F.trim(url))
    jk = T.blank_to_null(F.regexp_extract(link, r"jk=([^&]*)", 1))
    on_board = F.contains(link, F.lit(board_domain))
    parts = [T.squeeze(F.lower(F.coalesce(c, F.lit("")))) for c in (title, company, location)]
    return (
        F.when(on_board & jk.isNotNull(), F.concat(F.lit("board_"), jk))
        .when(on_board, link)
        .otherwise(F.concat_ws("|", *parts))
    )


def is_job_link(url: Column) -> Column:
    return F.coalesce(T.contains_any(F.lower(url), U.JOB_LINK_FRAGMENTS), F.lit(False))


@T.on_value
def is_job_url(url: Column) -> Column:
    """Whether a URL looks like one posting. No URL is no evidence against it."""
    u = F.lower(url)
    words = "|".join(U.NUMBERED_PATHS)
    endings = "|".join(T.escape(e) for e in U.BARE_ENDINGS)
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    has_job_path = T.matches(u, r"/jobs?/")
    parts = F.size(F.split(F.regexp_replace(url, r"/+$", ""), "/"))
    return (
        F.when(u.isNull() | (u == ""), True)
        .when(T.contains_any(u, U.BLOCKED_FRAGMENTS), False)
        .when(T.contains_any(u, U.CATEGORY_FRAGMENTS), False)
        .when(F.contains(u, F.lit("/c/")) & F.contains(u, F.lit("-jobs")), False)
        .when(F.contains(u, F.lit("/pages/careers")) & (slashes >= 4) & ~has_job_path, False)
        .when(T.contains_any(u, U.SEARCH_FRAGMENTS) & ~T.contains_any(u, U.SEARCH_ID_MARKS), False)
        .when(T.matches(u, rf"/(?:{words})/\d+"), True)
        .when(T.matches(u, r"/jobs?/[^/]+") & ~T.matches(u, r"/jobs?/?$"), True)
        .when(T.matches(u, r"/careers/?$"), False)
        .when(T.matches(u, rf"(?:{endings})/?$") & (parts <= 2), False)
        .otherwise(True)
    )


def board_of(url: Column, boards=None) -> Column:
    """First known board, in priority order, whose domain is part of the URL."""
    ladder = None
    for name, domain in boards or U.BOARDS:
        test = F.contains(F.lower(url), F.lit(domain))
        ladder = F.when(test, name) if ladder is None else ladder.when(test, name)
    return ladder


def platform_of(url: Column) -> Column:
    """Struct (platform, page_type, pagination_type) of the platform behind a URL."""
    lowered = F.lower(url)

    def settings(name, page_type, pagination):
        return F.struct(
            F.lit(name).cast("string").alias("platform"),
            F.lit(page_type).alias("page_type"),
            F.lit(pagination).alias("pagination_type"),
        )

    ladder = None
    for name, domain, page_type, pagination in U.PLATFORMS:
        test = F.contains(lowered, F.lit(domain))
        value = settings(name, page_type, pagination)
        ladder = F.when(test, value) if ladder is None else ladder.when(test, value)
    return ladder.otherwise(settings(None, *U.DEFAULT_PLATFORM))
