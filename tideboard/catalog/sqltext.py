"""Fragments of SQL used by the twins."""

from __future__ import annotations

import re

from tideboard.fixtures import BOARD_URL, DETAIL_PAGES_SQL, POSTING_PAGES_SQL, POSTINGS_SQL
from tideboard.rules import patterns as P

POSTINGS = f"postings AS ({POSTINGS_SQL})"
POSTING_PAGES = f"{POSTINGS}, posting_pages AS ({POSTING_PAGES_SQL})"
DETAIL_PAGES = f"{POSTINGS}, detail_pages AS ({DETAIL_PAGES_SQL})"
# What the cards of the result pages show, from the postings that the pages were made of.
CARDS = f"""{POSTINGS}, shown AS (SELECT posting_id AS page_id, CAST(0 AS BIGINT) AS pos, query_id, page_no, CAST(posting_id AS VARCHAR) AS job_id, title, company,
      CASE WHEN posting_id % 4 = 1 THEN '{BOARD_URL}/cmp/' || replace(company, ' ', '-') END AS company_url, location, salary_text, posted_text, description, coalesce(url, '#') AS link,
      list_filter([title, company, location, salary_text, CASE WHEN posting_id % 4 = 2 THEN 'We build tools.' ELSE description END,
        CASE WHEN posting_id % 4 = 2 THEN substr(description, 17) END, posted_text], lambda l: l IS NOT NULL) AS lines FROM postings
    UNION ALL SELECT posting_id, 1, query_id, page_no, 's' || posting_id, 'Platform Engineer', 'Acme Tools', NULL, 'Austin, TX', NULL, NULL, NULL, '/jobs/s' || posting_id,
      ['Platform Engineer', 'Acme Tools', 'Austin, TX'] FROM postings WHERE posting_id % 4 = 3),
    cards AS (SELECT page_id, pos, query_id, page_no, job_id, title, coalesce(company, list_filter(lines, lambda l: length(l) > 3 AND length(l) < 50
        AND NOT regexp_matches(l, '(?i)days ago|hours ago|just posted|salary|\\$|remote|full|part|time'))[2]) AS company, company_url,
      coalesce(location, list_filter(lines, lambda l: length(l) < 100 AND regexp_matches(l, ',|(?i:remote)|CA|NY|TX|FL|WA'))[1]) AS location, salary_text, posted_text, trim(description) AS description,
      CASE WHEN link LIKE '/%' THEN '{BOARD_URL}' || link WHEN link LIKE 'http%' THEN link END AS url, array_to_string(lines, ' ') AS card_text FROM shown)"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(words) -> str:
    return ", ".join(q(w) for w in words)


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def literal(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def one_of(words) -> str:
    return "(" + "|".join(literal(w) for w in words) + ")"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def clean(x: str) -> str:
    squeezed = sub(x, r"\s+", " ")
    return f"trim({sub(squeezed, r'[^\p{L}\p{N}_\s\-.,;:!?()/&$%]')})"


def words(x: str) -> str:
    s = squeeze(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END)"


def extract(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def first_found(x: str, patterns, longer: int = 0) -> str:
    """First pattern that yields more than ``longer`` characters."""
    arms = []
    for p in patterns:
        f = squeeze(extract(x, p))
        arms.append(f"WHEN length({f}) > {longer} THEN {f}")
    return "CASE " + " ".join(arms) + " END"


def ladder(x: str, labelled) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p)} THEN {q(label)}" for label, p in labelled) + " END"


def decode(x: str) -> str:
    for entity, char in P.ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def drop_tags(x: str, names) -> str:
    x = sub(x, r"(?s)<!--.*?-->", " ")
    for n in names:
        x = sub(x, rf"(?is)<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)", " ")
    return x


def plain(x: str) -> str:
    """Text of an HTML fragment."""
    return squeeze(decode(sub(x, r"<[^>]*>", " ")))


CHROME = ("nav", "header", "footer", "script", "style")
HIDDEN = ("script", "style")
