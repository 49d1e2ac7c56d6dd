"""Predicates. Each criterion is a column, so a search is one filter that Catalyst can split and
push. An unset criterion is None; 0 is a value. A posting without the tested field passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.functions import verdicts as V
from tideboard.operators.extract import AS_OF, instant
from tideboard.rules import aliases as A
from tideboard.rules import pages as R
from tideboard.rules import places as PL

SEARCHED = ("title", "description", "location", "employment_type", "remote_type", "requirements")
FALLBACK_SEARCHED = ("title", "description", "location")


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(True))


# --- criteria as columns -------------------------------------------------------------------

def has_keyword(df: DataFrame, query: str, fields=SEARCHED) -> Column:
    types = dict(df.dtypes)
    parts = [
        F.array_join(F.col(f), " ") if types[f].startswith("array") else F.col(f) for f in fields if f in types
    ]
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(query.lower()))


def place_pattern(words) -> str:
    """Words anywhere in lower-cased text as whole words; two-letter codes only after a comma."""
    codes = [w for w in words if len(w) == 2]
    names = [w for w in words if len(w) > 2]
    tests = []
    if names:
        tests.append(T.whole_word(names))
    if codes:
        tests.append(r",\s*" + T.any_of(codes) + r"(?:$|[^\p{L}\p{N}_])")
    return "|".join(tests)


def matches_place(location: Column, remote_type: Column, wanted: str) -> Column:
    """Whether a posting fits a place search. Remote postings fit every place."""
    wanted = wanted.lower().strip()
    place = F.lower(location)
    is_remote = F.coalesce(F.lower(remote_type) == "remote", F.lit(False))
    if wanted in PL.REMOTE_SEARCHES:
        return location.isNull() | (location == "") | is_remote
    alias = {row[0]: row[1:] for row in PL.alias_rows()}.get(wanted)
    if alias is None:
        fits = F.contains(place, F.lit(wanted))
    else:
        kind, canonical, words = alias
        if kind == "country" and canonical == "United States":
            fits = T.matches(place, united_states_pattern())
        elif kind == "state":
            # Codes may also stand alone in capitals, as in "Austin TX".
            alone = T.matches(location, rf"\b{words[1].upper()}\b")
            fits = T.matches(place, place_pattern(words)) | alone
        else:
            fits = T.matches(place, place_pattern(words))
    return location.isNull() | (location == "") | is_remote | fits


def united_states_pattern() -> str:
    """"United States", "USA" or "US", or a state code after the last comma, also before "US"."""
    codes = "|".join(PL.US_STATES.values())
    return (
        r"united states|(?:^|[^\p{L}\p{N}_])usa?(?:$|[^\p{L}\p{N}_])"
        rf"|,\s*(?:{codes})(?:\s+(?:usa?|united states))?\s*$"
    )


def matches_work_mode(remote_type: Column, title: Column, description: Column, mode: str) -> Column:
    mode = mode.lower().strip()
    for spellings, modes, words in A.WORK_MODES:
        if mode in spellings:
            text = F.lower(F.concat_ws(" ", title, description))
            return F.coalesce(F.lower(remote_type), F.lit("")).isin(modes) | T.contains_any(text, words)
    return F.lit(True)


def matches_salary(salary_min: Column, salary_max: Column, low: int | None, high: int | None) -> Column:
    """Whether the salary range overlaps the wanted one. A missing bound is open."""
    tests = []
    if low is not None:
        tests.append(_known(salary_max >= low))
    if high is not None:
        tests.append(_known(salary_min <= high))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matches_experience(experience_level: Column, wanted: str) -> Column:
    code = dict(A.EXPERIENCE_ROWS).get(wanted.lower().strip())
    return F.lit(True) if code is None else _known(experience_level == A.LEVEL_NAMES[code])


def matches_employment(employment_type: Column, wanted: str) -> Column:
    kind = dict(A.EMPLOYMENT_ROWS).get(wanted.lower().strip())
    if kind is None:
        return F.lit(True)
    # A contract search also asks for freelance work.
    kinds = [kind] + (["Freelance"] if kind == "Contract" else [])
    return _known(employment_type.isin(kinds))


def matches_recency(posted_at: Column, days: int, as_of: str | Column) -> Column:
    """Whether at most ``days`` whole days lie between the posting and ``as_of``."""
    age = F.timestamp_diff("SECOND", posted_at, instant(as_of))
    return _known(F.floor(age / 86400) <= days)


# --- filters -------------------------------------------------------------------------------

def filter_keyword(df: DataFrame, query: str | None, fields=SEARCHED) -> DataFrame:
    return df if query is None else df.filter(has_keyword(df, query, fields))


def filter_location(df: DataFrame, location: str | None) -> DataFrame:
    return df if location is None else df.filter(matches_place(F.col("location"), F.col("remote_type"), location))


def filter_work_mode(df: DataFrame, mode: str | None) -> DataFrame:
    if mode is None:
        return df
    return df.filter(matches_work_mode(F.col("remote_type"), F.col("title"), F.col("description"), mode))


def filter_salary(df: DataFrame, salary_min: int | None = None, salary_max: int | None = None) -> DataFrame:
    return df.filter(matches_salary(F.col("salary_min"), F.col("salary_max"), salary_min, salary_max))


def filter_experience(df: DataFrame, level: str | None) -> DataFrame:
    return df if level is None else df.filter(matches_experience(F.col("experience_level"), level))


def filter_employment(df: DataFrame, employment: str | None) -> DataFrame:
    return df if employment is None else df.filter(matches_employment(F.col("employment_type"), employment))


def filter_recency(df: DataFrame, days: int | None, as_of: str | Column = AS_OF) -> DataFrame:
    return df if days is None else df.filter(matches_recency(F.col("posted_at"), days, as_of))


def search(
    df: DataFrame,
    query: str | None = None,
    location: str | None = None,
    job_type: str | None = None,
    salary_min: int | None = None,
    salary_max: int | None = None,
    experience_level: str | None = None,
    employment_type: str | None = None,
    days_old: int | None = None,
    as_of: str | Column = AS_OF,
) -> DataFrame:
    """All criteria of a search as one filter."""
    return df.filter(
        search_condition(
            df, query, location, job_type, salary_min, salary_max, experience_level, employment_type, days_old, as_of
        )
    )


def search_condition(
    df, query=None, location=None, job_type=None, salary_min=None, salary_max=None,
    experience_level=None, employment_type=None, days_old=None, as_of: str | Column = AS_OF,
) -> Column:
    tests = [matches_salary(F.col("salary_min"), F.col("salary_max"), salary_min, salary_max)]
    if query is not None:
        tests.append(has_keyword(df, query))
    if location is not None:
        tests.append(matches_place(F.col("location"), F.col("remote_type"), location))
    if job_type is not None:
        tests.append(matches_work_mode(F.col("remote_type"), F.col("title"), F.col("description"), job_type))
    if experience_level is not None:
        tests.append(matches_experience(F.col("experience_level"), experience_level))
    if employment_type is not None:
        tests.append(matches_employment(F.col("employment_type"), employment_type))
    if days_old is not None:
        tests.append(matches_recency(F.col("posted_at"), days_old, as_of))
    return reduce(lambda a, b: a & b, tests)


# --- verdicts ------------------------------------------------------------------------------

def classify_url(df: DataFrame, url="url", out="is_job_url") -> DataFrame:
    return df.withColumn(out, U.is_job_url(F.col(url)))


def classify_title(df: DataFrame, title="title", out="is_job_title") -> DataFrame:
    return df.withColumn(out, V.is_job_title(F.col(title)))


def explain_postings(df: DataFrame, strict: bool = False, out="reject_reason") -> DataFrame:
    """Every posting with the reason for which it is rejected, NULL when it is kept."""
    reason = V.reject_reason(F.col("title"), F.col("url"))
    if strict:
        reason = F.coalesce(reason, V.strict_reason(F.col("title"), F.col("description")))
    return df.withColumn(out, reason)


def validate_postings(df: DataFrame, strict: bool = False) -> DataFrame:
    """The postings that are kept."""
    return explain_postings(df, strict, "_reason").filter(F.col("_reason").isNull()).drop("_reason")


def rejected_postings(df: DataFrame, strict: bool = False) -> DataFrame:
    """The postings that are not kept, with the reason."""
    return explain_postings(df, strict).filter(F.col("reject_reason").isNotNull())


def filter_cards(cards: DataFrame, html="html") -> DataFrame:
    """Cards that hold a posting: an id, a title link, a company, a place or a job-like class."""
    c = F.col(html)
    return cards.filter(
        T.matches(c, r"(?i)^\s*<[^>]*\bdata-jk=")
        | T.matches(c, r"(?is)<a\b[^>]*class\s*=\s*[\"']?[^\"'>]*(?:jcs-JobTitle|jobTitle)|<h[23]\b[^>]*>\s*<a\b")
        | T.matches(c, r"(?i)<(?:span|div|a)\b[^>]*class\s*=\s*[\"']?[^\"'>]*company")
        | T.matches(c, r"(?i)<(?:span|div)\b[^>]*class\s*=\s*[\"']?[^\"'>]*location")
        | T.matches(c, r"(?i)^\s*<[^>]*class\s*=\s*[\"']?[^\"'>]*(?:job|result|listing|card)")
    )


def prefilter_elements(df: DataFrame, text="text", chars: int | None = None) -> DataFrame:
    """Drops list headers, tiny controls and short texts without a sign of a posting. ``chars`` limits the part of the
    text that is looked at."""
    shown = F.lower(F.col(text) if chars is None else F.left(F.col(text), F.lit(chars)))
    lines = F.size(F.split(shown, "\n"))
    header = T.contains_any(shown, R.HEADER_MARKS) & (lines < 3)
    marked = T.contains_any(shown, R.ELEMENT_JOB_MARKS)
    return df.filter(~header & (F.length(shown) >= 10) & (marked | (F.length(shown) >= 30)))
