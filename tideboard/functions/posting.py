"""Fields of a posting read from its text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideboard.functions import elements as E
from tideboard.functions import grammar as G
from tideboard.functions import html as H
from tideboard.functions import text as T
from tideboard.rules import aliases as A
from tideboard.rules import lexicons as L
from tideboard.rules import patterns as P
from tideboard.rules import selectors as S

HOURS_PER_YEAR = 2080


CARD_ELEMENTS = {
    "title": E.first(S.CARD_TITLE),
    "company": E.first(S.CARD_COMPANY),
    "location": E.first(S.CARD_LOCATION),
    "salary": E.first(S.CARD_SALARY),
    "posted": E.first(S.CARD_POSTED),
    "description": E.first(S.CARD_DESCRIPTION),
}
DETAIL_ELEMENTS = {
    "salary": E.every(S.DETAIL_SALARY),
    "salary_boxes": E.every(S.DETAIL_SALARY_BOXES, "span|div"),
    "posted": E.first(S.DETAIL_POSTED),
    "description": E.first(S.DETAIL_DESCRIPTION),
    "benefits": E.every(S.DETAIL_BENEFITS, "li|span|div"),
    "requirements": E.every(S.DETAIL_REQUIREMENTS, "li|p|div"),
    "skills": E.every(S.DETAIL_SKILLS),
    "industry": E.first(S.DETAIL_INDUSTRY),
    "size": E.first(S.DETAIL_SIZE),
}


def card_parts(card_html: Column, names: Sequence[str] = tuple(CARD_ELEMENTS)) -> Column:
    """The elements of a card that its fields, or the named ones of them, are read from, found in one scan of the source."""
    return E.parts(card_html, {name: CARD_ELEMENTS[name] for name in names})


def detail_parts(html: Column, names: Sequence[str] = tuple(DETAIL_ELEMENTS)) -> Column:
    """The elements of a posting's own page that its fields, or the named ones of them, are read from, found in one scan
    of the source."""
    return E.parts(html, {name: DETAIL_ELEMENTS[name] for name in names})


def _part(card_html: Column, parts: Column | None, name: str) -> Column:
    return (card_parts(card_html, [name]) if parts is None else parts)[name]


# --- place and work mode -------------------------------------------------------------------

def location_in_text(text: Column) -> Column:
    return T.first_pattern(text, P.LOCATION_PATTERNS)


def location_of_card(card_html: Column, parts: Column | None = None) -> Column:
    """Location of a card: the location elements first, then a short text that looks like a place."""
    place_like = F.filter(
        H.text_lines(card_html),
        lambda line: (F.length(line) < 100) & T.matches(line, r",|(?i:remote)|CA|NY|TX|FL|WA"),
    )
    return F.coalesce(E.first_text(_part(card_html, parts, "location")), F.get(place_like, 0))


def work_mode_in_text(text: Column) -> Column:
    return T.first_label(text, P.WORK_MODE_PATTERNS)


@T.on_value
def work_mode_of_location(location: Column) -> Column:
    place = F.lower(location)
    remote = F.contains(place, F.lit("remote"))
    return (
        F.when(remote & F.contains(place, F.lit("hybrid")), "Hybrid")
        .when(remote, "Remote")
        .when(T.blank_to_null(place).isNotNull(), "On-site")
    )


# --- employment ----------------------------------------------------------------------------

def employment_type(text: Column) -> Column:
    lowered = F.lower(text)
    return T.first_label(lowered, [(name, T.whole_word([words], raw=True)) for name, words in A.EMPLOYMENT_WORDS])


def job_type(text: Column) -> Column:
    return T.first_label(F.lower(text), [(name, T.escape(word)) for word, name in A.JOB_TYPES])


def experience_level(text: Column) -> Column:
    return T.first_label(F.lower(text), [(name, T.any_of(words)) for name, words in A.LEVEL_WORDS])


# --- salary --------------------------------------------------------------------------------

@T.on_value
def salary_text(text: Column) -> Column:
    """Pay in a text: a range, else an amount for a period, a range with a currency, or a bound. Texts without a digit
    are not searched."""
    return F.when(T.matches(text, r"\d"), T.first_pattern(text, list(G.PAY_FORMS.values()), longer_than=5))


def salary_of_card(card_html: Column, text: Column | None = None, parts: Column | None = None) -> Column:
    """Salary of a card: text beside the apply button, salary elements, then the whole text, which
    may be given if it is at hand."""
    beside_apply = T.squeeze(
        F.regexp_extract(
            card_html,
            r"(?is)<(?:span|div)\b[^>]*class=\"[^\"]*(?:salary|pay|compensation|attribute)[^\"]*\"[^>]*>([^<]*\$[^<]*)"
            r"</(?:span|div)>\s*<(?:a|button|div|span)\b[^>]*(?:class|data-testid)=\"[^\"]*apply",
            1,
        )
    )
    element = E.first_text(_part(card_html, parts, "salary"))
    return F.coalesce(
        T.longer(beside_apply, 5),
        T.once(element, lambda e: F.when(T.matches(e, r"(?i)\$|salary|pay") & (F.length(e) > 5), e)),
        salary_text(H.strip_tags(card_html) if text is None else text),
    )


def salary_of_page(text: Column, parts: Column) -> Column:
    """Salary of a detail page: the first in its text, else an element that names an amount and what it is for."""
    named = F.filter(
        F.concat(E.texts(parts["salary_boxes"]), E.texts(parts["salary"])),
        lambda e: F.contains(e, F.lit("$")) & T.contains_any(F.lower(e), S.SALARY_ELEMENT_WORDS) & (F.length(e) > 5),
    )
    return F.coalesce(salary_text(text), F.get(named, 0))


@T.on_value
def salary_bounds(text: Column) -> Column:
    """Struct (salary_min, salary_max, salary_period). Bounds are yearly; hourly pay counts a
    full year of 2,080 hours. One-sided texts leave the other bound NULL."""
    number = r"\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*([kK]?)"
    range_pattern = rf"{number}\s*(?:-|–|to)\s*{number}"
    is_range = T.matches(text, range_pattern)
    hourly = T.matches(text, r"(?i)(?:/|per|an)\s*(?:hour|hr)|hourly")
    yearly = T.matches(text, r"(?i)(?:/|per|a)\s*(?:year|yr)|annual|yearly")

    def amount(pattern: str, group: int) -> Column:
        digits = F.regexp_extract(text, pattern, group)
        thousand = F.lower(F.regexp_extract(text, pattern, group + 1)) == "k"
        value = F.replace(digits, F.lit(","), F.lit("")).try_cast("decimal(18,2)")
        factor = F.when(thousand, 1000).otherwise(1) * F.when(hourly, HOURS_PER_YEAR).otherwise(1)
        return (value * factor).cast("decimal(26,2)").try_cast("bigint")

    up_to = T.matches(text, r"(?i)up\s+to")
    at_least = T.matches(text, r"(?i)\bfrom\b|starting\s+at")
    single = amount(number, 1)
    low = F.when(is_range, amount(range_pattern, 1)).when(~up_to, single)
    high = F.when(is_range, amount(range_pattern, 3)).when(~at_least, single)
    known = low.isNotNull() | high.isNotNull()
    return F.struct(
        low.alias("salary_min"),
        high.alias("salary_max"),
        F.when(known & hourly, "hour").when(known & yearly, "year").alias("salary_period"),
    )


# --- posting time --------------------------------------------------------------------------

def posted_text(text: Column) -> Column:
    """Age of a posting in a text: so long ago, else a word for it, a window of time, or a date."""
    return T.first_pattern(text, list(G.AGE_FORMS.values()), longer_than=2)


def posted_of_card(card_html: Column, text: Column | None = None, parts: Column | None = None) -> Column:
    """Posting time of a card: patterns on its text, else a date element that names an age."""
    in_text = posted_text(H.strip_tags(card_html) if text is None else text)
    return F.coalesce(in_text, _age(_part(card_html, parts, "posted")))


def _age(found: Column) -> Column:
    age = r"(?i)ago|posted|today|yesterday|active|just"
    return F.get(F.filter(E.texts(found), lambda e: T.matches(e, age) & (F.length(e) > 2)), 0)


def posted_of_page(text: Column, parts: Column) -> Column:
    """Posting time of a detail page: patterns on its text, else a date element that names an age."""
    return F.coalesce(posted_text(text), _age(parts["posted"]))


@T.on_value
def posted_at(text: Column, as_of: Column) -> Column:
    """Instant a posting went up, seen from ``as_of`` (a timestamp without zone). "30+ days ago"
    means at least 30 days, so the latest possible instant is given."""
    t = F.lower(F.trim(text))
    ago = r"(\d+)\+?\s+(day|hour|min)[a-z]*\s+ago"
    n = F.regexp_extract(t, ago, 1).try_cast("int")
    unit = F.regexp_extract(t, ago, 2)
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?", 0)
    us, month_first, day_first = (F.regexp_extract(text, G.DATE_FORMS[k], 0) for k in ("us", "month first", "day first"))
    month_first = F.regexp_replace(month_first, r"^(\w{3})[a-z]*\s+(\d+),?\s+(\d+)$", "$2 $1 $3")
    day_first = F.regexp_replace(day_first, r"^(\d+)\s+(\w{3})[a-z]*\s+(\d+)$", "$1 $2 $3")

    def parsed(c: Column, *formats: str) -> Column:
        tries = [F.try_to_timestamp(T.blank_to_null(c), F.lit(f)) for f in formats]
        return F.coalesce(*tries).cast("timestamp_ntz")

    return (
        F.when(T.matches(t, r"today|just posted|just now"), as_of)
        .when(F.contains(t, F.lit("yesterday")), as_of - F.make_dt_interval(F.lit(1)))
        .when(unit == "day", as_of - F.make_dt_interval(n))
        .when(unit == "hour", as_of - F.make_dt_interval(F.lit(0), n))
        .when(unit == "min", as_of - F.make_dt_interval(F.lit(0), F.lit(0), n))
        .otherwise(
            F.coalesce(
                parsed(iso, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"),
                parsed(us, "M/d/yyyy"),
                parsed(month_first, "d MMM yyyy"),
                parsed(day_first, "d MMM yyyy"),
            )
        )
    )


# --- description, requirements, skills, benefits -------------------------------------------

def _best_lines(lines: Column, min_length: int, min_words: int, stop_words: Sequence[str]) -> Column:
    return F.filter(
        lines,
        lambda line: (F.length(line) > min_length)
        & ~T.contains_any(F.lower(line), stop_words)
        & (F.upper(line) != line)
        & ~T.matches(line, P.NOT_A_DESCRIPTION)
        & (T.word_count(line) > min_words),
    )


def description_line(lines: Column, limit: int | None = None) -> Column:
    """First line of a list card that reads like a description, cut only where a limit is given."""
    found = T.squeeze(F.get(_best_lines(lines, 40, 6, P.CARD_LINE_STOP_WORDS), 0))
    return found if limit is None else T.truncate(found, limit)


def detail_description_line(lines: Column) -> Column:
    """Longest formatted line of a detail page that reads like a description; the first one of equals."""
    found = F.transform(_best_lines(lines, 200, 15, P.DETAIL_LINE_STOP_WORDS), formatted_description)
    return F.aggregate(
        found,
        F.lit(None).cast("string"),
        lambda best, line: F.when(F.length(line) > F.coalesce(F.length(best), F.lit(0)), line).otherwise(best),
    )


def description_of_card(card_html: Column, parts: Column | None = None, limit: int | None = None) -> Column:
    """Description of a card: the description elements, else a line that reads like one. Cut only where a limit is given."""
    first = F.regexp_replace(E.first_text(_part(card_html, parts, "description"), 15), P.DESCRIPTION_LABEL, "")
    from_element = first if limit is None else T.truncate(first, limit)
    return F.coalesce(from_element, description_line(H.text_lines(card_html), limit))


def description_of_page(html: Column, parts: Column | None = None) -> Column:
    """Description of a detail page: the first description element with over 100 characters, formatted, else the longest
    line of the page that reads like one."""
    # An element that several selectors find is formatted once.
    shown = F.array_distinct(E.texts((detail_parts(html, ["description"]) if parts is None else parts)["description"]))
    found = F.transform(shown, formatted_description)
    whole = F.get(F.filter(found, lambda t: F.length(t) > 100), 0)
    return F.coalesce(whole, detail_description_line(H.text_lines(html)))


def formatted_description(text: Column) -> Column:
    """Readable text: references decoded, boilerplate dropped, then cut into sentences, headings and paragraphs, which
    are joined again with a space, a line and an empty line."""
    body = F.regexp_replace(T.decode_entities(text), rf"(?i)^{T.any_of(P.DESCRIPTION_LABELS)}:\s*", "")
    is_chrome = rf"(?i)^{T.any_of(P.CHROME_LINES)}"
    kept = F.transform(F.split(body, "\n"), lambda line: F.when(T.matches(line, is_chrome), "").otherwise(line))
    passages = "|".join(".*?".join(T.escape(part) for part in passage) for passage in P.BOILERPLATE)
    out = F.regexp_replace(F.array_join(kept, "\n"), f"(?is){passages}", "")
    out = F.array_join(F.split(out, r"(?<=[.!?a-z])(?=[A-Z])"), " ")
    out = F.array_join(F.split(out, f"(?={T.any_of(P.LINE_HEADINGS)})"), "\n")
    out = F.array_join(F.split(out, f"(?={T.any_of(P.PARAGRAPH_HEADINGS)})"), "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return T.strip_space(F.array_join(F.split(out, r"\n(?:\s*\n){2,}"), "\n\n"))


@T.on_value
def requirements(text: Column) -> Column:
    """All sentences that state requirements."""
    found = F.flatten(
        F.array(
            *[
                F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), T.strip_space)
                for p in P.REQUIREMENT_PATTERNS
            ]
        )
    )
    return F.filter(found, lambda r: (F.length(r) > 10) & (F.length(r) < 200))


def requirement_section(text: Column, limit: int | None = None) -> Column:
    """The text from the first requirements heading on, in the order of the heading list. Cut only where a limit is given."""
    lowered = F.lower(text)
    length = F.length(text) if limit is None else F.lit(limit)
    found = [
        F.when(F.instr(lowered, h) > 0, F.substring(text, F.instr(lowered, h), length)) for h in L.REQUIREMENT_HEADINGS
    ]
    return T.clean_text(F.coalesce(*found))


def _marked_items(items: Column, words: Sequence[str], longer: int, shorter: int) -> Column:
    fitting = F.filter(
        items,
        lambda i: T.contains_any(F.lower(i), words) & (F.length(i) > longer) & (F.length(i) < shorter),
    )
    return F.array_sort(F.array_distinct(fitting))


def requirement_items(items: Column) -> Column:
    """Sorted distinct list items of a detail page that state requirements."""
    return _marked_items(items, L.REQUIREMENT_ITEM_WORDS, 10, 200)


def benefit_items(items: Column) -> Column:
    """Sorted distinct list items of a detail page that state benefits."""
    return _marked_items(items, L.BENEFIT_ITEM_WORDS, 5, 100)


def _token_pattern(terms: Sequence[str]) -> str:
    """Terms between characters that are no part of a term. One pass over the text finds them all:
    the look-around leaves the separators for the next hit."""
    longest_first = sorted(terms, key=len, reverse=True)
    return r"(?<![\p{L}\p{N}_])(" + "|".join(T.escape(t) for t in longest_first) + r")(?![\p{L}\p{N}_+#])"


def _overlapping(terms: Sequence[str]) -> bool:
    """Whether one term can hide inside the hit of another one."""
    return any(a != b and f" {a} " in f" {b} " for a in terms for b in terms)


def terms_in(text: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """Display forms of the lexicon terms that occur in the text as whole tokens, in lexicon order."""
    lowered = F.lower(text)
    terms = [term for term, _ in lexicon]
    if _overlapping(terms):
        found = F.array_compact(F.array(*[F.when(T.matches(lowered, _token_pattern([t])), t) for t in terms]))
    else:
        found = F.regexp_extract_all(lowered, F.lit(_token_pattern(terms)), F.lit(1))
    shown = F.expr(f"map({T.constants(*[x for pair in lexicon for x in pair])})")
    in_order = F.array_intersect(F.expr(f"array({T.constants(*terms)})"), found)
    return F.transform(in_order, lambda term: F.try_element_at(shown, term))


def skills(description: Column, whole_text: Column | None = None, limit: int | None = None) -> Column:
    """Skills named in the description, else in the whole text."""
    found = terms_in(description, L.SKILLS)
    if whole_text is not None:
        rest = terms_in(whole_text, L.SKILLS)
        found = T.once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))
    return found if limit is None else F.slice(found, 1, limit)


def _phrases_in(text: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    terms = F.expr(f"array({T.constants(*[term for term, _ in lexicon])})")
    shown = F.expr(f"map({T.constants(*[x for pair in lexicon for x in pair])})")
    found = T.once(F.lower(text), lambda t: F.filter(terms, lambda term: F.contains(t, term)))
    return F.transform(found, lambda term: F.try_element_at(shown, term))


def benefits(text: Column, limit: int | None = None) -> Column:
    found = _phrases_in(text, L.BENEFITS)
    return found if limit is None else F.slice(found, 1, limit)


def industry(text: Column) -> Column:
    return T.first_label(F.lower(text), [(shown, T.escape(term)) for term, shown in L.INDUSTRIES])


def industry_of_page(html: Column, found: Column | None = None) -> Column:
    """Industry element of a detail page, 4 to 99 characters long. ``found`` are the elements, if they are at hand."""
    found = E.parts(html, {"industry": E.first(S.DETAIL_INDUSTRY)})["industry"] if found is None else found
    return F.get(F.filter(E.texts(found), lambda t: (F.length(t) > 3) & (F.length(t) < 100)), 0)


def company_size_of_page(html: Column, found: Column | None = None) -> Column:
    """Company size element of a detail page: the first that names a size."""
    found = E.parts(html, {"size": E.first(S.DETAIL_SIZE)})["size"] if found is None else found
    return F.get(F.filter(E.texts(found), lambda t: T.contains_any(F.lower(t), S.COMPANY_SIZE_WORDS)), 0)


def company_size(text: Column) -> Column:
    return T.first_pattern(text, P.COMPANY_SIZE_PATTERNS)


# --- company and title of a card -----------------------------------------------------------

def company_of_card(card_html: Column, parts: Column | None = None) -> Column:
    """Company of a card: the company elements first, then a short text without job words."""
    noise = r"(?i)days ago|hours ago|just posted|salary|\$|remote|full|part|time"
    plain = F.filter(
        H.text_lines(card_html),
        lambda line: (F.length(line) > 3) & (F.length(line) < 50) & ~T.matches(line, noise),
    )
    return F.coalesce(E.first_text(_part(card_html, parts, "company"), 1), F.get(plain, 1))


def company_url_of_card(card_html: Column, base: str, parts: Column | None = None) -> Column:
    """Link of a card to its company: the link that the company element is or holds, else the first link that names a
    company or employer page."""
    element = F.get(F.filter(_part(card_html, parts, "company"), lambda p: F.length(p["text"]) > 1), 0)
    named = F.filter(
        F.transform(H.links(card_html), lambda a: a["href"]), lambda h: T.matches(h, r"(?i)company|employer")
    )
    found = F.coalesce(T.blank_to_null(element["link"]), F.get(named, 0))
    return T.once(found, lambda h: F.when(F.startswith(h, F.lit("http")), h).otherwise(F.concat(F.lit(base), h)))


def title_of_card(card_html: Column, parts: Column | None = None) -> Column:
    """Title of a card without badges."""
    first = E.first_text(_part(card_html, parts, "title"), 3)
    return T.strip_space(F.regexp_replace(first, P.TITLE_BADGES, ""))


def page_title(html: Column, opening_chars: int | None = None) -> Column:
    """Title of an element or page: the longest of the selector hits, else the first fitting line, else the text up to
    a separator, of which ``opening_chars`` may limit the part that is looked at."""
    candidates = E.texts(E.parts(html, {"title": E.first(S.PAGE_TITLE)})["title"])
    fitting = F.filter(candidates, lambda t: F.length(t).between(3, 200))
    longest = F.aggregate(
        fitting,
        F.lit(None).cast("string"),
        lambda best, t: F.when(F.length(t) > F.coalesce(F.length(best), F.lit(0)), t).otherwise(best),
    )
    lines = F.filter(
        H.text_lines(html),
        lambda line: F.length(line).between(5, 200) & ((F.upper(line) != line) | (T.word_count(line) >= 2)),
    )
    shown = H.visible_text(html, H.HIDDEN_TAGS)
    start = shown if opening_chars is None else F.trim(F.left(shown, F.lit(opening_chars)))
    opening = T.longer(F.regexp_extract(start, r"^(.*?)(?:\. | - | \| |$)", 1), 2)
    return F.coalesce(longest, F.get(lines, 0), opening)
