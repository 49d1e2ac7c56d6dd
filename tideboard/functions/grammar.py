"""Phrases for pay and for the age of a posting, as small grammars: named parts, and the forms that are made of them.
A text has the phrase of the first form that it has."""

from __future__ import annotations

from collections.abc import Iterable

from tideboard.rules import patterns as P


def _one(words: Iterable[str]) -> str:
    """One of the words or phrases, with any white space in a phrase."""
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


# --- pay: an amount, a range of two, what opens it, the period that it is for

_GROUPED = r"\d{1,3}(?:,\d{3})*"
_NUMBER = r"\d+(?:,\d+)*(?:\.\d+)?"
_DOLLARS = rf"\$\s*{_NUMBER}k?"
_AMOUNT = rf"(?:{_DOLLARS}|{_NUMBER}k\b)"
_PER_UNIT = rf"(?:(?:/|per)\s*{_one(P.PAY_UNITS)}|{_one(P.PAY_ADVERBS)})"

PAY_FORMS = {
    "range": rf"(?i){_AMOUNT}\s*{_one(P.RANGE_MARKS)}\s*{_AMOUNT}(?:\s*{_one(P.YEARLY)})?",
    "paid": rf"(?i){_DOLLARS}\s*{_PER_UNIT}",
    "named": rf"(?i){_GROUPED}\s*-\s*{_GROUPED}\s*{_one(P.PLAIN_RANGE_ENDS)}",
    "open": rf"(?i){_one(P.PAY_OPENERS)}\s*{_DOLLARS}",
}

# --- age: a count of units gone by, a word, a window, a date

_COUNTED = rf"\d+\+?\s+{_one(P.AGE_UNITS)}s?"
_MONTH = _one(P.MONTHS)

DATE_FORMS = {
    "us": r"\d{1,2}/\d{1,2}/\d{4}",
    "iso": r"\d{4}-\d{2}-\d{2}",
    "month first": rf"{_MONTH}[a-z]*\s+\d{{1,2}},?\s+\d{{4}}",
    "day first": rf"\d{{1,2}}\s+{_MONTH}[a-z]*\s+\d{{4}}",
}
AGE_FORMS = {
    "ago": rf"(?i){_COUNTED}\s+ago",
    "word": rf"(?i){_one(P.AGE_WORDS)}",
    "window": rf"(?i)(?:with)?in\s+the\s+last\s+{_COUNTED}",
    "date": "(?:" + "|".join(DATE_FORMS.values()) + ")",
}
