"""Text helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import wraps
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideboard.rules import patterns as P

NOT_WORD = r"[^\p{L}\p{N}_]"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def on_value(fn):
    """Decorator for a function of one column: the column is computed once per row."""

    @wraps(fn)
    def bound(c: Column, *args, **options) -> Column:
        return once(c, lambda value: fn(value, *args, **options))

    return bound


def escape(text: str) -> str:
    """Quote the characters that mean something in a pattern."""
    return "".join("\\" + c if c in r".^$*+?()[]{}|\&-#" else c for c in text)


def any_of(words: Iterable[str]) -> str:
    """Pattern that finds one of the words anywhere."""
    return "(?:" + "|".join(escape(w) for w in words) + ")"


def whole_word(words: Iterable[str], raw: bool = False) -> str:
    """Pattern that finds one of the words, not as part of a longer word, in any script."""
    body = "|".join(words if raw else (escape(w) for w in words))
    return f"(?:^|{NOT_WORD})(?:{body})(?:$|{NOT_WORD})"


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    return matches(lowered, any_of(words))


def constants(*values: str) -> str:
    """The texts as a comma-separated list of SQL literals, for constant arrays and maps."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def is_one_of(c: Column, words: Sequence[str]) -> Column:
    return c.isin(list(words))


def explode_once(df, keep, array: Column, pos: str, value: str):
    """One row per array element with its position. The outer form plus a test on the position
    computes the array once; of the inner form the optimizer derives a filter on the array's
    size, which computes it a second time."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("bigint"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Squeezed text with word characters and basic punctuation only."""
    kept = r"[^\p{L}\p{N}_\s\-.,;:!?()/&$%]"
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), kept, ""))


@on_value
def truncate(c: Column, limit: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(tail))).otherwise(c)


def title_case(c: Column) -> Column:
    """Capital after every character that is not a letter, as in "3Com" or "Node.Js"."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    shown = F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)))
    return F.array_join(shown, "")


def word_count(c: Column) -> Column:
    """Number of words between white space; 0 for blank text."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def first_match(*candidates: Column) -> Column:
    """First candidate with text in it."""
    return F.coalesce(*[blank_to_null(F.trim(c)) for c in candidates])


@on_value
def first_pattern(c: Column, patterns: Sequence[str], longer_than: int = 0) -> Column:
    """Text found by the first pattern that yields more than ``longer_than`` characters."""
    found = [squeeze(F.regexp_extract(c, p, 0)) for p in patterns]
    return F.coalesce(*[longer(f, longer_than) for f in found])


def longer(c: Column, than: int) -> Column:
    """The text if it has more characters than that."""
    return blank_to_null(c) if than == 0 else once(c, lambda t: F.when(F.length(t) > than, t))


@on_value
def first_label(c: Column, labelled: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern that is found."""
    ladder = None
    for label, pattern in labelled:
        test = matches(c, pattern)
        ladder = F.when(test, label) if ladder is None else ladder.when(test, label)
    return ladder


@on_value
def decode_entities(c: Column, in_attribute: bool = False) -> Column:
    """Character references to characters, by the names and rules of HTML: names without a semicolon by their longest
    prefix that is one, except, in attributes, before "=", letters and digits; numbers of C1 controls as Windows-1252,
    numbers of other controls as nothing. Numbers of no character stay as they are. A no-break space's name is a space.
    Text without "&" is passed through untouched."""
    pieces = F.split(c, "&")
    tail = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    shown = F.transform(tail, lambda piece: F.when(F.startswith(piece, F.lit("#")), _numbered(piece)).otherwise(_named(piece, in_attribute)))
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(pieces, 0), F.array_join(shown, ""))).otherwise(c)


_NAMES = {name[:-1]: shown for name, shown in html5.items() if name.endswith(";")} | {"nbsp": " "}
_SHORT = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_C1 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _name_lists() -> list[str]:
    """By each first letter, from "A" on, the names with what they show, marked off by a control character."""
    by_first = ["" for _ in range(ord("A"), ord("z") + 1)]
    for name, shown in _NAMES.items():
        by_first[ord(name[0]) - ord("A")] += f"\x01{name};{shown}\x01"
    return by_first


_LISTS = _name_lists()


def _named(piece: Column, in_attribute: bool) -> Column:
    whole = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    short = F.regexp_extract(piece, rf"^({'|'.join(_SHORT)}){'(?![=A-Za-z0-9])' if in_attribute else ''}", 1)

    def shown(name: Column) -> Column:
        listed, mark = F.get(F.lit(_LISTS), F.ascii(name) - ord("A")), F.concat(F.lit("\x01"), name, F.lit(";"))
        return F.when((name != "") & F.contains(listed, mark), F.substring_index(F.split_part(listed, mark, F.lit(2)), "\x01", 1))

    def after(name: Column, more: int) -> Column:
        return F.substring(piece, F.length(name) + more, F.length(piece))

    long_form = once(whole, lambda name: F.concat(shown(name), after(name, 2)))
    short_form = once(short, lambda name: F.concat(shown(name), after(name, 1)))
    return F.coalesce(long_form, short_form, F.concat(F.lit("&"), piece))


def _numbered(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^#0*([0-9]+)", 1)
    hexed = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    code = F.when(hexed != "", F.conv(F.left(hexed, F.lit(9)), 16, 10)).otherwise(F.left(digits, F.lit(9))).try_cast("bigint")

    def shown(n: Column) -> Column:
        # What no text holds: controls but tab and line ends, and the code points that are set aside.
        unheard = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 0xFFFE)
        none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 32).otherwise(n)), 8, "0")), "UTF-32")
        of_c1 = F.substring(F.lit(_C1), (n - 0x7F).cast("int"), F.lit(1))
        return F.when(n.between(0x80, 0x9F), of_c1).when(~none, F.when(unheard, "").otherwise(char))

    rest = F.regexp_replace(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
    return F.coalesce(F.concat(once(code, shown), rest), F.concat(F.lit("&"), piece))
