"""Elements of page source with their true ends.

An element may contain others of its kind, and attributes come in double, single or no quotes. No pattern follows that,
so one Arrow function scans the tags of each source and returns the texts of all elements asked for. What is done with
the texts is column work."""

from __future__ import annotations

import html as entities
import re
import sys
from bisect import bisect_left
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_MAY_HIDE = re.compile(r"(?i)<(?:!--|script|style)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

_HELD_FITS, _HELD_CHARS = 1 << 15, 200

_PART = pa.struct([("text", pa.string()), ("link", pa.string()), ("opening", pa.string())])
_NOTHING = {"text": "", "link": None, "opening": ""}


class Fitting(dict):
    """By tag and attributes as they stand, which of the selectors an element fits. Elements written alike are judged
    once, and attributes are read only where one that a selector asks for may be among them. What is held is bounded."""

    def __init__(self, selectors: Iterable[tuple]) -> None:
        self.selectors = list(dict.fromkeys(selectors))
        self.of: dict[str, list[tuple]] = {}  # by attribute, "" for those without a test
        for k, (tags, attribute, test, wanted) in enumerate(self.selectors):
            self.of.setdefault(attribute if test else "", []).append((k, tags.split("|") if tags else None, test, wanted))
        names = "|".join(map(re.escape, sorted(self.of.keys() - {""})))
        self.may_fit = re.compile(names or r"(?!)", re.IGNORECASE).search

    def __missing__(self, element: tuple[str, str]) -> tuple[int, ...]:
        tag, written = element
        out = [k for k, tags, *_ in self.of.get("", ()) if tags is None or tag in tags]
        for name, value in _attributes(written).items() if self.may_fit(written) else ():
            for k, tags, test, wanted in self.of.get(name, ()):
                if (tags is None or tag in tags) and (
                    test == "present" or (value == wanted if test == "is" else wanted in value.split() if test == "word" else wanted in value)
                ):
                    out.append(k)
        if len(written) <= _HELD_CHARS:
            if len(self) >= _HELD_FITS:
                self.clear()
            self[element] = tuple(out)
        return tuple(out)


class Page:
    """The elements of one source in page order. Scripts, styles and comments are blanked before."""

    def __init__(self, source: str) -> None:
        self.source = _HIDDEN.sub(lambda m: " " * len(m.group()), source) if _MAY_HIDE.search(source) else source
        self.tags: list[str] = []
        self.written: list[str] = []  # the attributes as they stand
        self.parents: list[int] = []
        self.starts: list[int] = []
        self.bodies: list[int] = []
        self.body_ends: list[int] = []
        self.ends: list[int] = []
        self._read: dict[int, dict[str, str]] = {}
        self._texts: dict[int, str] = {}
        self._parts: dict[int, dict] = {}
        self._matching: dict[tuple, list[int]] = {}
        open_at: list[int] = []
        tags, written, parents, starts = self.tags, self.written, self.parents, self.starts
        bodies, body_ends, ends, size = self.bodies, self.body_ends, self.ends, len(source)
        for m in _TAG.finditer(self.source):
            closes, tag, attributes = m.groups()
            tag = tag.lower()
            start, end = m.span()
            if closes:
                if open_at and tags[open_at[-1]] == tag:
                    i = open_at.pop()
                    body_ends[i], ends[i] = start, end
                    continue
                depth = len(open_at) - 1
                while depth >= 0 and tags[open_at[depth]] != tag:
                    depth -= 1
                if depth >= 0:
                    for i in open_at[depth:]:
                        body_ends[i] = ends[i] = start
                    ends[open_at[depth]] = end
                    del open_at[depth:]
                continue
            parents.append(open_at[-1] if open_at else -1)
            starts.append(start)
            bodies.append(end)
            if tag in _VOID or attributes.endswith("/"):
                body_ends.append(end)
                ends.append(end)
            else:
                open_at.append(len(tags))
                body_ends.append(size)
                ends.append(size)
            tags.append(tag)
            written.append(attributes)

    def __len__(self) -> int:
        return len(self.tags)

    def attributes(self, i: int) -> dict[str, str]:
        """Read when an element's attributes are first asked for."""
        if i not in self._read:
            self._read[i] = _attributes(self.written[i])
        return self._read[i]

    def span(self, i: int) -> tuple[int, int]:
        """An element and those inside it, as a range."""
        return i, max(i + 1, bisect_left(self.starts, self.ends[i]))

    def look_for(self, fitting: Fitting) -> None:
        """Finds the elements of all its selectors in one pass."""
        found: list[list[int]] = [[] for _ in fitting.selectors]
        for i, element in enumerate(zip(self.tags, self.written)):
            for k in fitting[element]:
                found[k].append(i)
        self._matching.update(zip(fitting.selectors, found))

    def found(self, selector: tuple) -> list[int]:
        """The elements that fit the selector, in page order. Looked for once in a page."""
        if selector not in self._matching:
            self.look_for(Fitting([selector]))
        return self._matching[selector]

    def matching(self, selector: tuple, inside: tuple[int, int] | None = None) -> list[int]:
        """The elements, or those of a range, that fit the selector, in page order."""
        found = self.found(selector)
        return found if inside is None or not found else found[bisect_left(found, inside[0]) : bisect_left(found, inside[1])]

    def within(self, container: int, tags: str) -> list[int]:
        """Elements with one of the tags inside the container."""
        wanted = tags.split("|")
        return [i for i in range(container + 1, self.span(container)[1]) if self.tags[i] in wanted]

    def text(self, i: int) -> str:
        """The text of an element, made once: several lists may ask for it."""
        if i not in self._texts:
            body = self.source[self.bodies[i] : self.body_ends[i]]
            self._texts[i] = " ".join(entities.unescape(_TAG.sub(" ", body) if "<" in body else body).split())
        return self._texts[i]

    def link(self, i: int) -> str | None:
        """Target of the link that the element is or holds."""
        at = [i] if self.tags[i] == "a" else self.within(i, "a")
        return next((self.attributes(j)["href"] for j in at if self.attributes(j).get("href")), None)

    def part(self, i: int) -> dict:
        if i not in self._parts:
            self._parts[i] = self._part(i)
        return self._parts[i]

    def _part(self, i: int) -> dict:
        return {"text": self.text(i), "link": self.link(i), "opening": self.source[self.starts[i] : self.bodies[i]]}


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if not source or source.isspace():
        return out
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape("".join(values)))  # one of them at most is not empty
    return out


def _first(page: Page, selectors, _inner, _words, inside=None) -> list[dict]:
    low, high = inside or (0, len(page))
    out = []
    for s in selectors:
        found = page.found(s)
        at = bisect_left(found, low) if found else 0
        out.append(page.part(found[at]) if at < len(found) and found[at] < high else _NOTHING)
    return out


def _every(page: Page, selectors, inner, _words, inside=None) -> list[dict]:
    found: dict[int, None] = {}
    for s in selectors:
        for i in page.matching(s, inside):
            found.update(dict.fromkeys(page.within(i, inner) if inner else [i]))
    return [page.part(i) for i in found]


def _in_one(page: Page, selectors, inner, words, inside=None) -> list[dict]:
    for s in selectors:
        for i in page.matching(s, inside):
            if any(w in page.text(i).lower() for w in words):
                return [page.part(j) for j in page.within(i, inner)]
    return []


def first(selectors: Sequence) -> tuple:
    """The first element of each selector; an empty text where there is none."""
    return (_first, selectors, "", ())


def every(selectors: Sequence, inner: str = "") -> tuple:
    """All elements of the selectors, or the elements with the inner tags that lie in them."""
    return (_every, selectors, inner, ())


def in_one(selectors: Sequence, inner: str, words: Sequence[str]) -> tuple:
    """The elements with the inner tags in the first container whose text has one of the words."""
    return (_in_one, selectors, inner, words)


def selectors_of(wanted: dict[str, tuple]) -> list[tuple]:
    """All selectors that are asked for."""
    return [s for _, selectors, *_ in wanted.values() for s in selectors]


def read_parts(page: Page, wanted: dict[str, tuple], inside: tuple[int, int] | None = None) -> dict[str, list[dict]]:
    """What is asked for of a page, or of a range of its elements."""
    return {name: read(page, *how, inside) for name, (read, *how) in wanted.items()}


def parts_type(names: Sequence[str]) -> tuple[pa.DataType, str]:
    """The struct of the named parts, for Arrow and for Spark."""
    fields = ", ".join(f"{name}: array<struct<text: string, link: string, opening: string>>" for name in names)
    return pa.struct([(name, pa.list_(_PART)) for name in names]), f"struct<{fields}>"


def parts(html: Column, wanted: dict[str, tuple]) -> Column:
    """Struct with one array of (text, link, opening) for each name: the elements that ``first``, ``every`` or ``in_one``
    ask for. All of them come from one scan of the source; a NULL source gives empty arrays."""
    kind, schema = parts_type(tuple(wanted))

    @F.arrow_udf(schema)
    def scan(sources: pa.Array) -> pa.Array:
        rows, fitting = [], Fitting(selectors_of(wanted))
        for source in sources.to_pylist():
            if source is None:
                rows.append(dict.fromkeys(wanted, []))
                continue
            page = Page(source)
            page.look_for(fitting)
            rows.append(read_parts(page, wanted))
        return pa.array(rows, kind)

    return scan(html)


def texts(found: Column) -> Column:
    return F.transform(found, lambda p: p["text"])


def first_text(found: Column, longer_than: int = 0) -> Column:
    """First of the texts with more characters than that."""
    return F.get(F.filter(texts(found), lambda t: F.length(t) > longer_than), 0)
