"""Elements of HTML pages by selectors: a table function over pages, and the fields of cards and detail pages from it."""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import details

# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# An element of the first kind ends where another of its kind begins, unless one of the others was opened between them.
SIBLINGS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ("div", "article", "section", "li", "td", "body")}
# Elements that end a paragraph.
BLOCKS = ("p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote")
_STEP = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:=(?P<q>['"]?)(?P<value>[^'"\]]*)(?P=q))?\]""")
# Elements whose content some versions of the parser read as text: on the short way they hold no tag.
RAW = ("title", "textarea", "iframe", "xmp", "noembed", "noframes")
# Scripts and styles with their content, tags, comments and the document's type. What begins a tag and isn't one of these is left to the parser.
_PLAIN = r"[^<]*(?:<(?![/!])[^<]*)*"
_TAGS = re.compile(rf"(</?[a-rt-zA-RT-Z][^<>]*>|<(?i:script)(?:\s[^<>]*)?>{_PLAIN}</(?i:script)>|<(?i:style)(?:\s[^<>]*)?>{_PLAIN}</(?i:style)>|</?[sS][^<>]*>|<!(?i:doctype)\b[^<>]*>|<!--(?!-)[^<>-]*(?:-[^<>-]+)*-->)")
_TAG = re.compile(r"""</[a-zA-Z][a-zA-Z0-9]*>|<[a-zA-Z][a-zA-Z0-9-]*(?:[ \t\n\r\f]+[a-zA-Z_:@][\w:.@-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*[ \t\n\r\f]*/?>""", re.ASCII)
#: Structures of pages and tags that a task remembers, and the longest tag it does.
STRUCTURES, SEEN_TAGS, LONGEST_TAG = 4096, 100_000, 500
# Where the fields of a detail page stand.
DETAIL = {
    "description": ("div[data-test-id='ad-description']", None), "energy": ("div[data-test-id='ad-dpe']", None), "photos": ("img[data-test-id='ad-photo']", "src"), "published": ("time[datetime]", "datetime"),
    "labels": ("div[data-qa-id='criteria_item'] div[data-qa-id='criteria_item_label']", None), "values": ("div[data-qa-id='criteria_item'] div[data-qa-id='criteria_item_value']", None),
}


def compile_selector(selector: str) -> list[list[tuple[str, str, str | None]]]:
    """Tag, #id, .class, [attribute] and [attribute=value], joined without a space for one element and by spaces for one inside another."""
    steps = []
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+|\[", selector):
        tests, at = [], 0
        while at < len(part):
            m = _STEP.match(part, at)
            if not m:
                raise ValueError(f"no selector: {selector}")
            kind = m.lastgroup if m.lastgroup in ("tag", "id", "cls") else "attr"
            tests.append((kind, m["attr"], m["value"]) if kind == "attr" else (kind, m[kind], None))
            at = m.end()
        steps.append(tests)
    if not steps:
        raise ValueError("an empty selector")
    return steps


class _Element:
    __slots__ = ("tag", "attrs", "parent", "parts", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None):
        self.tag, self.attrs, self.parent, self.parts, self.end = tag, attrs, parent, [], 0

    def fits(self, tests: list[tuple[str, str, str | None]]) -> bool:
        for kind, name, value in tests:
            if kind == "tag":
                if name != "*" and name.lower() != self.tag:
                    return False
            elif kind == "attr":
                if name.lower() not in self.attrs or value is not None and self.attrs[name.lower()] != value:
                    return False
            elif kind == "id" and self.attrs.get("id") != name or kind == "cls" and name not in self.attrs.get("class", "").split():
                return False
        return True


class _Page(HTMLParser):
    """All elements of a page in order, each with its parent and the texts inside it. An element ends where its parent does, if not before."""

    def __init__(self, page: str):
        super().__init__()
        self.elements: list[_Element] = []
        self.open: list[_Element] = []
        self.feed(page)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        self.open.pop().end = len(self.elements)

    def handle_starttag(self, tag, attrs):
        for kind in dict.fromkeys(k for k in (tag, "p" if tag in BLOCKS else "") if k in SIBLINGS):
            before = next((e for e in reversed(self.open) if e.tag == kind or e.tag in SIBLINGS[kind]), None)
            if before is not None and before.tag == kind:
                self.handle_endtag(kind)
        e = _Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None)
        self.elements.append(e)
        self.open.append(e)
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if data.strip() and not (self.open and self.open[-1].tag in ("script", "style")):
            for e in self.open:
                e.parts.append(data.strip())

    def select(self, steps, within: _Element | None = None) -> Iterator[_Element]:
        """Elements that fit the last step, inside ones that fit the others; all inside `within`."""
        first = self.elements.index(within) + 1 if within else 0
        for e in self.elements[first : within.end if within else None]:
            if not e.fits(steps[-1]):
                continue
            left, up = len(steps) - 2, e.parent
            while left >= 0 and up is not None and up is not within:
                left -= up.fits(steps[left])
                up = up.parent
            if left < 0:
                yield e


@functools.lru_cache(64)
def _wanted(container: str, fields: str):
    """Selectors, compiled once for all pages."""
    return compile_selector(container) if container else None, {name: (compile_selector(s), attr) for name, (s, attr) in json.loads(fields).items()}


def _parsed(page: str, inside, wanted) -> Iterator[list[list[str]]]:
    """For each element of the page that fits `inside` (the page itself, without it): all values of each field inside it. By the parser."""
    tree = _Page(page)
    for root in tree.select(inside) if inside else [None]:
        yield [[e.attrs.get(attr, "") if attr else " ".join(e.parts) for e in tree.select(steps, root)] for steps, attr in wanted.values()]


class _Tag(HTMLParser):
    """What the parser makes of one tag."""

    def __init__(self, tag: str):
        super().__init__()
        self.found: list[tuple] = []
        self.feed(tag)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("startend", tag, attrs))

    def handle_endtag(self, tag):
        self.found.append(("end", tag, []))

    def handle_data(self, data):
        self.found.append(("data", "", []))


class _Codes(dict):
    """The code of each tag: tags of one kind, name and result of the selectors' tests have one. 0: not for the short way; 1: nothing (a comment)."""

    def __init__(self, tests: list):
        self.tests, self.kinds, self.attrs = tests, {}, {}

    def read(self, token: str) -> tuple[int, dict[str, str]]:
        if token.startswith("<!"):
            return 1, {}
        whole = token[-9:].lower() == "</script>" or token[-8:].lower() == "</style>"  # with what is inside it
        tag = token[: token.index(">") + 1]
        found = _Tag(tag).found if _TAG.fullmatch(tag) else []
        if len(found) != 1 or found[0][0] == "data":
            return 0, {}
        how, name, attrs = found[0]
        whole = whole and how != "end"
        if how != "end" and (name in ("script", "style")) != whole or whole and how != "start" or how == "startend" and name in RAW or name == "plaintext":
            return 0, {}
        e = _Element(name, {k: v or "" for k, v in attrs}, None)
        kind = ("whole" if whole else how, name, tuple(how != "end" and e.fits(t) for t in self.tests))
        return self.kinds.setdefault(kind, len(self.kinds) + 2), e.attrs

    def __missing__(self, token: str) -> int:
        code, attrs = self.read(token)
        if len(token) <= LONGEST_TAG:
            if len(self) >= SEEN_TAGS:
                self.clear()
                self.attrs.clear()
            self[token], self.attrs[token] = code, attrs
        return code

    def attrs_of(self, token: str) -> dict[str, str]:
        found = self.attrs.get(token)
        return self.read(token)[1] if found is None else found


class _Finder:
    """What selectors find in pages. Which tags and texts it is depends on the codes of a page's tags alone, so it is worked out once for pages of one structure, by the same tree as _parsed's.

    Pages with anything else than plain tags, comments and texts are left to the parser.
    """

    def __init__(self, inside, wanted):
        self.inside, self.wanted = inside, wanted
        self.attrs = [attr for _, attr in wanted.values()]
        self.codes = _Codes([step for steps in (inside or [], *(s for s, _ in wanted.values())) for step in steps])
        self.structures: dict[tuple[int, ...], list | None] = {}

    def structure(self, codes: tuple[int, ...], tokens: list[str]) -> list | None:
        """For each root and field: the tags (for an attribute) or the texts' places (for a text) of each element; None if the parser must read the page."""
        kinds = list(self.codes.kinds)
        tree, tag_of = _Page(""), {}
        for i, (code, token) in enumerate(zip(codes, tokens)):
            tree.handle_data(str(i))
            if code == 1:
                continue
            how, name, _ = kinds[code - 2]
            if how == "end":
                tree.handle_endtag(name)
                continue
            if name in RAW and (i + 1 == len(codes) or codes[i + 1] < 2 or kinds[codes[i + 1] - 2][:2] != ("end", name)):
                return None
            (tree.handle_startendtag if how == "startend" else tree.handle_starttag)(name, list(self.codes.attrs_of(token).items()))
            tag_of[id(tree.elements[-1])] = i
            if how == "whole":
                tree.handle_endtag(name)
        tree.handle_data(str(len(codes)))
        while tree.open:
            tree._end()
        roots = list(tree.select(self.inside)) if self.inside else [None]
        return [[[tag_of[id(e)] if attr else [int(p) for p in e.parts] for e in tree.select(steps, root)] for steps, attr in self.wanted.values()] for root in roots]

    def __call__(self, page: str) -> Iterator[list[list[str]]]:
        parts = _TAGS.split(page)
        texts, tokens = parts[::2], parts[1::2]
        codes = tuple(map(self.codes.__getitem__, tokens))
        if 0 in codes or "<" in "".join(texts):
            return _parsed(page, self.inside, self.wanted)
        if codes not in self.structures:
            if len(self.structures) >= STRUCTURES:
                self.structures.clear()
            self.structures[codes] = self.structure(codes, tokens)
        found = self.structures[codes]
        return _parsed(page, self.inside, self.wanted) if found is None else self.values(found, tokens, texts)

    def values(self, found: list, tokens: list[str], texts: list[str]) -> Iterator[list[list[str]]]:
        def text_at(i: int) -> str:
            return (entities.unescape(texts[i]) if "&" in texts[i] else texts[i]).strip()

        attrs_of = self.codes.attrs_of
        for root in found:
            yield [
                [attrs_of(tokens[e]).get(attr, "") for e in field] if attr else [text_at(p[0]) if len(p) == 1 else " ".join([t for i in p if (t := text_at(i))]) for p in field]
                for field, attr in zip(root, self.attrs)
            ]


@functools.lru_cache(64)
def _finder(container: str, fields: str) -> _Finder:
    return _Finder(*_wanted(container, fields))


def _found(pages: pa.Array, container: str, fields: str) -> pa.Array:
    """For each page its elements that fit `container`, as Arrow lists of place and found; a null page has none."""
    find, names = _finder(container, fields), list(json.loads(fields))
    ends, places, sizes, values = [0], [], [0], []
    for page in pages.to_pylist():
        for place, root in enumerate(find(page) if page is not None else ()):
            places.append(place)
            for field in root:
                values += field
                sizes.append(len(field))
        ends.append(len(places))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values, pa.string()))
    keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), len(places))))
    found = pa.MapArray.from_arrays(pa.array(np.arange(len(places) + 1) * len(names), pa.int32()), keys, lists)
    rows = pa.StructArray.from_arrays([pa.array(places, pa.int32()), found], ["place", "found"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def select(pages: DataFrame, container: str, fields: dict[str, tuple[str, str | None]], html: str = "html") -> DataFrame:
    """pages with their elements that fit `container` (the page itself, if it is empty), a row for each: place and found, by name all values of `fields` inside it.

    fields: selector and attribute; without an attribute the value is the element's text. A null page gives no row.
    """
    compile_selector(container or "*")
    given = json.dumps(fields)

    @F.arrow_udf("array<struct<place:int,found:map<string,array<string>>>>")
    def elements_of(page: pa.Array) -> pa.Array:
        return _found(page, container, given)

    # outer: else the planner drops pages without elements before, by a filter that runs the function once more, where few tasks are
    return pages.withColumn("_elements", elements_of(F.col(html))).select(*pages.columns, F.inline_outer("_elements")).where("place is not null")


def detail_pages(pages: DataFrame, letting: Column, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every field of detail pages: description, photos, published, and those of the criteria; the energy class stated apart comes before the criteria's."""
    own = select(pages.select(key, html, letting.alias("letting")), "", DETAIL, html)
    get = lambda name: F.col("found")[name]
    first = lambda name: F.nullif(text.strip(F.try_element_at(get(name), F.lit(1))), F.lit(""))
    criteria = F.zip_with(get("labels"), get("values"), lambda a, b: F.struct(F.lower(F.trim(a)).alias("label"), F.trim(b).alias("value")))
    own = own.withColumn("_named", details.named(criteria))
    named = details.detail_fields(F.col("_named"), F.col("letting"))
    named["energy"] = F.coalesce(text.energy_strict(first("energy")), named["energy"])
    return own.select(key, first("description").alias("description"), F.filter(get("photos"), lambda x: x != "").alias("photos"), F.try_element_at(get("published"), F.lit(1)).alias("published"), *(c.alias(n) for n, c in named.items()))
