"""Pages as arrays of nodes: a small reader of markup as it is found, with comments, scripts, quoted attributes and
elements that nobody closed.

A page is read once from left to right. Comments, declarations and the content of scripts and styles are no
markup; an attribute value ends at its own quote; an end tag closes the nearest open element of its name and
what is open inside, or nothing; some start tags close an open element first. The result is an array of nodes in
page order, on which the extraction is written with column functions.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hearthlens.session import ship

#: ``id`` is the place in the array, ``last`` the place of the last node inside, ``parent`` that of the element around it or -1 and
#: ``home`` its name. Elements have a name in lower case, attributes and classes; texts have no name.
NODE_TYPE = ("array<struct<id:int,parent:int,last:int,home:string,tag:string,attributes:map<string,string>,"
             "classes:array<string>,text:string>>")
#: Elements inside this many others are no homes for further ones, as in browsers.
MOST_DEPTH = 512

# Elements without content, with content that is no markup, and which open elements a start tag ends.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
PLAIN = frozenset("textarea title".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"a": ("a",), "li": ("li",), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
        "dt": ("dt", "dd"), "dd": ("dt", "dd"), **{name: ("p",) for name in sorted(BLOCKS)}}
FENCES = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

_MARK = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?])")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
_END = re.compile(r"[\s/]*>")
# the rest of a tag as most are written, which one match reads
_PLAIN_REST = re.compile(r"""((?:\s+[A-Za-z][A-Za-z0-9_-]*="[^"]*")*)\s*(/?)>""")
_PLAIN_PAIR = re.compile(r"""([A-Za-z][A-Za-z0-9_-]*)="([^"]*)\"""")


class _Page:
    """The nodes of one page, built in columns."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.last: list[int] = []
        self.tag: list[str | None] = []
        self.attributes: list[list[tuple[str, str]]] = []
        self.text: list[str | None] = []
        self.open: list[int] = []
        self.names: Counter[str] = Counter()

    def add(self, tag: str | None, attributes: list[tuple[str, str]], text: str | None) -> int:
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(len(self.last))
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        return len(self.last) - 1

    def close_to(self, depth: int) -> None:
        end = len(self.last) - 1
        for node in self.open[depth:]:
            self.last[node] = end
            self.names[self.tag[node]] -= 1
        del self.open[depth:]

    def nearest(self, names: tuple[str, ...], fences: tuple[str, ...] = ()) -> int | None:
        for name in names:
            if self.names.get(name):
                break
        else:
            return None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                return depth
            if tag in fences:
                return None
        return None

    def start(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        ends = ENDS.get(tag)
        while ends and (depth := self.nearest(ends, FENCES.get(tag, ()))) is not None:
            self.close_to(depth)
        node = self.add(tag, attributes, None)
        if tag not in EMPTY and not closed and len(self.open) < MOST_DEPTH:
            self.open.append(node)
            self.names[tag] += 1

    def end(self, tag: str) -> None:
        depth = self.nearest((tag,))
        if depth is not None:
            self.close_to(depth)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes from a place behind a tag's name, the place behind the tag and whether it closes itself. The first of
    equal names counts; a tag that the page does not end runs to its end."""
    found: dict[str, str] = {}
    plain = _PLAIN_REST.match(page, at)
    if plain:
        if plain.group(1):
            for name, value in _PLAIN_PAIR.findall(plain.group(1)):
                found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
        return list(found.items()), plain.end(), bool(plain.group(2))
    while True:
        end = _END.match(page, at)
        if end:
            return list(found.items()), end.end(), "/" in end.group()
        match = _ATTRIBUTE.match(page, at)
        if not match or match.end() == at:
            return list(found.items()), len(page), False
        name, value = match.group(1).lower(), next((v for v in match.group(2, 3, 4) if v is not None), "")
        found.setdefault(name, html.unescape(value) if "&" in value else value)
        at = match.end()
        if page[at:at + 1] in "\"'" and at < len(page):
            at += 1  # a quote that is out of place


def read_page(page: str) -> _Page:
    """The nodes of a page."""
    out, at, size = _Page(), 0, len(page)

    def text(content: str) -> None:
        if content:
            out.add(None, [], html.unescape(content) if "&" in content else content)

    begin = 0
    while True:
        mark = _MARK.search(page, at)
        if mark is None:
            text(page[begin:])
            break
        start = mark.start()
        if mark.group(2) is None:
            text(page[begin:start])
            if mark.group() == "<!--":
                end = page.find("-->", start + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            begin = at
            continue
        text(page[begin:start])
        tag = mark.group(2).lower()
        attributes, at, closed = _attributes(page, mark.end())
        begin = at
        if mark.group(1):
            out.end(tag)
            continue
        out.start(tag, attributes, closed)
        if (tag in RAW or tag in PLAIN) and not closed:
            close = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(page, at)
            end = size if close is None else close.start()
            if tag in PLAIN:
                text(page[at:end])
            at = begin = end
    out.close_to(0)
    return out


def _columns(pages: list[_Page | None]) -> pa.Array:
    sizes = [0 if page is None else len(page.tag) for page in pages]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    known = [page for page in pages if page is not None]

    def joined(name: str) -> list:
        return [value for page in known for value in getattr(page, name)]

    attributes = joined("attributes")
    ends = np.concatenate([[0], np.cumsum([len(a) for a in attributes])]).astype(np.int32)
    pairs = [pair for own in attributes for pair in own]
    maps = pa.MapArray.from_arrays(pa.array(ends), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    classes = pa.array([next((v.split() for k, v in own if k == "class"), []) for own in attributes], pa.list_(pa.string()))
    nodes = pa.StructArray.from_arrays(
        [pa.array([i for page in known for i in range(len(page.tag))], pa.int32()), pa.array(joined("parent"), pa.int32()), pa.array(joined("last"), pa.int32()),
         pa.array([None if home < 0 else page.tag[home] for page in known for home in page.parent], pa.string()), pa.array(joined("tag"), pa.string()), maps, classes, pa.array(joined("text"), pa.string())],
        ["id", "parent", "last", "home", "tag", "attributes", "classes", "text"])
    missing = pa.array([page is None for page in pages])
    return pa.ListArray.from_arrays(pa.array(offsets), nodes, mask=missing)


#: Characters of pages read and rows taken from them that are held at once.
PAGE_CHARACTERS, PAGE_ROWS = 4 << 20, 4096


def taken(df: DataFrame, page: str, keys: list[str], take: Callable[[_Page], Iterator[tuple]], fields: str) -> DataFrame:
    """The keys and what ``take`` gives of each page, a row each: pages are read and left one after the other, and their nodes stay
    in the task. A missing page gives nothing."""
    ship(df.sparkSession)
    kept = df.select(*keys, F.col(page).alias("__page"))
    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(fields).fields])
    own = to_arrow_schema(StructType(schema.fields[len(keys):]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            read = 0

            def given() -> pa.RecordBatch:
                place = pa.array(at, pa.int64())
                columns = zip(*rows) if rows else [()] * len(own)
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(place) for i in range(len(keys))), *(pa.array(v, f.type) for v, f in zip(columns, own))],
                                                  names=schema.names)

            for i, html in enumerate(batch.column(len(keys))):
                if html.is_valid:
                    found = list(take(read_page(html.as_py())))
                    at += [i] * len(found)
                    rows += found
                    read += len(html.as_buffer())
                if len(rows) >= PAGE_ROWS or read >= PAGE_CHARACTERS:
                    yield given()
                    at, rows, read = [], [], 0
            yield given()

    return kept.mapInArrow(read, schema)


def text_inside(page: _Page, node: int) -> str:
    """All text inside a node."""
    return "".join([text for text in page.text[node + 1:page.last[node] + 1] if text])


def texts_of(page: _Page, node: int) -> list[str]:
    """The texts that stand in a node itself and not in an element inside."""
    return [text for text, parent in zip(page.text[node + 1:page.last[node] + 1], page.parent[node + 1:page.last[node] + 1]) if text is not None and parent == node]


def texts_within(page: _Page, node: int, tag: str) -> list[str]:
    """The texts that stand directly in elements of a name inside a node."""
    return [text for text, parent in zip(page.text[node + 1:page.last[node] + 1], page.parent[node + 1:page.last[node] + 1])
            if text is not None and parent != node and page.tag[parent] == tag]


def classes_of(page: _Page, node: int) -> list[str]:
    return next((value.split() for name, value in page.attributes[node] if name == "class"), [])


def nodes(page: Column) -> Column:
    """The nodes of a page, null for a missing one."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.arrow_udf(NODE_TYPE)
    def read(batch: pa.Array) -> pa.Array:
        return _columns([None if page is None else read_page(page) for page in batch.to_pylist()])

    return read(page)


def inside(part: Column, node: Column) -> Column:
    """The nodes inside a node, in page order. ``part`` are all nodes of a page or those of one of its elements,
    itself first."""
    return F.slice(part, node["id"] - F.get(part, F.lit(0))["id"] + 2, node["last"] - node["id"])


def attribute(node: Column, name: str) -> Column:
    """An attribute's value, null when it is absent."""
    return F.try_element_at(node["attributes"], F.lit(name.lower()))


def with_class(found: Column, css_class: str) -> Column:
    return F.filter(found, lambda node: F.array_contains(node["classes"], css_class))


def with_tag(found: Column, tag: str) -> Column:
    return F.filter(found, lambda node: node["tag"] == tag)


def _texts(found: Column) -> Column:
    return F.transform(found, lambda node: node["text"])


def text_of(part: Column, node: Column) -> Column:
    """All text inside a node."""
    return F.array_join(_texts(inside(part, node)), "")


def own_texts(part: Column, node: Column) -> Column:
    """The texts that stand in a node itself and not in an element inside."""
    return _texts(F.filter(inside(part, node), lambda n: (n["parent"] == node["id"]) & n["text"].isNotNull()))


def texts_in(part: Column, node: Column, tag: str) -> Column:
    """The texts that stand directly in elements of a name inside a node."""
    return _texts(F.filter(inside(part, node), lambda n: (n["home"] == tag) & (n["parent"] != node["id"]) & n["text"].isNotNull()))
