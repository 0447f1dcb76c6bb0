"""Elements of stored pages by an event-driven parse, as regular expressions cannot pair nested tags.

The parse runs in Arrow batches inside the scan's tasks; a page fans out there and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a new one of the same name ends, unless a list or table lies between.
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}}
SPACES = " \t\n\r\x0b\x0c "


class Element:
    __slots__ = ("tag", "attributes", "classes", "parent", "start", "end")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, start: int):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.classes, self.start, self.end = set(attributes.get("class", "").split()), start, start


class Page(HTMLParser):
    """Elements in document order, and the texts between them with their places."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[tuple[int, str]] = []
        self.open: list[Element] = []
        self.at = 0
        self.feed(html)
        self.close()
        while self.open:
            self.shut()

    def shut(self) -> None:
        self.at += 1
        self.open.pop().end = self.at

    def handle_starttag(self, tag: str, attrs: list) -> None:
        walls = SELF_CLOSING.get(tag)
        if walls is not None:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in walls:
                    break
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.shut()
                    break
        self.at += 1
        one = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None, self.at)
        self.elements.append(one)
        if tag in VOID:
            one.end = self.at
        else:
            self.open.append(one)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as a browser does, the slash does not end an element

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self.shut()
                return

    def handle_data(self, data: str) -> None:
        self.at += 1
        self.texts.append((self.at, data))

    def text(self, one: Element | None) -> str:
        """All text inside an element, trimmed; '' without one."""
        return "" if one is None else "".join(t for at, t in self.texts if one.start < at < one.end).strip(SPACES)

    def inside(self, one: Element) -> list[Element]:
        return [e for e in self.elements if one.start < e.start <= one.end]


#: tag, class and an (attribute, value) of an element; None is any.
Step = tuple[str | None, str | None, tuple[str, str] | None]


def steps(selector: str) -> list[Step]:
    """``a.title``, ``.wrap a`` or ``[data-testid=name]`` as steps from the outermost on."""
    out: list[Step] = []
    for part in selector.split():
        part, _, attribute = part.partition("[")
        tag, _, name = part.partition(".")
        key, _, value = attribute.rstrip("]").partition("=")
        out.append((tag or None, name or None, (key, value) if key else None))
    return out


def matches(one: Element, path: list[Step], within: Element) -> bool:
    """The element is the last step and its ancestors hold the others in order. As in a browser, ancestors
    outside of ``within`` count."""
    def fits(e: Element, step: Step) -> bool:
        tag, name, attribute = step
        return (tag is None or e.tag == tag) and (name is None or name in e.classes) and (
            attribute is None or attribute[0] in e.attributes and attribute[1] in ("", e.attributes[attribute[0]]))

    if not fits(one, path[-1]):
        return False
    at, left = one.parent, list(path[:-1])
    while left and at is not None:
        if fits(at, left[-1]):
            left.pop()
        at = at.parent
    return not left


class Card:
    """One element of a page and what it holds."""

    def __init__(self, page: Page, root: Element):
        self.page, self.root, self.held = page, root, page.inside(root)

    def first(self, *selectors: str) -> Element | None:
        """The first element, in document order, that any of the selectors names."""
        paths = [steps(s) for s in selectors]
        return next((e for e in self.held if any(matches(e, p, self.root) for p in paths)), None)

    def text(self, *selectors: str) -> str:
        return self.page.text(self.first(*selectors))

    def attribute(self, name: str, *selectors: str) -> str:
        one = self.first(*selectors)
        return "" if one is None else one.attributes.get(name, "")


def cards_of(html: str, selectors: tuple[str, ...]) -> Iterator[Card]:
    page, paths = Page(html), [steps(s) for s in selectors]
    for e in page.elements:
        if any(matches(e, p, e) for p in paths):
            yield Card(page, e)


def extract(pages: DataFrame, selectors: tuple[str, ...], read: Callable[[Card], dict[str, str]], names: list[str],
            keep: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """``keep``, pos (place among the page's cards, from 0) and the texts that ``read`` finds in each card.

    Null pages have no cards; broken markup is read as far as its tags pair up."""
    fields = [T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names)]
    schema = T.StructType([*(pages.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, found = [], [], []
            for i, text in enumerate(batch.column(html).to_pylist()):
                for p, card in enumerate(cards_of(text, selectors) if text else ()):
                    row.append(i)
                    pos.append(p)
                    found.append(read(card))
            at = pa.array(row, pa.int64())
            columns = [batch.column(c).take(at).cast(arrow.field(c).type) for c in keep]
            columns += [pa.array(pos, pa.int32()), *(pa.array([f[n] for f in found], pa.string()) for n in names)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)
