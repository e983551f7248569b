"""A bounded element tree of an HTML page, for the listings of proceedings sites."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from quarry.functions.text import BLOCKS

#: Elements of a page; a larger one is refused, not cut.
MAX_ELEMENTS = 500_000
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class PageTooLarge(ValueError):
    pass


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parts: list[Element | str] = field(default_factory=list)

    def iter(self) -> Iterator[Element]:
        """The element and all below it, in page order."""
        waiting: list[Element] = [self]
        while waiting:
            now = waiting.pop()
            yield now
            waiting += [p for p in reversed(now.parts) if isinstance(p, Element)]

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()

    def text(self) -> str:
        """Its text in one line; blocks separate words, scripts and styles are left out."""
        out: list[str] = []
        waiting: list[Element | str] = [self]
        while waiting:
            now = waiting.pop()
            if isinstance(now, str):
                out.append(now)
            elif now.tag not in ("script", "style"):
                gap = [" "] if now.tag in BLOCKS else []
                waiting += [*gap, *reversed(now.parts), *gap]
        return " ".join("".join(out).split())

    def find(self, tag: str, **wanted: str) -> Element | None:
        """The first element below with the tag and, given as class_ or id, the class or id."""
        return next(self.find_all(tag, **wanted), None)

    def find_all(self, tag: str, class_: str | None = None, id: str | None = None) -> Iterator[Element]:
        return (e for e in self.iter() if e.tag == tag and (class_ is None or e.has_class(class_)) and (id is None or e.attributes.get("id") == id))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]
        self.held = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.held += 1
        if self.held > MAX_ELEMENTS:
            raise PageTooLarge(f"more than {MAX_ELEMENTS} elements")
        if tag in ("li", "p") and self.open[-1].tag == tag:
            self.open.pop()
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].parts.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(page: str | None) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def metas(root: Element, name: str) -> list[str]:
    return [e.attributes.get("content", "").strip() for e in root.find_all("meta") if e.attributes.get("name", "").lower() == name]
