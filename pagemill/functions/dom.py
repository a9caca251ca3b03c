"""A small forgiving HTML tree, used per page inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pagemill import fixed_values as fv

# fixed values of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# a start tag closes these open tags, looking no further up than the boundary tags
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
P_BOUNDARY = {"td", "th", "table", "button", "object", "caption"}
NOT_TEXT = {"script", "style", "template", "rt", "rp"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_SPACE = re.compile(r"\s+")
_SHORT_COMMENT = re.compile(r"<!--(?:-?>|.*?--!>)", re.DOTALL)  # ends of a comment beside -->


class Node:
    __slots__ = ("tag", "attrs", "held", "parent", "thinned")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag = tag
        self.attrs = attrs
        self.held: list[Node | str] = []
        self.thinned = False
        self.parent = parent

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                trimmed = item.strip()
                if trimmed:
                    yield trimmed
            elif item.tag not in NOT_TEXT:
                stack.extend(reversed(item.children))

    def text(self, separator: str = " ") -> str:
        return separator.join(self.strings())

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def detach(self) -> None:
        """Take the node out; its parent's list of children is rebuilt once, when next read."""
        if self.parent is not None:
            self.parent.thinned = True
            self.parent = None

    @property
    def children(self) -> list[Node | str]:
        if self.thinned:
            self.held = [c for c in self.held if isinstance(c, str) or c.parent is self]
            self.thinned = False
        return self.held


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.open = [self.root]

    def _close(self, tags: set[str], boundary: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                del self.open[depth:]
                return self._close(tags, boundary)
            if tag in boundary:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in CLOSES_P:
            self._close({"p"}, P_BOUNDARY)
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        node = Node(tag, values, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_comment(self, i, report=1):
        """A comment that nothing ends hides the rest of the page, as in the HTML standard."""
        end = super().parse_comment(i, report)
        if end < 0:
            short = _SHORT_COMMENT.match(self.rawdata, i)
            end = short.end() if short else len(self.rawdata)
        return end

    def parse_html_declaration(self, i):
        """A marked section of an unknown name is a comment, no error."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.parse_bogus_comment(i)
            return end if end >= 0 else len(self.rawdata)


def build(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def body_of(root: Node) -> Node:
    return root.first(lambda n: n.tag == "body") or root


def drop_boilerplate(root: Node) -> None:
    def is_boilerplate(n: Node) -> bool:
        if n.tag in fv.BOILERPLATE_TAGS or n.attrs.get("role") in fv.BOILERPLATE_ROLES:
            return True
        if n.attrs.get("aria-modal") == "true" or n.attrs.get("id") in fv.BOILERPLATE_IDS:
            return True
        if any(c in fv.BOILERPLATE_CLASSES for c in n.classes()):
            return True
        marker = f"{' '.join(n.classes())} {n.attrs.get('id', '')}".lower()
        return any(k in marker for k in fv.BOILERPLATE_KEYWORDS)

    for node in [n for n in root.walk() if is_boilerplate(n)]:
        node.detach()


def main_container(root: Node) -> Node:
    nodes = list(root.walk())
    tests: list[Callable[[Node], bool]] = [lambda n, t=t: n.tag == t for t in fv.CONTENT_TAGS]
    tests.append(lambda n: n.attrs.get("role") == fv.CONTENT_ROLE)
    tests += [lambda n, c=c: c in n.classes() for c in fv.CONTENT_CLASSES]
    candidates = [n for test in tests for n in nodes if test(n)]
    if not candidates:
        return body_of(root)
    return max(candidates, key=lambda n: len(n.text()))


def _meta(root: Node, attribute: str, value: str) -> str:
    node = root.first(lambda n: n.tag == "meta" and n.attrs.get(attribute) == value)
    return squeeze(node.attrs.get("content", "")) if node else ""


def _tag_text(root: Node, tag: str) -> str | None:
    node = root.first(lambda n: n.tag == tag)
    return squeeze(node.text()) if node else None


def title_of(root: Node) -> str:
    shared = _meta(root, "property", "og:title")
    if shared:
        return shared
    title = _tag_text(root, "title")
    return title if title is not None else (_tag_text(root, "h1") or "")


def description_of(root: Node) -> str:
    return _meta(root, "name", "description") or _meta(root, "property", "og:description")


def document(root: Node, strip_boilerplate: bool = True) -> dict:
    """Structured content of one page; changes ``root``."""
    if strip_boilerplate:
        drop_boilerplate(root)
    container = main_container(root)
    nodes = [container, *container.walk()]
    blocks = [
        (n.tag, t) for n in nodes if n.tag in HEADINGS or n.tag == "p" if (t := squeeze(n.text()))
    ]
    lists = []
    tables = []
    for n in nodes:
        if n.tag in ("ul", "ol"):
            entries = (c for c in n.children if isinstance(c, Node) and c.tag == "li")
            items = [t for c in entries if (t := squeeze(c.text()))]
            if items:
                lists.append(items)
        elif n.tag == "table":
            grid = [
                [squeeze(c.text()) for c in row.walk() if c.tag in ("th", "td")]
                for row in n.walk()
                if row.tag == "tr"
            ]
            rows = [cells for cells in grid if any(cells)]
            if rows:
                tables.append({"rows": rows})
    content = "\n\n".join(dict.fromkeys(t for _, t in blocks))
    return {
        "title": title_of(root),
        "meta_description": description_of(root),
        "headings": [{"level": int(tag[1]), "text": t} for tag, t in blocks if tag != "p"],
        "content": content or squeeze(container.text("\n")),
        "lists": lists,
        "tables": tables,
    }


def visible_text(root: Node) -> str:
    for node in [n for n in root.walk() if n.tag in fv.INVISIBLE_TAGS]:
        node.detach()
    return root.text()


def links(root: Node, base: str) -> list[str]:
    """Absolute link targets in page order."""
    out = []
    for node in root.walk():
        if node.tag != "a" or "href" not in node.attrs:
            continue
        href = node.attrs["href"].strip()
        if not href or href.startswith(tuple(fv.SKIPPED_LINK_SCHEMES)):
            continue
        try:
            out.append(urljoin(base, href))
        except ValueError:
            continue
    return out


def needs_render(root: Node) -> bool:
    if len(body_of(root).text()) < 250:
        return True
    nodes = list(root.walk())
    scripts = sum(n.tag == "script" for n in nodes)
    blocks = sum(n.tag in ("p", "li", "h1", "h2", "h3") for n in nodes)
    js_root = any(n.attrs.get("id") in ("__next", "root") for n in nodes)
    return (js_root and blocks < 3) or (scripts > 15 and blocks < 5)
