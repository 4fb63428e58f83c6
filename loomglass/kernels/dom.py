"""A small HTML tree: forgiving parser, text readers, serialiser.

The parser follows the shape that browsers give to pages: html, head and body
exist always, void elements have no content, paragraphs, list items, table
parts and options end where the next one begins, and the contents of script,
style, title and textarea are text. Misnested inline tags are closed with the
element that holds them.
"""

import html as entities
import re
from collections.abc import Iterator

from .text import norm_space

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
# Elements whose text no reader sees, and those that stand on lines of their own.
INERT = frozenset("script style template noscript svg math".split())
BLOCK = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section "
    "table tbody td tfoot th thead tr ul".split()
)
# A start tag in the second set ends an open element of the first, up to an element of the third.
CLOSES = [
    ({"p"}, BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"center", "dir", "menu", "summary", "details", "hgroup", "search", "listing", "xmp", "plaintext", "li", "dd", "dt"}, {"button", "td", "th", "caption", "html", "object", "template"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dd", "dt"}, {"dd", "dt"}, {"dl"}),
    ({"option"}, {"option", "optgroup"}, {"select", "datalist"}),
    ({"optgroup"}, {"optgroup"}, {"select"}),
    ({"td", "th"}, {"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tr"}, {"tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot"}, {"table"}),
    ({"a"}, {"a"}, {"td", "th", "caption", "table", "body", "html", "div", "p", "li", "article", "section"}),
    ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"body", "html", "div", "section", "article", "td", "li", "header", "a"}),
]
# End tags do not reach out of these.
SCOPE = {"td", "th", "caption", "table", "html", "body", "template", "button", "object", "marquee"}
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|--!>|\Z)|!([^>]*)(?:>|\Z)|\?([^>]*)(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|/([^a-zA-Z>][^>]*)?(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*?)(/?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")


class Node:
    """An element (tag), a text or comment node (data), or the document."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "kind")

    def __init__(self, kind: str, tag: str = "", attrs: dict[str, str] | None = None, data: str = ""):
        self.kind, self.tag, self.attrs, self.data = kind, tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def attr(self, name: str) -> str:
        return self.attrs.get(name.lower(), "")

    @property
    def classes(self) -> list[str]:
        return self.attr("class").split()

    def append(self, child: "Node") -> "Node":
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def unwrap(self) -> None:
        """Put the children in this element's place."""
        if self.parent is not None:
            at = self.parent.children.index(self)
            for c in self.children:
                c.parent = self.parent
            self.parent.children[at : at + 1] = self.children
            self.children, self.parent = [], None

    def walk(self, enter=None) -> Iterator["Node"]:
        """This node and all below it in document order; enter(node) false leaves its inside out."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if enter is None or enter(n):
                stack.extend(reversed(n.children))

    def elements(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.kind == "element" and (not tags or n.tag in tags)]

    def first(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.kind == "element" and n.tag in tags), None)

    def ancestors(self) -> Iterator["Node"]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder:
    def __init__(self):
        self.doc = Node("document")
        self.html = self.doc.append(Node("element", "html"))
        self.head = self.html.append(Node("element", "head"))
        self.body: Node | None = None
        self.stack = [self.html, self.head]

    def in_body(self) -> None:
        if self.body is None:
            self.body = self.html.append(Node("element", "body"))
            self.stack = [self.html, self.body]

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None and self.stack[-1] is self.head:
            if not data.strip():
                return
            self.in_body()
        top = self.stack[-1]
        if top.children and top.children[-1].kind == "text":
            top.children[-1].data += data
        else:
            top.append(Node("text", data=data))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag in ("html", "body", "head"):
            if tag == "body":
                self.in_body()
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                node.attrs.setdefault(k, v)
            return None
        if self.body is None and self.stack[-1] is self.head and tag not in HEAD_ONLY:
            self.in_body()
        for ends, by, stop in CLOSES:
            if tag in by:
                for k in range(len(self.stack) - 1, 1, -1):
                    if self.stack[k].tag in ends:
                        del self.stack[k:]
                        break
                    if self.stack[k].tag in stop:
                        break
        node = self.stack[-1].append(Node("element", tag, attrs))
        if tag not in VOID and not (closed and self._foreign()):
            self.stack.append(node)
        return node

    def _foreign(self) -> bool:
        return any(n.tag in ("svg", "math") for n in self.stack)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.in_body()
            return
        if tag == "br":
            self.start("br", {}, False)
            return
        for k in range(len(self.stack) - 1, 0, -1):
            n = self.stack[k]
            if n is self.head or n is self.body:
                break
            if n.tag == tag:
                del self.stack[k:]
                return
            if n.tag in SCOPE and tag not in SCOPE | {"tr", "tbody", "thead", "tfoot"}:
                break
        if tag == "p":
            self.start("p", {}, False)
            self.stack.pop()


def parse(source: str) -> Node:
    """The tree of a page or fragment; never fails."""
    b = _Builder()
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            b.text(entities.unescape(source[at:]))
            break
        if lt > at:
            b.text(entities.unescape(source[at:lt]))
        m = _TAG.match(source, lt)
        if m is None:
            b.text("<")
            at = lt + 1
            continue
        at = m.end()
        comment, _, _, end, _, tag, attrs, slash = m.groups()
        if comment is not None:
            b.stack[-1].append(Node("comment", data=comment))
        elif end:
            b.end(end.lower())
        elif tag:
            tag = tag.lower()
            found = {}
            for k, v in _ATTR.findall(attrs or ""):
                found.setdefault(k.lower(), entities.unescape(v[1:].removesuffix(v[0]) if v[:1] in "\"'" and v else v))
            node = b.start(tag, found, bool(slash))
            if node is not None and (tag in RAW or tag in ESCAPABLE):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                inner = source[at : close.start() if close else n]
                if inner:
                    node.append(Node("text", data=entities.unescape(inner) if tag in ESCAPABLE else inner))
                at = close.end() if close else n
                if b.stack[-1] is node:
                    b.stack.pop()
    b.in_body()
    return b.doc


def fragment(source: str) -> Node:
    """A div that holds the fragment's nodes."""
    return parse("<div>" + source + "</div>").first("div")


def body_of(doc: Node) -> Node:
    return doc.first("body") or doc


def text_of(n: Node | None, inert: bool = False) -> str:
    """Text below a node as it stands, without that of inert elements unless asked for."""
    if n is None:
        return ""
    return "".join(x.data for x in n.walk(lambda x: inert or x.tag not in INERT) if x.kind == "text")


def plain_text(n: Node | None) -> str:
    """Text for reading: blocks are set apart by white space."""
    out: list[str] = []

    def visit(x: Node) -> None:
        if x.kind == "text":
            out.append(x.data)
        elif x.tag not in INERT:
            edge = "\n" if x.tag in BLOCK else ""
            out.append(edge)
            for c in x.children:
                visit(c)
            out.append(edge)

    if n is not None:
        _deep(visit, n)
    return norm_space("".join(out))


def _deep(visit, n: Node) -> None:
    """Run a recursion over a tree that may be deeper than Python's limit."""
    import sys

    limit = sys.getrecursionlimit()
    try:
        visit(n)
    except RecursionError:
        sys.setrecursionlimit(max(limit, 200_000))
        import threading

        threading.stack_size(512 << 20)
        t = threading.Thread(target=visit, args=(n,))
        t.start()
        t.join()
        threading.stack_size(0)
    finally:
        sys.setrecursionlimit(limit)


def text_nodes(n: Node) -> list[Node]:
    return [x for x in n.walk(lambda x: x.tag not in INERT) if x.kind == "text" and x.data.strip()]


def text_length(n: Node | None) -> int:
    return len(norm_space(text_of(n)))


def is_visible(n: Node | None) -> bool:
    """Not hidden by its own attributes."""
    if n is None or n.kind == "comment":
        return False
    style = n.attr("style").replace(" ", "").lower()
    return not ("display:none" in style or "visibility:hidden" in style or "hidden" in n.attrs or n.attr("aria-hidden") == "true")


def _escape(s: str, attr: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;").replace("\r", "&#13;")
    return s


def render(n: Node) -> str:
    """Source of a node."""
    if n.kind == "text":
        return n.data if n.parent is not None and n.parent.tag in RAW else _escape(n.data)
    if n.kind == "comment":
        return f"<!--{n.data}-->"
    inner = "".join(map(render, n.children))
    if n.kind == "document":
        return inner
    start = f"<{n.tag}" + "".join(f' {k}="{_escape(v)}"' for k, v in n.attrs.items())
    return start + "/>" if n.tag in VOID else f"{start}>{inner}</{n.tag}>"


def inner_html(n: Node | None) -> str:
    return "".join(map(render, n.children)) if n else ""


def text_from_fragment(s: str | None) -> str:
    """Plain text of a field that may hold markup or entities."""
    s = (s or "").strip()
    return plain_text(parse(s)) if "<" in s or "&" in s else norm_space(s)
