"""Items of a listing page: by selectors, or detected from the shapes of its links."""

import re
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime

from . import dates
from .dom import Node, is_visible, norm_space, parse, plain_text, text_nodes, text_of
from .selectors import select_all, select_attr, select_one, select_plain, select_text
from .text import truncate
from .url import group_patterns, keep_query_params, normalize, path_key, pattern, resolve, same_site, set_host, slug

# Tags, and parts of ids and classes, that mark page furniture.
CHROME_TAGS = frozenset("nav header footer aside form select menu dialog".split())
CHROME_PARTS = (
    "nav navbar menu sidebar side-bar footer header masthead breadcrumb banner advert ads promo widget social share subscribe newsletter comment related "
    "recommend trending popular tag-list pagination pager"
).split()
# Link schemes that lead to no document, image attributes and author and date selectors in the order tried.
DEAD_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "sms:", "whatsapp:")
IMAGE_ATTRS = ("src", "data-src", "data-original", "data-lazy-src")
AUTHOR_SELECTORS = ('[rel="author"]', ".author", ".byline", ".penulis")
DATE_SELECTORS = ('[itemprop*="date"]', '[class*="date"]', '[class*="time"]')
# Words that introduce a name, and whether a mark must stand between.
BYLINES = (("oleh", False), ("penulis", False), ("writer", True), ("author", True), ("by", True))
BYLINE_MARKS = ":-–—"
MIN_ITEMS, SUMMARY_CHARS = 3, 300


@dataclass(frozen=True)
class ListOptions:
    base_url: str = ""
    item: tuple[str, ...] = ()
    url: tuple[str, ...] = ()
    title: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    date: tuple[str, ...] = ()
    image: tuple[str, ...] = ()
    summary: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    strip_css: tuple[str, ...] = ()
    keep_query_params: str = ""
    allow_cross_host: bool = False
    force_host: str = ""
    min_items: int = 0
    max_items: int = 0


@dataclass
class Item:
    link: str = ""
    title: str = ""
    author: str = ""
    date: datetime | None = None
    image: str = ""
    summary: str = ""
    guid: str = ""


@dataclass
class Detection:
    selector: str = ""
    confidence: str = ""
    reason: str = ""
    candidates: list[dict] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)


def is_chrome(n: Node) -> bool:
    names = [n.attr("id").lower(), *(c.lower() for c in n.classes)]
    return n.tag in CHROME_TAGS or any(part in name for name in names for part in CHROME_PARTS)


def acceptable(link: str, o: ListOptions) -> bool:
    if not link or link.startswith("#") or link.lower().startswith(DEAD_SCHEMES):
        return False
    return not o.base_url or o.allow_cross_host or same_site(link, o.base_url)


def _forced(link: str, o: ListOptions) -> str:
    return set_host(link, o.force_host) if link and o.force_host else link


def _is_fragment(href: str) -> bool:
    return href.strip().startswith("#")


def byline_value(rest: str, needs_mark: bool) -> str | None:
    """The name after a label: one word, or two if the second is capitalised."""
    rest = rest.lstrip(" \t\n\r")
    if not rest or (needs_mark and rest[0] not in BYLINE_MARKS):
        return None
    words = rest.lstrip(BYLINE_MARKS + " \t\n\r").split()
    if not words:
        return None
    second = words[1].strip(".,;:") if len(words) > 1 else ""
    name = f"{words[0]} {words[1]}" if second[:1].isupper() else words[0]
    return name.strip(".,;:")


def find_byline(text: str) -> str:
    """A name behind a label at the start of a text, or inside it if a mark follows the label at once."""
    text = text.strip()
    low = text.lower()
    for label, needs_mark in BYLINES:
        if low.startswith(label) and (name := byline_value(text[len(label) :], needs_mark)) is not None:
            return name
        for m in re.finditer(rf"(?:^|(?<=[ \t\n\r>\"(\[|,•·–—])){label}(?=[{BYLINE_MARKS}])", low):
            if (name := byline_value(text[m.end() :], True)) is not None:
                return name
    return ""


def without_label(text: str) -> str:
    text = text.strip()
    for label, _ in BYLINES:
        if text.lower().startswith(label) and (name := byline_value(text[len(label) :], False)) is not None:
            return name
    return text


def _anchor(c: Node, o: ListOptions) -> Node | None:
    if o.url:
        return select_one(c, o.url)
    return next((a for a in c.elements("a") if a.attr("href") and not _is_fragment(a.attr("href"))), None)


def _title(c: Node, anchor: Node | None, link: str, o: ListOptions) -> str:
    def sources():
        if o.title:
            yield select_text(c, o.title)
        yield norm_space(text_of(anchor))
        for tag in ("h1", "h2", "h3", "h4"):
            yield norm_space(text_of(c.first(tag)))
        yield from (norm_space(i.attr("alt")) for i in c.elements("img"))
        yield slug(link).replace("-", " ")

    return next((t for t in sources() if t), "")


def _author(c: Node, o: ListOptions) -> str:
    if o.author and (t := select_text(c, o.author)):
        return without_label(t)
    for s in AUTHOR_SELECTORS:
        if name := without_label(select_text(c, (s,))):
            return name
    return next((name for t in text_nodes(c) if (name := find_byline(t.data))), "")


def _date(c: Node, o: ListOptions) -> datetime | None:
    places = [*select_all(c, o.date), *c.elements("time"), *select_all(c, DATE_SELECTORS)]
    for n in places:
        for value in (n.attr("datetime"), n.attr("content"), plain_text(n)):
            if value and (t := dates.parse(value)):
                return t
    return dates.find(norm_space(text_of(c)))


def _image(c: Node, o: ListOptions) -> str:
    if o.image and (v := select_attr(c, o.image, "src", o.base_url)):
        return _forced(v, o)
    for img in c.elements("img"):
        for name in IMAGE_ATTRS:
            if (v := img.attr(name)) and not v.startswith("data:"):
                return _forced(resolve(v, o.base_url), o)
    return ""


def item_of(c: Node, o: ListOptions) -> Item | None:
    """The item a container holds, if its link is one that may be listed."""
    anchor = _anchor(c, o)
    href = anchor.attr("href") if anchor else ""
    if anchor and _is_fragment(href):
        return None
    link = resolve(href, o.base_url)
    if o.url and (v := select_attr(c, o.url, "href", o.base_url)):
        link, anchor = v, None
    link = _forced(link, o)
    if not acceptable(link, o) or (o.base_url and normalize(link) == normalize(o.base_url)):
        return None
    link = keep_query_params(link, o.keep_query_params)
    summary = select_plain(c, o.summary) if o.summary else truncate(plain_text(c), SUMMARY_CHARS)
    return Item(link, _title(c, anchor, link, o), _author(c, o), _date(c, o), _image(c, o), summary)


def by_selectors(doc: Node, o: ListOptions) -> list[Item]:
    """Items of the containers that o.item selects, one for each link, cut to o.max_items."""
    containers = select_all(doc, o.item)
    for n in select_all(doc, o.strip_css):
        n.children = []
    out_of = {id(n) for n in select_all(doc, o.exclude)}
    items: dict[str, Item] = {}
    for c in containers:
        if id(c) in out_of or any(id(a) in out_of for a in c.ancestors()):
            continue
        if it := item_of(c, o):
            items.setdefault(normalize(it.link), it)
    found = list(items.values())
    return found[: o.max_items] if o.max_items > 0 else found


def link_refs(doc: Node, o: ListOptions, chrome: bool = False) -> list[tuple[str, Node, bool]]:
    """(link, anchor, in page furniture) of the anchors that may lead to items, in page order; furniture only if asked for."""
    out: list[tuple[str, Node, bool]] = []
    inside: set[int] = set()

    def enter(n: Node) -> bool:
        if n.kind == "element" and (id(n.parent) in inside or is_chrome(n)):
            inside.add(id(n))
            return chrome
        return True

    for n in doc.walk(enter):
        if n.kind != "element" or n.tag != "a":
            continue
        furniture = id(n.parent) in inside or is_chrome(n)
        if furniture and not chrome:
            continue
        href = _forced(resolve(n.attr("href"), o.base_url), o)
        if acceptable(href, o) and is_visible(n):
            out.append((href, n, furniture))
    return out


def _containers(anchors: list[Node]) -> list[Node]:
    """For each anchor the highest ancestor that holds no other of them."""
    count: Counter = Counter()
    for a in anchors:
        count.update(id(n) for n in (a, *a.ancestors()))
    out = []
    for a in anchors:
        best = a
        for n in (a, *a.ancestors()):
            if count[id(n)] != 1:
                break
            best = n
        out.append(best)
    return out


def selector_for(n: Node) -> str:
    if n.attr("id"):
        return "#" + n.attr("id")
    if n.classes:
        return "." + n.classes[0]
    return "" if n.tag in ("body", "html") else n.tag


def grade(counts: list[int], min_items: int = MIN_ITEMS) -> str:
    """Trust in the first of several patterns, given their link counts in order."""
    best, second = counts[0], counts[1] if len(counts) > 1 else 0
    if len(counts) < 2:
        return "medium"
    if best >= max(2 * min_items, 10) and best >= 2 * second:
        return "high"
    return "medium" if best >= min_items and best > second else "low"


def detect(doc: Node, o: ListOptions) -> Detection | None:
    """The page's list by the shape of its links; None if no shape has enough links with differing slugs."""
    refs = link_refs(doc, o)
    least = o.min_items if o.min_items > 0 else MIN_ITEMS
    anchors: dict[str, list[Node]] = {}  # by shape
    for link, n, _ in refs:
        if p := pattern(link):
            anchors.setdefault(p[0], []).append(n)
    candidates = []
    for g in group_patterns([link for link, _, _ in refs]):
        slugs = len({s.lower() for s in g["slugs"]})
        if g["count"] < least or slugs < 2:
            continue
        votes = Counter(s for c in _containers(anchors[g["pattern"]]) if (s := selector_for(c)))
        best = min(votes, key=lambda s: (-votes[s], s), default="")
        candidates.append({"selector": best, "pattern": g["pattern"], "count": g["count"], "distinct_slugs": slugs, "depth": g["depth"], "host": g["host"]})
    if not candidates:
        return None
    first = candidates[0]
    counts = [c["count"] for c in candidates]
    trust = grade(counts, least)
    near = f"; the next has {counts[1]}" if len(counts) > 1 else ", the only shape on the page"
    items: dict[str, Item] = {}
    seen: set[int] = set()
    for c in _containers(anchors[first["pattern"]]):
        if id(c) not in seen and (it := item_of(c, o)):
            items.setdefault(path_key(it.link), it)
        seen.add(id(c))
    return Detection(first["selector"], trust, f"{first['count']} links share {first['pattern']}{near}", candidates, list(items.values()))


def collect(source: str, o: ListOptions) -> tuple[list[Item], Detection | None]:
    """Items of a page, by o.item if given, else detected."""
    doc = parse(source)
    if o.item:
        return by_selectors(doc, o), None
    found = detect(doc, o)
    return (found.items if found else []), found


# Kinds of feed that a page may point to.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/json")


def discovered_feed(source: str, base: str) -> str:
    """The last alternate feed that a page links to, or ''."""
    links = [n.attr("href") for n in parse(source).elements("link") if "alternate" in n.attr("rel") and n.attr("type") in FEED_TYPES and n.attr("href")]
    return resolve(links[-1], base) if links else ""
