"""Readers and writers of feeds: RSS 2.0, RSS 1.0, Atom 1.0 and JSON Feed."""

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from datetime import datetime
from html import unescape
from xml.sax.saxutils import escape

from . import dates
from .dom import fragment, norm_space, plain_text, text_from_fragment
from .listing import Item
from .url import resolve

# XML namespaces of feed extensions.
DC, CONTENT, MEDIA = "http://purl.org/dc/elements/1.1/", "http://purl.org/rss/1.0/modules/content/", "http://search.yahoo.com/mrss/"
RDF, ATOM = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2005/Atom"
FORMATS = ("rss", "atom", "json")
# Image types by the ending of the path.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml"}


class NotAFeed(ValueError):
    pass


@dataclass
class Document:
    title: str = ""
    link: str = ""
    format: str = ""
    items: list[Item] = field(default_factory=list)


def _split(tag: str) -> tuple[str, str]:
    space, _, name = tag.rpartition("}")
    return space[1:], name


class _Element:
    """Children of an element by name and, where asked for, namespace."""

    def __init__(self, e: ET.Element):
        self.e = e

    def all(self, name: str, space: str | None = None) -> list[ET.Element]:
        out = [c for c in self.e if _split(c.tag)[1] == name]
        if space is not None:
            return [c for c in out if _split(c.tag)[0] == space]
        own = [c for c in out if _split(c.tag)[0] in ("", _split(self.e.tag)[0])]  # one that isn't from an extension comes first
        return own or out

    def text(self, name: str, space: str | None = None) -> str:
        found = self.all(name, space)
        return "".join(found[0].itertext()) if found else ""

    def attr(self, name: str, attr: str, space: str | None = None) -> str:
        return next((c.get(attr) for c in self.all(name, space) if c.get(attr)), "")


_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)([A-Za-z][A-Za-z0-9]*;)?")


def _tree(body: str) -> ET.Element:
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", re.sub(r"^\s*<\?xml[^>]*\?>", "", body), flags=re.I)
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        loose = _ENTITY.sub(lambda m: unescape("&" + m.group(1)).replace("&", "&amp;") if m.group(1) else "&amp;", text)
        try:
            return ET.fromstring(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", loose))
        except ET.ParseError as e:
            raise NotAFeed(str(e)) from None


def _is_url(s: str) -> bool:
    return s.strip().startswith(("http://", "https://"))


def _first(*values: str) -> str:
    return next((v for v in values if v.strip()), "")


def _rss_item(e: ET.Element, base: str, about: bool = False) -> Item:
    x = _Element(e)
    guid = x.text("guid", "") if e.tag == "item" else x.text("guid")
    href = x.text("link") or (e.get(f"{{{RDF}}}about", "") if about else "")
    image = x.attr("thumbnail", "url", MEDIA)
    if not image:
        image = next((c.get("url", "") for c in x.all("enclosure") if c.get("type", "").startswith("image/")), "")
    return Item(
        link=resolve(href, base) or (resolve(guid, base) if _is_url(guid) else ""), title=text_from_fragment(x.text("title")), author=x.text("author").strip() or x.text("creator", DC).strip(),
        date=dates.parse_feed_date(_first(x.text("pubDate"), x.text("date", DC))), image=image, guid=guid.strip(),
        summary=text_from_fragment(x.text("description")) or text_from_fragment(x.text("encoded", CONTENT)),
    )


def _rss(root: ET.Element, base: str) -> Document:
    channel = next(iter(_Element(root).all("channel")), ET.Element("channel"))
    x = _Element(channel)
    return Document(text_from_fragment(x.text("title")), resolve(x.text("link"), base), "rss", [_rss_item(e, base) for e in x.all("item")])


def _rdf(root: ET.Element, base: str) -> Document:
    x = _Element(next((c for c in root if _split(c.tag)[1] == "channel"), ET.Element("channel")))
    items = [_rss_item(c, base, True) for c in root if _split(c.tag)[1] == "item"]
    return Document(text_from_fragment(x.text("title")), resolve(x.text("link"), base), "rdf", items)


def _alternate(links: list[ET.Element], base: str, any_other: bool) -> str:
    chosen = [c for c in links if c.get("rel", "") in ("", "alternate")] or (links if any_other else [])
    return resolve(chosen[0].get("href", ""), base) if chosen else ""


def _atom_text(x: _Element, name: str) -> str:
    """Content of a text construct: markup inside it is kept as markup, to be read as such."""
    e = next(iter(x.all(name)), None)
    if e is None:
        return ""
    if len(e):
        inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
        return re.sub(r"(</?)[\w-]+:", r"\1", re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", inner))
    return e.text or ""


def _atom(root: ET.Element, base: str) -> Document:
    top = _Element(root)
    items = []
    for e in top.all("entry"):
        x = _Element(e)
        links, ident = x.all("link"), x.text("id")
        image = x.attr("thumbnail", "url", MEDIA) or next((c.get("href", "") for c in links if c.get("rel") == "enclosure" and c.get("type", "").startswith("image/")), "")
        author = next((_Element(a).text("name").strip() for a in x.all("author")), "")
        items.append(Item(
            link=_alternate(links, base, True) or (resolve(ident, base) if _is_url(ident) else ""), title=text_from_fragment(_atom_text(x, "title")), author=author,
            date=dates.parse_feed_date(_first(x.text("published"), x.text("updated"))), image=resolve(image, base), guid=ident.strip(),
            summary=text_from_fragment(_atom_text(x, "content")) or text_from_fragment(_atom_text(x, "summary")),
        ))
    return Document(text_from_fragment(_atom_text(top, "title")), _alternate(top.all("link"), base, False), "atom", items)


def _json(body: str, base: str) -> Document:
    try:
        d = json.loads(body)
    except ValueError as e:
        raise NotAFeed(str(e)) from None
    if not isinstance(d, dict) or not isinstance(d.get("items") or [], list):
        raise NotAFeed("no JSON Feed")

    def get(x: dict, key: str) -> str:
        v = x.get(key)
        return v if isinstance(v, str) else ""

    items = []
    for x in d.get("items") or []:
        if not isinstance(x, dict):
            raise NotAFeed("an item is no object")
        people = x.get("authors") or ([x["author"]] if isinstance(x.get("author"), dict) else [])
        ident = get(x, "id")
        summary = get(x, "content_text").strip() or text_from_fragment(get(x, "content_html")) or text_from_fragment(get(x, "summary"))
        items.append(Item(
            link=resolve(get(x, "url"), base) or (resolve(ident, base) if _is_url(ident) else ""), title=text_from_fragment(get(x, "title")),
            author=get(people[0], "name").strip() if people and isinstance(people[0], dict) else "", date=dates.parse_feed_date(_first(get(x, "date_published"), get(x, "date_modified"))),
            image=get(x, "image").strip(), summary=norm_space(summary), guid=ident.strip(),
        ))
    return Document(norm_space(get(d, "title")), get(d, "home_page_url").strip(), "json", items)


_ROOT = re.compile(r"\s*(?:(?:<\?.*?\?>|<!--.*?-->|<![^>\[]*(?:\[.*?\])?[^>]*>)\s*)*<(?:[\w.-]+:)?([\w.-]+)", re.S)


def sniff(body: str) -> str:
    """Kind of a document by its first tag or brace: json, rss, atom, rdf or ''."""
    body = body.lstrip("﻿").strip()
    if body.startswith("{"):
        return "json"
    m = _ROOT.match(body)
    return {"rss": "rss", "feed": "atom", "rdf": "rdf"}.get(m.group(1).lower(), "") if m else ""


def parse(body: str | bytes, base: str = "") -> Document:
    """A feed's items. Raises NotAFeed."""
    text = (body.decode("utf-8", "replace") if isinstance(body, bytes) else body).lstrip("﻿").strip()
    kind = sniff(text)
    if not kind:
        raise NotAFeed("no feed")
    return _json(text, base) if kind == "json" else {"rss": _rss, "rdf": _rdf, "atom": _atom}[kind](_tree(text), base)


# ---------------------------------------------------------------- writers


@dataclass
class Entry:
    title: str = ""
    link: str = ""
    guid: str = ""
    published: datetime | None = None
    updated: datetime | None = None
    author: str = ""
    summary: str = ""
    content_html: str = ""
    image: str = ""


@dataclass
class Feed:
    title: str = ""
    link: str = ""
    description: str = ""
    language: str = ""
    self_link: str = ""
    self_type: str = ""
    updated: datetime | None = None
    ttl: int = 0
    entries: list[Entry] = field(default_factory=list)


def image_type(url: str) -> str:
    name = re.split(r"[?#]", url)[0].rpartition("/")
    return IMAGE_TYPES.get(name[2].rpartition(".")[2].lower(), "") if name[1] and "." in name[2] else ""


def strip_tags(source: str) -> str:
    return plain_text(fragment(source)) if source else ""


_BAD_XML = re.compile(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


class _Xml:
    """Indented XML, an element a line."""

    def __init__(self):
        self.lines = ['<?xml version="1.0" encoding="UTF-8"?>']
        self.depth = 0

    @staticmethod
    def _safe(s: str) -> str:
        return escape(_BAD_XML.sub("�", s), {'"': "&#34;", "'": "&#39;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"})

    def _tag(self, name: str, attrs: dict) -> str:
        return name + "".join(f' {k}="{self._safe(v)}"' for k, v in attrs.items() if v)

    def leaf(self, name: str, text: str = "", /, **attrs: str) -> None:
        attrs = {k.replace("__", ":"): v for k, v in attrs.items()}
        self.lines.append(f"{'  ' * self.depth}<{self._tag(name, attrs)}>{self._safe(text)}</{name}>")

    def some(self, name: str, text: str, /, **attrs: str) -> None:
        if text:
            self.leaf(name, text, **attrs)

    def open(self, name: str, attrs: dict | None = None) -> None:
        self.lines.append(f"{'  ' * self.depth}<{self._tag(name, attrs or {})}>")
        self.depth += 1

    def close(self, name: str) -> None:
        self.depth -= 1
        self.lines.append(f"{'  ' * self.depth}</{name}>")

    def __str__(self) -> str:
        return "\n".join(self.lines) + "\n"


def write_rss(f: Feed) -> str:
    x = _Xml()
    media = MEDIA if any(e.image for e in f.entries) else ""
    x.open("rss", {"version": "2.0", "xmlns:content": CONTENT, "xmlns:atom": ATOM, "xmlns:dc": DC, "xmlns:media": media})
    x.open("channel")
    x.leaf("title", f.title)
    x.leaf("link", f.link)
    x.leaf("description", f.description or f.title)
    x.some("language", f.language)
    x.some("lastBuildDate", dates.rfc1123(f.updated))
    x.some("ttl", str(f.ttl or ""))
    if f.self_link:
        x.leaf("atom:link", href=f.self_link, rel="self", type=f.self_type)
    for e in f.entries:
        x.open("item")
        x.leaf("title", e.title)
        x.leaf("link", e.link)
        x.leaf("guid", e.guid, isPermaLink="true" if e.guid.startswith("http") else "")
        x.some("pubDate", dates.rfc1123(e.published))
        x.some("dc:creator", e.author)
        x.leaf("description", e.summary or norm_space(strip_tags(e.content_html)))
        x.some("content:encoded", e.content_html)
        if e.image:
            x.leaf("media:thumbnail", url=e.image, medium="image", type=image_type(e.image))
        x.close("item")
    x.close("channel")
    x.close("rss")
    return str(x)


def write_atom(f: Feed) -> str:
    x = _Xml()
    media = MEDIA if any(e.image and not image_type(e.image) for e in f.entries) else ""
    x.open("feed", {"xmlns": ATOM, "xmlns:media": media})
    x.leaf("title", f.title)
    x.some("subtitle", f.description)
    x.leaf("id", f.link or f"urn:feed:{dates.iso(f.updated)}")
    x.leaf("updated", dates.iso(f.updated) or "2000-01-01T00:00:00Z")
    x.leaf("link", href=f.link, rel="alternate")
    if f.self_link:
        x.leaf("link", href=f.self_link, rel="self", type=f.self_type)
    for e in f.entries:
        kind = image_type(e.image)
        x.open("entry")
        x.leaf("title", e.title)
        x.leaf("id", e.guid)
        x.leaf("updated", dates.iso(e.updated or e.published or f.updated) or "2000-01-01T00:00:00Z")
        x.some("published", dates.iso(e.published))
        x.leaf("link", href=e.link, rel="alternate")
        if kind:
            x.leaf("link", href=e.image, rel="enclosure", type=kind)
        elif e.image:
            x.leaf("media:thumbnail", url=e.image, medium="image")
        x.some("summary", e.summary or norm_space(strip_tags(e.content_html)))
        x.some("content", e.content_html, type="html")
        x.close("entry")
    x.close("feed")
    return str(x)


def write_json(f: Feed) -> str:
    def some(**fields):
        return {k: v for k, v in fields.items() if v}

    items = [
        {"id": e.guid}
        | some(url=e.link, title=e.title, content_html=e.content_html, content_text=strip_tags(e.content_html) or e.summary, summary=e.summary, image=e.image,
               date_published=dates.iso(e.published), date_modified=dates.iso(e.updated or e.published), authors=[{"name": e.author}] if e.author else None)
        for e in f.entries
    ]
    doc = {"version": "https://jsonfeed.org/version/1.1", "title": f.title} | some(home_page_url=f.link, description=f.description, language=f.language) | {"items": items}
    text = json.dumps(doc, ensure_ascii=False, indent=2)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n"


def write(f: Feed, kind: str) -> str:
    """A feed as text. Raises ValueError for unknown kinds."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    return {"rss": write_rss, "atom": write_atom, "json": write_json}[kind](f)


def write_opml(outlines: list[tuple[str, str]], title: str, created: datetime) -> str:
    """Subscription list of (key, page) pairs; an outline is named by its page, else its key."""
    x = _Xml()
    x.lines = []
    x.open("opml", {"version": "2.0"})
    x.open("head")
    x.leaf("title", title)
    x.leaf("dateCreated", dates.rfc1123(created).replace("+0000", "GMT"))
    x.close("head")
    x.open("body")
    for key, page in outlines:
        x.leaf("outline", text=page or key, title=page or key, type="rss", htmlUrl=page, xmlUrl=key)
    x.close("body")
    x.close("opml")
    return str(x).rstrip("\n")
