"""Article extraction: metadata, and a body found by the first of five strategies that gives enough text.

The strategies: a configured selector, structured data (JSON-LD), declared
containers, paragraph scoring in the manner of published readability
heuristics, and text density.
"""

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from . import dates
from .dom import INERT, Node, fragment, is_visible, norm_space, parse, plain_text, text_length, text_of
from .sanitize import Rules, sanitized
from .selectors import select_all
from .text import excerpt, first_of, truncate, word_count
from .url import clean_tracking, resolve

MIN_BODY, MIN_SEMANTIC, MIN_OF_SEVERAL = 250, 200, 500
MAX_ELEMENTS = 100_000
# Types of structured data that describe an article, and the keys that lead from others to one.
ARTICLE_TYPES = frozenset(
    "NewsArticle Article Report AnalysisNewsArticle BackgroundNewsArticle OpinionNewsArticle ReportageNewsArticle ReviewNewsArticle TechArticle ScholarlyArticle "
    "MedicalScholarlyArticle BlogPosting LiveBlogPosting SocialMediaPosting DiscussionForumPosting WebPage AdvertiserContentArticle SatiricalArticle APIReference".split()
)
LEADS = ("mainEntity", "articleBody", "hasPart", "itemListElement")
PUBLISHED_KEYS = ("datePublished", "dateCreated", "uploadDate", "datePosted")
# Names of meta tags by the field they fill.
META = {
    "site_name": "og:site_name application-name",
    "byline": "author article:author og:article:author dc.creator dcterms.creator twitter:creator parsely-author",
    "published": "article:published_time og:article:published_time datepublished dc.date dcterms.date pubdate publish-date date sailthru.date parsely-pub-date citation_publication_date",
    "modified": "article:modified_time og:updated_time datemodified dc.date.issued lastmod parsely-post-id",
    "image": "og:image twitter:image twitter:image:src image thumbnail",
    "description": "og:description twitter:description description dc.description",
    "og_type": "og:type",
}
META_FIELD = {key: name for name, keys in META.items() for key in keys.split()}
TITLE_META = {"og:title": "og", "twitter:title": "twitter", "title": "meta", "dc.title": "meta", "dcterms.title": "meta"}
# What a title's source is worth, and the marks between a title and its site.
TITLE_WORTH = {"jsonld-name": 2.0, "jsonld-headline": 1.0, "og": 1.0, "twitter": 1.0, "h1": 1.0, "title": 0.5, "meta": 0.0}
SITE_MARKS = (" - ", " | ", " – ", " — ", " :: ", " » ", " • ")
CONTAINERS = frozenset("div section td blockquote form".split())
BLOCKS = frozenset("article section div main td blockquote pre form body".split())
#: Texts that are navigation on their own.
JUNK_TEXTS = frozenset("skip to content|back to top|show more|see also|print|copy link|close|accept all|loading|go to page".split("|"))


@dataclass
class Article:
    url: str = ""
    canonical: str = ""
    title: str = ""
    byline: str = ""
    published: datetime | None = None
    modified: datetime | None = None
    content_html: str = ""
    text_content: str = ""
    excerpt: str = ""
    site_name: str = ""
    image: str = ""
    lang: str = ""
    word_count: int = 0
    strategy: str = ""
    attempts: list[dict] = field(default_factory=list)


def is_junk_text(s: str) -> bool:
    t = norm_space(s).lower()
    return not t or t in JUNK_TEXTS


def strip_site_suffix(title: str, site_name: str) -> str:
    return next((title.removesuffix(m + site_name) for m in SITE_MARKS if site_name and title.endswith(m + site_name)), title)


@dataclass
class Metadata:
    fields: dict[str, str] = field(default_factory=dict)
    published: datetime | None = None
    modified: datetime | None = None
    canonical: str = ""
    titles: list[tuple[str, str]] = field(default_factory=list)
    h1: str = ""


def read_metadata(doc: Node) -> Metadata:
    """What the page's head says about it, and its first visible h1."""
    m = Metadata()

    def add_title(value: str, source: str) -> None:
        v = norm_space(value)
        if v and all(v != t for t, _ in m.titles):
            m.titles.append((v, source))

    root = doc.first("head") or doc
    for n in root.walk(lambda n: n.tag not in INERT and (n is root or n.tag != "head")):
        if n.kind != "element" or (n.tag in INERT and n is not root):
            continue
        if n.tag == "title":
            add_title(text_of(n), "title")
        elif n.tag == "link":
            rel, href = n.attr("rel").lower(), n.attr("href").strip()
            if href and not href.lower().startswith("data:"):
                if rel == "canonical":
                    m.canonical = m.canonical or href
                elif rel in ("icon", "apple-touch-icon") or "shortcut" in rel:
                    m.fields.setdefault("image", href)
        elif n.tag == "meta" and (content := n.attr("content")):
            for key in f"{n.attr('property')} {n.attr('name')}".lower().split():
                if key in TITLE_META:
                    add_title(content, TITLE_META[key])
                elif (name := META_FIELD.get(key)) in ("published", "modified"):
                    setattr(m, name, getattr(m, name) or dates.parse(content))
                elif name:
                    m.fields.setdefault(name, content)
    for n in doc.walk(lambda n: n.tag not in INERT and n.tag != "head"):
        if n.kind == "element" and n.tag == "h1" and (t := text_of(n).strip()):
            m.h1 = t
            break
    return m


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_TRAILING = re.compile(r",(?=[ \n\t\r]*[}\]])")


def loosened(raw: str) -> str:
    """JSON with trailing commas left out and raw line breaks in strings made spaces."""
    strings = _STRING.findall(raw)
    between = _TRAILING.sub("", _STRING.sub("\0", raw)).split("\0")
    filled = [re.sub(r"[\n\t\r]", " ", s) for s in strings] + [""]
    return "".join(a + b for a, b in zip(between, filled))


def _text(obj: dict, key: str) -> str:
    v = obj.get(key)
    return v.strip() if isinstance(v, str) else ""


def _named(v, keys: tuple[str, ...]) -> str:
    """A text, or the first of keys in an object, or of the objects of a list."""
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, dict):
        return next((s for k in keys if (s := _text(v, k))), "")
    if isinstance(v, list):
        return next((s for x in v if (s := _named(x, keys))), "")
    return ""


def _take(obj: dict, found: dict) -> bool:
    types = obj.get("@type")
    types = [types] if isinstance(types, str) else types if isinstance(types, list) else []
    if not any(isinstance(t, str) and t in ARTICLE_TYPES for t in types):
        return False
    publisher = obj.get("publisher")
    values = {
        "body": _text(obj, "articleBody"), "headline": _text(obj, "headline"), "name": _text(obj, "name"),
        "byline": _named(obj.get("author"), ("name",)) or _text(obj, "creator"), "image": _named(obj.get("image"), ("url", "contentUrl")),
        "site_name": _text(publisher, "name") if isinstance(publisher, dict) else "",
        "published": next((d for k in PUBLISHED_KEYS if (d := dates.parse(_text(obj, k)))), None), "modified": dates.parse(_text(obj, "dateModified")),
    }
    for k, v in values.items():
        if v and not found.get(k):
            found[k] = v
    return True


def _walk_data(v, found: dict) -> None:
    if isinstance(v, list):
        for x in v:
            _walk_data(x, found)
    elif isinstance(v, dict):
        if "@graph" in v:
            _walk_data(v["@graph"], found)
        if not _take(v, found):
            for k in LEADS:
                if k in v:
                    _walk_data(v[k], found)


def read_structured(doc: Node) -> dict:
    """First values of an article's fields over the page's JSON-LD blocks, up to the one that has a body."""
    found: dict = {}
    for n in doc.elements("script"):
        raw = text_of(n, inert=True).strip() if n.attr("type").lower() == "application/ld+json" else ""
        for source in (raw, loosened(raw)) if raw else ():
            try:
                _walk_data(json.loads(source), found)
                break
            except (ValueError, RecursionError):
                continue
        if found.get("body"):
            break
    return found


def pick_title(candidates: list[tuple[str, str]], site_name: str) -> str:
    """The candidate with the highest score, the first of equals."""
    best: tuple[float, str] | None = None
    plain = [norm_space(v) for v, _ in candidates]
    for (value, source), v in zip(candidates, plain):
        if not v:
            continue
        if len(v) > 250:
            best = best or (-100.0, truncate(v, 200))
            continue
        score = TITLE_WORTH.get(source, 0.0) - 4 * v.endswith((".", "!")) - 3 * (len(v) > 120)
        if site_name:
            score -= 2.5 * sum(v.endswith(m + site_name) for m in SITE_MARKS) + 0.5 * (site_name.lower() in v.lower())
        score += 1.5 * any(o != value and p.casefold() == v.casefold() for (o, _), p in zip(candidates, plain))
        score += 0.75 * any(len(p.encode()) > len(v.encode()) and p.startswith(v) for p in plain)
        if best is None or score > best[0]:
            best = (score, v)
    return best[1] if best else ""


def best_within(n: Node) -> Node:
    """The innermost container that still holds over three quarters of the text."""
    best, length = n, text_length(n)
    stack = [iter(n.children)] if length else []
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif c.kind == "element" and c.tag in CONTAINERS and is_visible(c):
            size = text_length(c)
            if size > length * 3 // 4 and size > 200:
                best, length = c, size
                stack.append(iter(c.children))
    return best


def semantic(doc: Node, least: int = MIN_SEMANTIC) -> Node | None:
    """Body by what the page declares: microdata, article, main."""
    elements = doc.elements()
    if any("itemprop" in n.attrs or "itemtype" in n.attrs for n in elements):
        marked = [n for n in elements if n.attr("itemprop").lower() in ("articlebody", "text")]
        sizes = [text_length(n) for n in marked]
        if sizes and max(sizes) >= least:
            return marked[sizes.index(max(sizes))]
    articles = [n for n in elements if n.tag == "article"]
    if len(articles) > 1:
        sizes = [text_length(n) for n in articles]
        return articles[sizes.index(max(sizes))] if max(sizes) >= MIN_OF_SEVERAL else None
    for n in [*articles, *(n for n in elements if n.tag == "main"), *(n for n in elements if n.attr("role").lower() == "main")]:
        inner = best_within(n)
        if text_length(inner) >= least:
            return inner
    return None


_POSITIVE = re.compile(r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story")
_NEGATIVE = re.compile(r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget")


def readable(doc: Node, most: int = MAX_ELEMENTS) -> Node | None:
    """Body by paragraph scores: commas and length count for a paragraph's parent, by half for its grandparent; links count against."""
    elements = doc.elements()
    if len(elements) > most:
        return None
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in elements:
        if p.tag not in ("p", "td", "pre") or not is_visible(p) or any(a.tag in ("nav", "footer", "aside", "header", "form") for a in p.ancestors()):
            continue
        text = norm_space(text_of(p))
        if len(text) < 25:
            continue
        worth = 1 + len(re.findall(r"[,،﹐︐︑⹁⸴⸲，]", text)) + min(len(text) // 100, 3)
        for level, a in enumerate(p.ancestors()):
            if level > 4 or a.kind != "element" or a.tag == "html":
                break
            if id(a) not in scores:
                name = f"{a.attr('class')} {a.attr('id')}"
                scores[id(a)] = {"div": 5, "article": 5, "pre": 3, "td": 3, "blockquote": 3}.get(a.tag, -3 if a.tag in ("address", "ol", "ul", "dl", "dd", "dt", "li", "form") else 0)
                scores[id(a)] += 25 * bool(_POSITIVE.search(name)) - 25 * bool(_NEGATIVE.search(name))
                nodes[id(a)] = a
            scores[id(a)] += worth / (1 if level == 0 else 2 if level == 1 else level * 3)
    if not nodes:
        return None
    final = {k: s * (1 - link_share(nodes[k])) for k, s in scores.items()}
    return nodes[max(final, key=lambda k: final[k])]


def link_length(n: Node) -> int:
    """Characters of text inside links."""
    return sum(text_length(a) for a in n.walk(lambda x: x.tag != "a") if a.kind == "element" and a.tag == "a")


def link_share(n: Node) -> float:
    return link_length(n) / max(text_length(n), 1)


def density_score(n: Node) -> float:
    """Text length, less where it is in links, and less without paragraphs."""
    text, links = text_length(n), link_length(n)
    return (text - 0.6 * links) * (1.0 if n.first("p", "pre", "blockquote", "li") not in (None, n) or n.tag in ("p", "pre", "blockquote", "li") else 0.85)


def dense(doc: Node) -> Node | None:
    best, top = None, 0.0
    for n in (doc.first("body") or doc).walk():
        if n.kind == "element" and n.tag in BLOCKS and is_visible(n) and text_length(n) >= 200 and (s := density_score(n)) > top:
            best, top = n, s
    return best_within(best) if best is not None and top >= 200 else None


def extract(source: str, page_url: str = "", prune: bool = True, site: dict | None = None, now: datetime | None = None, min_semantic: int = MIN_SEMANTIC) -> Article:
    """Metadata of a page and, if a strategy finds one, its body; strategy is '' if none does.

    site may have body, strip, item (selectors), strip_id_or_class and prune. Dates over 48 hours after now are left out.
    A declared container counts with min_semantic characters, without the spaces between its blocks.
    """
    doc = parse(source)
    site = site or {}
    base = page_url or "https://invalid.local/"
    if (b := doc.first("base")) and b.attr("href"):
        base = resolve(b.attr("href"), page_url)
    meta, data = read_metadata(doc), read_structured(doc)
    a = Article(url=page_url, lang=(doc.first("html") or Node("element")).attr("lang"))
    a.site_name = first_of(data.get("site_name"), meta.fields.get("site_name"))
    extra = [(data.get("name", ""), "jsonld-name"), (data.get("headline", ""), "jsonld-headline"), (meta.h1, "h1")]
    a.title = pick_title([*meta.titles, *(t for t in extra if t[0])], a.site_name)
    a.byline = first_of(data.get("byline"), meta.fields.get("byline"))
    times = (dates.parse(v) for n in doc.elements("time") for v in (n.attr("datetime"), plain_text(n)) if v)
    a.published = data.get("published") or meta.published or next((t for t in times if t), None)
    a.modified = data.get("modified") or meta.modified
    a.image = first_of(data.get("image"), meta.fields.get("image"))
    a.canonical = resolve(meta.canonical, base) or page_url

    def configured() -> Node | None:
        return next(iter(select_all(doc, site["body"])), None) if site.get("body") else None

    def structured() -> Node | None:
        return fragment(data["body"]) if data.get("body") else None

    strategies = [("siteconfig", configured, MIN_BODY, "body" in site), ("jsonld", structured, MIN_BODY, bool(data.get("body"))), ("semantic", lambda: semantic(doc, min_semantic), min_semantic, True),
                  ("readability", lambda: readable(doc), MIN_BODY, True), ("density", lambda: dense(doc), MIN_BODY, True)]
    node = None
    for name, find, least, asked in strategies:
        if not asked:
            continue
        n = find()
        chars = len(norm_space(data["body"])) if name == "jsonld" else text_length(n)
        ok = n is not None and chars >= least
        reason = "nothing found" if n is None else f"{chars} characters" if ok else f"only {chars} characters, below {least}"
        a.attempts.append({"name": name, "ok": ok, "reason": reason, "chars": chars})
        if ok:
            node, a.strategy = n, name
            break
    if node is None:
        return a
    strips = select_all(doc, [*site.get("strip", []), *site.get("item", [])])
    a.content_html = sanitized(node, Rules(base, site.get("prune", prune), strips, tuple(site.get("strip_id_or_class", ()))))
    a.text_content = plain_text(parse(a.content_html))
    a.word_count = word_count(a.text_content)
    a.excerpt = first_of(meta.fields.get("description"), excerpt(a.text_content, 280))
    a.image = resolve(clean_tracking(a.image), base) if a.image else ""
    if a.published and now and a.published > now + timedelta(hours=48):
        a.published = None
    return a


def looks_scripted(body: str) -> bool:
    """A page that is large but has few paragraphs may be filled in by script; false if it has enough of either."""
    return not (len(body) > 8000 or body.count("</p>") > 3)
