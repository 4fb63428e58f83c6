"""Cleaning of an article's tree for publication."""

import re
from dataclasses import dataclass, field

from . import dates
from .dom import Node, inner_html, is_visible, text_of
from .url import clean_tracking, resolve

# Elements that go with all they hold, and those that may stay.
DROP = frozenset(
    "script style noscript template form button select option textarea svg canvas object embed applet link meta base input label fieldset dialog map area "
    "audio video source track".split()
)
KEEP = frozenset(
    "p br hr div span section article main aside header footer h1 h2 h3 h4 h5 h6 ul ol li dl dt dd strong b em i u s small sub sup mark abbr cite q blockquote "
    "pre code kbd samp var time a img picture source figure figcaption table thead tbody tfoot tr th td caption colgroup col iframe".split()
)
# Words of ids and classes that mark what is no article, whole words between spaces, hyphens and underscores.
JUNK_WORDS = (
    "share sharing social sharedaddy addtoany related recommend recirc promo advert advertisement ad ads adslot adbox sponsor sponsored newsletter signup subscri "
    "cookie consent gdpr paywall comment disqus livefyre sidebar side-bar widget nav navbar menu breadcrumb pagination pager tag-list tagcloud author-box "
    "byline-social meta-share jp-related newsletter-form trending most-popular read-next continue-reading skip-link back-to-top banner header-ad footer-ad "
    "outbrain taboola newsletter-signup login modal overlay lightbox"
).split()
JUNK = re.compile(rf"(?i)(?:^|[\s_-])(?:{'|'.join(map(re.escape, JUNK_WORDS))})(?:[\s_-]|$)")
JUNK_ROLES = frozenset("navigation banner search complementary contentinfo menubar toolbar".split())
# Where lazily loaded images keep their address, in the order tried; marks of images that stand for others.
LAZY = (
    "data-src data-original data-lazy-src data-actualsrc data-hi-res-src data-lazy data-image data-img data-url data-echo data-full-src data-srcset"
).split()
PLACEHOLDERS = ("placeholder", "blank.gif", "spacer.gif", "1x1", "transparent")
# Attributes of looks and behaviour.
LOOKS = frozenset(
    "style class id srcset sizes loading width height align border vspace hspace role aria-hidden target allowfullscreen frameborder fetchpriority decoding "
    "referrerpolicy usemap longdesc".split()
)
EMPTY = frozenset("div span p section ul ol figure figcaption".split())


@dataclass
class Rules:
    base_url: str = ""
    prune: bool = True
    strips: list[Node] = field(default_factory=list)
    strip_classes: tuple[str, ...] = ()


def is_placeholder(src: str) -> bool:
    s = src.strip().lower()
    return not s or s.startswith("data:") or any(p in s for p in PLACEHOLDERS)


def largest_of(srcset: str) -> str:
    """Widest candidate of a srcset, the first of equals; a density counts as thousands."""
    best, widest = "", -1.0
    for part in srcset.split(","):
        words = part.split()
        if words:
            m = re.fullmatch(r"([0-9.]*)[^wx]*([wx])", words[1]) if len(words) > 1 else None
            digits = m.group(1) if m else ""
            width = float(re.match(r"\d*\.?\d*", digits).group() or 0) if digits.strip(".") else 0.0
            width *= 1000 if m and m.group(2) == "x" else 1
            if width > widest:
                best, widest = words[0], width
    return best


def is_junk(n: Node, extra: tuple[str, ...] = ()) -> bool:
    names = f"{n.attr('id')} {' '.join(n.classes)}"
    if not names.strip():
        return False
    return bool(JUNK.search(names)) or any(x and x in names for x in extra) or n.attr("role").lower() in JUNK_ROLES or n.attr("aria-hidden").lower() == "true"


def _prune(n: Node, r: Rules) -> None:
    for c in list(n.children):
        if c.kind == "comment":
            c.remove()
        elif c.kind == "element":
            if c.tag in DROP or is_junk(c, r.strip_classes) or not is_visible(c):
                c.remove()
            elif r.prune and c.tag not in KEEP:
                c.remove() if text_of(c).strip() else c.unwrap()
            else:
                _prune(c, r)


def _image(n: Node, r: Rules) -> None:
    lazy = [(k, v.strip()) for k in LAZY if (v := n.attr(k)) and not is_placeholder(v)]
    sources = [largest_of(v) if k == "data-srcset" else v for k, v in lazy] + [largest_of(n.attr("srcset")), "" if is_placeholder(n.attr("src")) else n.attr("src")]
    src = next((s for s in sources if s), "")
    if not src:
        n.remove()
        return
    n.attrs["src"] = resolve(src, r.base_url)
    n.attrs.setdefault("alt", "")


def _fix(n: Node, r: Rules) -> None:
    if n.kind == "element":
        if n.tag == "img":
            _image(n, r)
        elif n.tag == "a" and (href := n.attr("href")):
            low = href.strip().lower()
            if low.startswith(("javascript:", "data:")):
                children = list(n.children)
                n.unwrap()
                for c in children:
                    _fix(c, r)
                return
            if not low.startswith("#"):
                n.attrs["href"] = resolve(clean_tracking(href), r.base_url)
                n.attrs.setdefault("rel", "noopener noreferrer")
        elif n.tag == "source":
            lazy = [v.strip() for k in LAZY if (v := n.attr(k)).strip() and not is_placeholder(v)]
            if src := next((s for s in [*lazy[:1], largest_of(n.attr("srcset"))] if s), ""):
                n.attrs["src"] = resolve(src, r.base_url)
        elif n.tag == "time" and (t := dates.parse(n.attr("datetime"))):
            n.attrs["datetime"] = dates.iso(t)
        n.attrs = {k: v for k, v in n.attrs.items() if k not in LOOKS and not k.startswith(("on", "data-"))}
    for c in list(n.children):
        _fix(c, r)


def _unwrap_redundant(n: Node) -> None:
    for c in list(n.children):
        inner = [g for g in c.children if g.kind == "element"]
        if c.kind == "element" and c.tag in ("div", "span") and len(inner) == 1 and not text_of(c).strip():
            c.unwrap()
        else:
            _unwrap_redundant(c)


def _drop_empty(n: Node) -> None:
    for c in list(n.children):
        _drop_empty(c)
        if c.kind == "element" and c.tag in EMPTY and not c.children:
            c.remove()


def sanitized(n: Node, r: Rules) -> str:
    """Source of what is left inside a node; the tree is changed."""
    for s in r.strips:
        s.remove()
    _prune(n, r)
    _fix(n, r)
    _unwrap_redundant(n)
    _drop_empty(n)
    return inner_html(n)
