"""URL algebra: parsing, the identity form, query filters, sites and path shapes.

A URL that cannot be parsed never raises: every function has a defined value
for it, stated in its docstring.
"""

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import quote, unquote, unquote_plus, urljoin

# Query parameters that mark a campaign or a click, not a document.
TRACKING_PARAMS = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_brand utm_social utm_social-type "
    "fbclid gclid dclid msclkid twclid igshid mc_cid mc_eid yclid _ga ref_src ref_url spm cmpid ncid smid sr_share __twitter_impression".split()
)
# Month names that a path segment may be (English short, Indonesian long).
PATH_MONTHS = frozenset(
    "jan feb mar apr may jun jul aug sep oct nov dec januari februari maret mei juni juli agustus september oktober november desember".split()
)
# Public suffixes of more than one label that the registrable domain is taken above.
# Other suffixes are taken to be one label long.
SUFFIXES = frozenset(
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk sch.uk ac.uk gov.uk nhs.uk police.uk co.id or.id go.id ac.id sch.id web.id my.id net.id mil.id desa.id biz.id "
    "com.au net.au org.au edu.au gov.au id.au asn.au co.nz org.nz net.nz govt.nz ac.nz co.jp or.jp ne.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp "
    "com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn ac.cn com.tw org.tw net.tw gov.tw edu.tw com.hk org.hk net.hk gov.hk edu.hk "
    "com.sg org.sg net.sg gov.sg edu.sg com.my org.my net.my gov.my edu.my co.th or.th ac.th go.th in.th co.in net.in org.in gov.in ac.in firm.in gen.in ind.in "
    "co.kr or.kr ne.kr go.kr ac.kr re.kr co.za org.za net.za gov.za ac.za com.mx org.mx net.mx gob.mx edu.mx com.ar org.ar net.ar gob.ar edu.ar "
    "com.tr org.tr net.tr gov.tr edu.tr com.ua org.ua net.ua gov.ua edu.ua com.ph org.ph net.ph gov.ph edu.ph com.vn net.vn org.vn gov.vn edu.vn "
    "com.pk org.pk net.pk gov.pk edu.pk com.bd org.bd net.bd gov.bd co.il org.il net.il gov.il ac.il com.eg com.sa com.ng com.gh co.ke or.ke go.ke "
    "com.pe com.co net.co org.co com.ve com.ec com.uy com.py com.bo com.gt com.do com.pl net.pl org.pl com.pt com.gr com.cy com.mt com.ro co.at or.at ac.at gv.at "
    "github.io gitlab.io blogspot.com appspot.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com cloudfront.net".split()
)

_SHAPE = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_PLAIN_PATH = re.compile(r"^(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]]|%[0-9A-Fa-f]{2})*$")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_PATH_SAFE = "!$&'()*+,;=:@/-._~[]"
_SPACE = " \t\n\v\f\r\x85\xa0"


@dataclass(frozen=True)
class Url:
    scheme: str = ""
    host: str = ""  # with port, and user information before it
    path: str = ""  # as written
    query: str = ""
    fragment: str = ""
    rooted: bool = False  # the text had an authority, if perhaps an empty one

    def __str__(self) -> str:
        out = f"{self.scheme}:" if self.scheme else ""
        if self.host or (self.rooted and (self.scheme or self.path.startswith("//"))):
            out += "//" + self.host
        path = escaped_path(self.path)
        if self.host and path and not path.startswith("/"):
            path = "/" + path
        out += path
        if self.query:
            out += "?" + self.query
        if self.fragment:
            out += "#" + quote(unquote(self.fragment), safe="!$&'()*+,;=:@/?-._~")
        return out

    @property
    def hostname(self) -> str:
        """Host without user, port and brackets."""
        h = self.host.rpartition("@")[2]
        if h.startswith("["):
            return h[1:].partition("]")[0]
        return h.partition(":")[0]

    @property
    def port(self) -> str:
        h = self.host.rpartition("@")[2].rpartition("]")[2] if "[" in self.host else self.host.rpartition("@")[2]
        return h.partition(":")[2]


def escaped_path(path: str) -> str:
    """A path as it stands in a URL: as written if it is well-formed, else re-encoded."""
    return path if _PLAIN_PATH.match(path) else quote(unquote(path, errors="surrogateescape").encode("utf-8", "surrogateescape"), safe=_PATH_SAFE)


@lru_cache(1 << 14)
def parse(raw: str) -> Url | None:
    """The parts of a URL reference, or None where it isn't one (control characters, broken escapes, bad host or port)."""
    if _CONTROL.search(raw):
        return None
    m = _SHAPE.match(raw)
    if m is None:
        return None
    scheme, host, path, query, fragment = m.groups()
    if scheme is None and host is None and ":" in path.partition("/")[0]:
        return None  # a first segment with a colon, or a missing scheme
    if _BAD_ESCAPE.search(path) or (fragment and _BAD_ESCAPE.search(fragment)):
        return None
    if scheme and host is None and path and not path.startswith("/"):
        return Url(scheme.lower(), "", path, query or "", fragment or "")  # opaque, such as mailto:
    host = host or ""
    name = host.rpartition("@")[2]
    if re.search(r"[ \"<>\\^`{|}]", name) or _BAD_ESCAPE.search(name):
        return None
    port = re.search(r"\]?:([^\]]*)$", name)
    if port and not re.fullmatch(r"[0-9]*", port.group(1)):
        return None
    return Url((scheme or "").lower(), host, path, query or "", fragment or "", m.group(2) is not None)


def query_pairs(query: str) -> list[tuple[str, str]]:
    """Decoded (name, value) pairs in order; pairs with a semicolon or a broken escape are no pairs."""
    out = []
    for pair in query.split("&"):
        if not pair or ";" in pair:
            continue
        name, _, value = pair.partition("=")
        if _BAD_ESCAPE.search(name) or _BAD_ESCAPE.search(value):
            continue
        out.append((unquote_plus(name), unquote_plus(value)))
    return out


def encode_pairs(pairs: list[tuple[str, str]]) -> str:
    """Query string with names in order; values of one name keep theirs."""
    form = lambda s: quote(s, safe="-_.~").replace("%20", "+")
    return "&".join(f"{form(k)}={form(v)}" for k, v in sorted(pairs, key=lambda p: p[0].encode()))


def normalize(raw: str) -> str:
    """The identity of a document: lower-case scheme and host, no default port, fragment or tracking parameters,
    parameters in order, "/" for an empty path. What isn't a URL is its own identity; '' gives '/'."""
    u = parse(raw.strip(_SPACE))
    if u is None:
        return raw
    host = u.host
    for scheme, port in (("http", "80"), ("https", "443")):
        if u.scheme == scheme and u.port == port:
            host = host.removesuffix(":" + port)
    query = encode_pairs([p for p in query_pairs(u.query) if p[0].lower() not in TRACKING_PARAMS]) if u.query else ""
    return str(replace(u, host=host.lower(), query=query, fragment="", path=u.path or ("" if u.scheme and not u.rooted else "/")))


def resolve(href: str, base: str) -> str:
    """An absolute URL for a reference in a document; '' stays '', what can't be resolved stays as it is."""
    href = href.strip(_SPACE)
    if not href:
        return ""
    if href.startswith("//"):
        return ("https:" if base.startswith("https:") else "http:") + href
    if "://" in href or not base:
        return href
    if parse(base) is None or parse(href) is None:
        return href
    joined = parse(urljoin(base, href))
    return str(joined) if joined else href


def set_host(raw: str, host: str) -> str:
    """The URL with another authority; unchanged if it has none or the host is empty."""
    u = parse(raw.strip(_SPACE))
    host = host.strip(_SPACE)
    return str(replace(u, host=host)) if host and u and u.host else raw


def keep_query_params(raw: str, mode: str) -> str:
    """The URL without fragment and with the parameters that mode names: '' or '1' all but tracking, '0' none, else a list."""
    u = parse(raw.strip(_SPACE))
    if u is None:
        return raw
    mode = mode.strip(_SPACE)
    wanted = {k.strip(_SPACE) for k in mode.split(",")} - {""}

    def keeps(pair: str) -> bool:
        name = pair.partition("=")[0]
        plain = name if _BAD_ESCAPE.search(name) else unquote_plus(name)
        return plain.lower() not in TRACKING_PARAMS if mode in ("", "1") else bool({plain, name} & wanted)

    pairs = [] if mode == "0" else [p for p in u.query.split("&") if p and keeps(p)]
    return str(replace(u, query="&".join(pairs), fragment=""))


def clean_tracking(href: str) -> str:
    """Text-level form of the same for links in article bodies: cut the fragment and tracking parameters, change nothing else."""
    base, mark, query = href.partition("#")[0].partition("?")
    kept = [p for p in query.split("&") if p and p.partition("=")[0].lower() not in TRACKING_PARAMS]
    return f"{base}?{'&'.join(kept)}" if mark and kept else base


def registrable_domain(host: str) -> str:
    """The domain that can be registered above a host; addresses and single labels are returned as they are."""
    host = host.strip(_SPACE).removesuffix(".").lower()
    labels = host.split(".")
    if len(labels) < 2 or re.fullmatch(r"[0-9.]+", host) or ":" in host or "" in labels:
        return host
    known = 2 if ".".join(labels[-2:]) in SUFFIXES else 1
    return ".".join(labels[-known - 1 :])


def hostname(raw: str) -> str:
    """Lower-case host of a URL or of a bare authority; '' if none can be read."""
    raw = raw.strip(_SPACE)
    u = parse(raw)
    if u and u.host:
        return u.hostname.lower()
    if not raw or re.search(r"[/?#\s]", raw) or (u and u.scheme and not re.fullmatch(r"[0-9]*", u.path)):
        return ""
    bare = parse("//" + raw)
    return bare.hostname.lower() if bare and "." in bare.hostname or bare and bare.hostname == "localhost" else ""


def site(raw: str) -> str:
    u = parse(raw.strip(_SPACE))
    return registrable_domain(u.hostname) if u and u.host else ""


def listing_site(raw: str) -> str:
    """Site for grouping a catalogue: '' for '', the text itself where no host can be read."""
    u = parse(raw)
    if not raw or u is None or not u.hostname:
        return raw
    return registrable_domain(u.hostname)


def same_site(a: str, b: str) -> bool:
    x, y = hostname(a), hostname(b)
    return bool(x and x == y) or bool(site(b) and site(a) == site(b))


def path_key(raw: str) -> str:
    """Site and lower-case path: two links to a page that differ in their query have one key."""
    u = parse(raw.strip(_SPACE))
    if u is None or not u.host:
        return raw.strip(_SPACE).lower()
    return registrable_domain(u.hostname) + escaped_path(u.path).lower()


def segments(path: str) -> list[str]:
    path = path.strip("/")
    return path.split("/") if path else []


def slug(raw: str) -> str:
    """Last path segment, or ''."""
    u = parse(raw)
    parts = segments(unquote(u.path)) if u else []
    return parts[-1] if parts else ""


def segment_class(segment: str, last: bool, depth: int) -> str:
    """A path segment or the placeholder for its kind."""
    if re.fullmatch(r"[0-9]+", segment) or (re.fullmatch(r"[0-9_/-]+", segment) and sum(c.isdigit() for c in segment) == 8) or segment.lower() in PATH_MONTHS:
        return "{n}"
    return "{slug}" if last and depth >= 2 and re.search(r"[A-Za-z]", segment) else segment


def pattern(raw: str) -> tuple[str, str, int] | None:
    """(site and path shape, host, depth) of a URL, None if it has no host or path."""
    u = parse(raw.strip(_SPACE))
    parts = segments(unquote(u.path)) if u and u.host else []
    if not parts:
        return None
    shape = "/".join(segment_class(p, k == len(parts) - 1, len(parts)) for k, p in enumerate(parts))
    return f"{registrable_domain(u.hostname)}/{shape}", u.hostname.lower(), len(parts)


def group_patterns(urls: list[str]) -> list[dict]:
    """Shapes of a page's links, most frequent first; then deeper, then by text."""
    groups: dict[str, dict] = {}
    for raw in urls:
        p = pattern(raw)
        if p:
            g = groups.setdefault(p[0], {"pattern": p[0], "host": p[1], "depth": p[2], "count": 0, "slugs": []})
            g["count"] += 1
            g["slugs"] += [s] if (s := slug(raw)) else []
    return sorted(groups.values(), key=lambda g: (-g["count"], -g["depth"], g["pattern"]))


# Click-through forms, as a label of the host, the path (exact or as an ending) and the parameters that hold the target.
WRAPPERS = (("google", "/url", True, ("url", "q")), ("bing", "/apiclick.aspx", False, ("url",)))
UNWRAP_DEPTH = 4


def _wrapper(u: Url | None):
    labels = u.hostname.lower().split(".") if u and u.host else []
    for label, path, exact, params in WRAPPERS:
        if label in labels and (unquote(u.path) == path if exact else unquote(u.path).endswith(path)):
            return params
    return None


def absolute_http(raw: str) -> bool:
    u = parse(raw)
    return bool(u and u.host and u.scheme in ("http", "https"))


def unwrap(raw: str) -> tuple[str, bool]:
    """(target, True) of a click-through link whose layers end outside a wrapper, else (the link, False)."""
    start = link = raw.strip(_SPACE)
    for _ in range(UNWRAP_DEPTH):
        u = parse(link)
        params = _wrapper(u)
        values = dict(reversed(query_pairs(u.query))) if params else {}
        targets = [t for p in params or () if (t := values.get(p, "").strip(_SPACE)) and absolute_http(t) and t != link]
        if not targets:
            break
        link = targets[0]
    return (start, False) if link == start or _wrapper(parse(link)) else (link, True)


def fetch_key(raw: str) -> str:
    """Cache key of a request: lower-case scheme and host, no fragment, "/" for an empty path; the query is kept."""
    u = parse(raw)
    return str(replace(u, host=u.host.lower(), fragment="", path=u.path or "/")) if u else raw
