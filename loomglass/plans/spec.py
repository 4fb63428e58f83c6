"""The query language: a URL query string, checked and turned into a plan, and back into its canonical form."""

import re
from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote_plus

from ..kernels.listing import ListOptions
from ..kernels.url import encode_pairs, parse as parse_url
from ..operators.rules import FieldError, Rules

# Limits of the parameters.
DEFAULT_MAX, MOST_ITEMS, DEFAULT_BODIES = 50, 200, 20
DEFAULT_LIFETIME = 900
FORMATS, GUID_MODES = ("rss", "atom", "json"), ("link", "stable", "title")
# Parameters that may be repeated, and the fields they fill.
LIST_FIELDS = {"item": "item", "item_url": "url", "item_title": "title", "item_date": "date", "item_image": "image", "item_desc": "summary", "remove": "exclude", "strip_css": "strip_css"}
RULE_FIELDS = {"url_contains": "url_contains", "strip_if_url": "url_not_contains", "uri_matches": "uri_matches", "text_contains": "text_contains", "strip_if_text": "text_not_contains", "domain": "domain"}


@dataclass(frozen=True)
class FeedSpec:
    url: str = ""
    feeds: tuple[str, ...] = ()
    format: str = "rss"
    listing: ListOptions = field(default_factory=ListOptions)
    rules: Rules = field(default_factory=Rules)
    title: str = ""
    description: str = ""
    lang: str = ""
    guid: str = "link"
    ttl: int = 0
    summary_chars: int = 0
    fulltext_chars: int = 0
    fulltext: bool = False
    fulltext_max: int = DEFAULT_BODIES
    render_js: bool = False
    fresh: bool = False
    html_cleanup: bool = True
    user_agent: str = ""
    referer: str = ""

    @staticmethod
    def parse(query: str) -> "FeedSpec":
        return parse(query)

    @property
    def max_items(self) -> int:
        return self.listing.max_items

    @property
    def lifetime(self) -> int:
        """Seconds that a built result is good for."""
        return self.ttl * 60 if self.ttl > 0 else DEFAULT_LIFETIME

    def canonical(self) -> str:
        """Query string with what differs from defaults, in order: equal plans have equal ones, so it is the result's key."""
        pairs: list[tuple[str, str]] = [("url", self.url)] * bool(self.url) + [("feeds[]", f) for f in self.feeds]
        for name, f in LIST_FIELDS.items():
            pairs += [(name + "[]", v) for v in getattr(self.listing, f)]
        for name, f in RULE_FIELDS.items():
            pairs += [(name + "[]", v) for v in getattr(self.rules, f)]
        scalars = {
            "format": self.format if self.format != "rss" else "", "max": str(self.max_items) if self.max_items not in (0, DEFAULT_MAX) else "",
            "keep_qs_params": self.listing.keep_query_params, "allow_cross_host": "1" * self.listing.allow_cross_host, "force_host": self.listing.force_host,
            "html_cleanup": "" if self.html_cleanup else "0", "fulltext": "1" * self.fulltext, "fulltext_max": str(self.fulltext_max) if self.fulltext and self.fulltext_max != DEFAULT_BODIES else "",
            "render_js": "1" * self.render_js, "fresh": "1" * self.fresh, "user_agent": self.user_agent, "referer": self.referer, "guid": self.guid if self.guid != "link" else "",
            "ttl": str(self.ttl or ""), "title": self.title, "description": self.description, "lang": self.lang, "summary_chars": str(self.summary_chars or ""),
            "fulltext_chars": str(self.fulltext_chars or ""), "date_after": self.rules.date_after, "date_before": self.rules.date_before,
        }
        return encode_pairs(pairs + [(k, v) for k, v in scalars.items() if v])

    def explain(self) -> list[tuple[str, str]]:
        """(step, what it does) of the plan, without running it."""
        source = [("scan", f"page {self.url}" + (f" by {', '.join(self.listing.item)}" if self.listing.item else " by its repeating links"))] * bool(self.url)
        source += [("scan", f"feed {f}") for f in self.feeds]
        steps = [("unwrap", "click-through links"), ("distinct", "first of each normalised link")]
        steps += [("rule", f"{k}: {v if isinstance(v, str) else ', '.join(v)}") for k, v in vars(self.rules).items() if v and k != "max_items"]
        steps.append(("cap", f"first {self.max_items} in source order"))
        if self.fulltext:
            steps.append(("bodies", f"up to {self.fulltext_max}, cleaned: {self.html_cleanup}"))
        return [*source, *steps, ("sort", "newest first"), ("guid", self.guid), ("render", self.format)]


class _Values:
    """Decoded parameters in order."""

    def __init__(self, query: str):
        self.all: dict[str, list[str]] = {}
        for pair in query.lstrip("?").split("&"):
            name, _, value = pair.partition("=")
            if pair and ";" not in pair and not re.search(r"%(?![0-9A-Fa-f]{2})", pair):
                self.all.setdefault(unquote_plus(name), []).append(unquote_plus(value))

    def one(self, name: str) -> str:
        return self.all.get(name, [""])[0].strip()

    def many(self, name: str) -> tuple[str, ...]:
        """Values of name, name[] and name[n], those with numbers last and by number; blank ones are left out."""
        numbered = [(int(m.group(1)), v) for k, vs in self.all.items() if (m := re.fullmatch(re.escape(name) + r"\[([+-]?\d+)\]", k)) for v in vs]
        found = [*self.all.get(name, []), *self.all.get(name + "[]", []), *(v for _, v in sorted(numbered, key=lambda p: p[0]))]
        return tuple(v.strip() for v in found if v.strip())

    def true(self, name: str) -> bool:
        return self.one(name).lower() not in ("", "0", "false", "no", "off")

    def number(self, name: str, default: int, low: int, high: int) -> int:
        raw = self.one(name)
        if not raw:
            return default
        if not re.fullmatch(r"[+-]?\d+", raw):
            raise FieldError(name, raw, "want a whole number")
        if not low <= int(raw) <= high:
            raise FieldError(name, raw, f"want between {low} and {high}")
        return int(raw)


def _checked_url(field_name: str, raw: str) -> str:
    u = parse_url(raw)
    if u is None:
        raise FieldError(field_name, raw, "not a valid URL")
    if u.scheme not in ("http", "https"):
        raise FieldError(field_name, raw, "want an http or https URL")
    if not u.host:
        raise FieldError(field_name, raw, "no host")
    return raw


def _checked_host(raw: str) -> str:
    if raw and (re.search(r"[/\\ \t]", raw) or (u := parse_url("https://" + raw)) is None or u.host != raw or u.path or u.query or u.fragment or not u.hostname):
        raise FieldError("force_host", raw, "want a bare host, such as www.example.com")
    return raw


def id_or_class(value: str) -> str:
    """A selector for a bare id (digits) or class; what looks like a selector is one."""
    return value if re.search(r"[ .#\[\]>:+~]", value) else ("#" if re.fullmatch(r"\d+", value) else ".") + value


def parse(query: str) -> FeedSpec:
    """The plan of a query string. Raises FieldError naming the parameter."""
    v = _Values(query)
    kind = v.one("format").lower() or "rss"
    if kind not in FORMATS:
        raise FieldError("format", kind, "want one of rss, atom, json")
    url = _checked_url("url", v.one("url")) if v.one("url") else ""
    feeds = tuple(_checked_url("feeds", f) for f in (*v.many("feeds"), *v.many("feed")))
    if not url and not feeds:
        raise FieldError("url", "", "required: a page, or one or more feeds")
    options = ListOptions(
        base_url=url, keep_query_params=v.one("keep_qs_params"), allow_cross_host=v.true("allow_cross_host"), force_host=_checked_host(v.one("force_host")),
        **{f: v.many(name) for name, f in LIST_FIELDS.items()},
    )
    if short := v.one("id_or_class"):
        if options.item:
            raise FieldError("id_or_class", short, "cannot be combined with item")
        options = replace(options, item=(id_or_class(short),))
    rules = Rules(date_after=v.one("date_after"), date_before=v.one("date_before"), **{f: v.many(name) for name, f in RULE_FIELDS.items()})
    days = Rules(date_after=rules.date_after, date_before=rules.date_before).checked()
    rules = replace(rules, date_after=days.date_after, date_before=days.date_before)
    most = v.number("max", DEFAULT_MAX, 1, MOST_ITEMS)
    ttl = v.number("ttl", 0, 0, 10080)
    guid = v.one("guid").lower() or "link"
    if guid not in GUID_MODES:
        raise FieldError("guid", guid, "want one of link, stable, title")
    summary, full = v.number("summary_chars", 0, 0, 20000), v.number("fulltext_chars", 0, 0, 2_000_000)
    bodies = v.number("fulltext_max", DEFAULT_BODIES, 1, MOST_ITEMS)
    if v.true("fulltext"):
        most = min(most, bodies)
    keep = options.keep_query_params
    if keep not in ("", "0", "1") and re.search("[= ]", keep):
        raise FieldError("keep_qs_params", keep, "want 0, 1, or a comma-separated list of names")
    return FeedSpec(
        url, feeds, kind, replace(options, max_items=most), rules, v.one("title"), v.one("description"), v.one("lang"), guid, ttl, summary, full, v.true("fulltext"), bodies,
        v.true("render_js"), v.true("fresh"), "html_cleanup" not in v.all or v.true("html_cleanup"), v.one("user_agent"), v.one("referer"),
    )


def self_link(scheme: str, host: str, path: str, spec: FeedSpec) -> str:
    """The address under which a result is served."""
    return f"{scheme.partition(',')[0].strip()}://{host}{quote(path)}?{spec.canonical()}"


def source_of(key: str) -> str:
    """The page or first feed that a result's key names."""
    v = _Values(key.rpartition("?")[2])
    return v.one("url") or next(iter(v.many("feeds")), "")
