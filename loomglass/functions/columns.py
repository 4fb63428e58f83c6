"""Column builders that stay in the JVM."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from ..kernels.text import CJK, SPACE
from ..kernels.url import PATH_MONTHS, SUFFIXES, TRACKING_PARAMS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def filled(c: str | Column) -> Column:
    """The value, or null where it is empty or white space."""
    return F.when(F.trim(col(c)) != "", col(c))


def norm_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def truncate(c: str | Column, n: int) -> Column:
    """At most n characters and an ellipsis; n of 0 or less cuts nothing."""
    c = col(c)
    if n <= 0:
        return c
    edge = f"^[{SPACE}]+|[{SPACE}]+$"
    return F.when(F.char_length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), edge, ""), F.lit("…"))).otherwise(c)


def excerpt(c: str | Column, n: int) -> Column:
    return truncate(norm_space(c), n)


def word_count(c: str | Column) -> Column:
    """Words between ASCII white space; a CJK character is a word."""
    return F.regexp_count(col(c), F.lit(f"[{CJK}]|[^ \\t\\n\\r\\f\\x0B{CJK}]+"))


def host(url: str | Column) -> Column:
    """Lower-case host of an absolute URL, null without one."""
    found = F.regexp_extract(col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return filled(F.lower(F.regexp_replace(found, r"[\[\]]", "")))


#: URLs that need no decoding: a lower-case host without user or port, unreserved signs in path, parameters and fragment.
PLAIN_URL = r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)*(/[A-Za-z0-9_.~/-]*)?(\?[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*(&[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*)*)?(#[A-Za-z0-9_.~-]*)?$"
_ORIGIN, _REST = r"^(https?://[^/?#]+)", r"^https?://[^/?#]+"


def is_plain_url(url: str | Column) -> Column:
    """Whether the forms below may be used; null URLs are not plain."""
    return F.coalesce(col(url).rlike(PLAIN_URL), F.lit(False))


def plain_norm(url: str | Column) -> Column:
    """The identity of a plain URL: no fragment, "/" for an empty path, parameters but those for tracking, by name."""
    u = col(url)
    pairs = F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("k"), p.alias("pair")))
    kept = F.transform(F.array_sort(F.filter(pairs, lambda p: (p["pair"] != "") & ~F.lower(p["name"]).isin(*sorted(TRACKING_PARAMS)))), lambda p: p["pair"])
    where = F.regexp_extract(u, _REST + r"([^?#]*)", 1)
    return F.concat(F.regexp_extract(u, _ORIGIN, 1), F.when(where == "", "/").otherwise(where), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def plain_site(url: str | Column) -> Column:
    """The registrable domain of a plain URL's host; addresses and single labels as they are."""
    h = F.regexp_extract(col(url), r"^https?://([^/?#]+)", 1)
    two = F.substring_index(h, ".", -2)
    return F.when(h.rlike(r"^[0-9.]+$"), h).when(two.isin(*sorted(SUFFIXES)), F.substring_index(h, ".", -3)).otherwise(two)


def plain_path_key(url: str | Column) -> Column:
    return F.concat(plain_site(url), F.lower(F.regexp_extract(col(url), _REST + r"([^?#]*)", 1)))


def path(url: str | Column) -> Column:
    """Path of an absolute URL, '' without one."""
    return F.regexp_extract(col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: str | Column) -> Column:
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(trimmed != "", F.split(trimmed, "/")).otherwise(F.array().cast("array<string>"))


def slug(url: str | Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))


def url_pattern(url: str | Column, site: str | Column) -> Column:
    """Site and path shape; null without host or path. Percent escapes are classed as written."""
    parts = segments(url)

    def shape(s: Column, i: Column) -> Column:
        digits = F.char_length(F.regexp_replace(s, "[^0-9]", ""))
        number = s.rlike("^[0-9]+$") | (s.rlike("^[0-9_-]+$") & (digits == 8)) | F.lower(s).isin(*sorted(PATH_MONTHS))
        last = (i == F.size(parts) - 1) & (F.size(parts) >= 2) & s.rlike("[A-Za-z]")
        return F.when(number, "{n}").when(last, "{slug}").otherwise(s)

    return F.when(col(site).isNotNull() & (F.size(parts) > 0), F.concat(col(site), F.lit("/"), F.array_join(F.transform(parts, shape), "/")))


def keep_query_params(url: str | Column, mode: str) -> Column:
    """An absolute URL without fragment and with the parameters that mode names, in their order."""
    c = F.trim(col(url))
    base = F.regexp_extract(c, r"^[^?#]*", 0)
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    wanted = sorted({k.strip() for k in mode.split(",")} - {""})
    name = lambda p: F.regexp_extract(p, "^[^=]*", 0)
    plain = lambda p: F.coalesce(F.try_url_decode(name(p)), name(p))
    if mode.strip() in ("", "1"):
        keep = lambda p: (p != "") & ~F.lower(plain(p)).isin(*sorted(TRACKING_PARAMS))
    elif mode.strip() == "0":
        return base
    else:
        keep = lambda p: (p != "") & (plain(p).isin(*wanted) | name(p).isin(*wanted))
    kept = F.array_join(F.filter(F.split(query, "&"), keep), "&")
    return F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def contains_any(c: str | Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Case folded; blank needles never match; null contains nothing."""
    found = [F.lower(col(c)).contains(n.strip().lower()) for n in needles if n.strip()]
    return F.coalesce(any_of(found), F.lit(False))


def matches_any(c: str | Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(any_of([col(c).rlike(p) for p in patterns]), F.lit(False))


def on_domain(url: str | Column, domains: list[str] | tuple[str, ...]) -> Column:
    """On one of the hosts or below; without host never."""
    h = host(url)
    names = [d.strip().lower() for d in domains if d.strip()]
    return F.coalesce(any_of([(h == d) | h.endswith("." + d) for d in names]), F.lit(False))


def iso(t: str | Column) -> Column:
    return F.date_format(col(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def image_type(url: str | Column) -> Column:
    """Media type by the ending of the path, '' if unknown."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(col(url), r"[?#].*$", ""), r"/[^/]*\.([^./]*)$", 1))
    kinds = {"image/jpeg": ("jpg", "jpeg"), "image/png": ("png",), "image/gif": ("gif",), "image/webp": ("webp",), "image/avif": ("avif",), "image/svg+xml": ("svg",)}
    out = F.when(F.lit(False), F.lit(""))
    for kind, ends in kinds.items():
        out = out.when(ending.isin(*ends), kind)
    return out.otherwise("")


def guid(mode: str, norm_link: str | Column, title: str | Column, entry_title: str | Column, date: str | Column) -> Column:
    """Identity of an entry: its link, a digest of raw title and date, or its title."""
    if mode == "title":
        return col(entry_title)
    if mode == "stable":
        when = F.coalesce(iso(date), F.lit("0001-01-01T00:00:00Z"))
        return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.coalesce(col(title), F.lit("")), F.lit("|"), when).cast("binary"), 256), 1, 20))
    return col(norm_link)


def entry_title(title: str | Column, link: str | Column) -> Column:
    """Title, else readable last path segment, else the link."""
    return F.coalesce(filled(norm_space(title)), filled(F.replace(slug(link), F.lit("-"), F.lit(" "))), col(link))


def conditional_hit(etag: str | Column, modified: str | Column, if_none_match: str | Column, if_modified_since: str | Column) -> Column:
    """Whether a conditional request may be answered by "not modified": tags decide if given, else whole seconds."""
    by_time = F.date_trunc("second", col(modified)) <= col(if_modified_since)
    return F.coalesce(F.when(col(if_none_match).isNotNull(), col(if_none_match) == col(etag)).otherwise(by_time), F.lit(False))


def error_type(message: str | Column) -> Column:
    """Label of an error message, by the first word of a fixed list that it holds."""
    from ..kernels.fetching import ERROR_WORDS

    out = F.when(col(message).isNull(), F.lit("unknown"))
    for word, label in ERROR_WORDS.items():
        out = out.when(F.lower(col(message)).contains(word), label)
    return out.otherwise("other")


def response_status(kind: str | Column, code: str | Column) -> Column:
    """Status that a failed build answers with, by the kind of failure and the source's code."""
    from ..kernels.fetching import BLOCKED_CODES

    c, k = col(code), col(kind)
    by_code = F.when(c.isin(404, 410), 404).when(c == 429, 503).when(c.isin(*BLOCKED_CODES), 403).otherwise(502)
    return F.when(k == "status", by_code).when(k.isin("challenge", "robots", "private"), 403).when(k == "too_large", 502).when(k == "not_configured", 501).otherwise(500)
