"""Plain-text helpers."""

import re

# White space as Unicode defines it, and the ranges of characters that count as a word each.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = "\u4e00-\u9fff\u3400-\u4dbf\u3040-\u30ff\uac00-\ud7af"
_SPACES = re.compile(f"[{SPACE}]+")
_WORDS = re.compile(f"[{CJK}]|[^ \t\n\r\f\v{CJK}]+")
EDGE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def norm_space(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


def truncate(s: str, n: int) -> str:
    """At most n characters of content, then an ellipsis; n of 0 or less cuts nothing."""
    return s if n <= 0 or len(s) <= n else s[:n].strip(EDGE) + "…"


def excerpt(s: str, n: int) -> str:
    return truncate(norm_space(s), n)


def word_count(s: str) -> int:
    return len(_WORDS.findall(s))


def first_of(*values: str | None) -> str:
    """First value that is more than white space, stripped."""
    return next((v.strip(EDGE) for v in values if v and v.strip(EDGE)), "")


def shorten_url(s: str, most: int) -> str:
    """A URL for display: no scheme, its middle cut out; lengths are bytes."""
    b = s.removeprefix("https://").removeprefix("http://").encode()
    head = most * 2 // 5
    tail = most - head - 1
    if len(b) <= most:
        return b.decode()
    if head < 1 or tail < 1:
        return b[:most].decode(errors="replace")
    return b[:head].decode(errors="replace") + "…" + b[-tail:].decode(errors="replace")


def plural(n: int) -> str:
    return "" if n == 1 else "s"


def status_snippet(body: bytes) -> str:
    """First line of an error body in one short line."""
    line = re.split(r"[\r\n]", body.decode("utf-8", "replace").strip(EDGE))[0]
    raw = norm_space(line).encode()
    return raw.decode() if len(raw) <= 120 else raw[:120].decode("utf-8", "ignore").strip(EDGE) + "…"


def human_bytes(n: int) -> str:
    return f"{n / (1 << 20):.1f} MB" if n >= 1 << 20 else f"{n / 1024:.1f} KB" if n >= 1024 else f"{n} bytes"


def ago(seconds: int | None) -> str:
    """How long ago, for display; older than 30 days is left to the date itself."""
    if seconds is None:
        return "—"
    for limit, unit, name in ((60, 0, "just now"), (3600, 60, "m ago"), (86400, 3600, "h ago"), (30 * 86400, 86400, "d ago")):
        if seconds < limit:
            return f"{seconds // unit}{name}" if unit else name
    return ""
