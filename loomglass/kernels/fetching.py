"""Judging and decoding of responses; fetching itself is outside the engine."""

import codecs
import ipaddress
import re

# Texts of pages that stand in for a document until a visitor proves to be human.
CHALLENGES = (
    "just a moment", "checking your browser", "cf-browser-verification", "cf_chl_opt", "enable javascript and cookies to continue", "ddos-guard", "data-dome",
    "captcha-delivery", "px-captcha", "perimeterx", "verifying you are human", "请开启javascript", "press and hold", "are you a robot",
    "unusual traffic from your computer", "request unsuccessful. incapsula", "access denied. reference",
)
# Codes of a server that refuses or slows a client down.
BLOCKED_CODES = (403, 405, 406, 418, 429, 503)
MAX_SCAN, SMALL_BODY, MAX_BODY = 96 << 10, 8 << 10, 5 << 20
# Address ranges that no fetch may go to, besides loopback, link-local, multicast and the unspecified.
PRIVATE = [ipaddress.ip_network(n) for n in ("100.64.0.0/10", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "fc00::/7")]
# Error words in the order they decide.
ERROR_WORDS = {
    "robots": "robots", "timeout": "timeout", "blocked": "blocked", "private": "private", "too large": "too_large", "not found": "not_found", "gone": "gone",
    "rate limit": "rate_limit", "unauthorized": "unauthorized", "forbidden": "forbidden", "bad gateway": "bad_gateway", "context canceled": "canceled",
}


def challenge(status: int, content_type: str, body: bytes) -> str:
    """The mark of a challenge page, or ''."""
    if len(body) > MAX_SCAN:
        return ""
    low = body.decode("utf-8", "replace").lower()
    if content_type.partition(";")[0].strip().lower() in ("text/html", "application/xhtml+xml", ""):
        if found := next((m for m in CHALLENGES if m in low), ""):
            return found
    thin = len(body) < SMALL_BODY and "<article" not in low and low.count("<p") <= 2
    return {202: "HTTP 202 Accepted", 204: "HTTP 204 No Content"}.get(status, "") if thin else ""


def is_private(address: str) -> bool:
    """An address that isn't a public one; what is no address counts as private."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_unspecified or ip.is_loopback or ip.is_link_local or ip.is_multicast or any(ip.version == n.version and ip in n for n in PRIVATE)


def error_type(message: str | None) -> str:
    if message is None:
        return "unknown"
    return next((label for word, label in ERROR_WORDS.items() if word in message.lower()), "other")


def declared_charset(content_type: str, body: bytes) -> str:
    """Charset out of the header, else out of the first 4096 bytes."""
    for part in content_type.split(";"):
        if part.strip().startswith("charset="):
            return part.strip()[8:].strip().strip("\"'")
    m = re.search(rb"(?i)charset=[ \t\"']*([^\"' >;\n\t]+)", body[:4096])
    return m.group(1).decode("ascii", "replace") if m else ""


def decode_body(content_type: str | None, body: bytes | None) -> str:
    """Text of a body: by declaration, else UTF-8 if valid, else Windows-1252."""
    body = body or b""
    name = declared_charset(content_type or "", body).strip().lower()
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gbk", "shift_jis": "cp932", "x-sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949"}.get(name, name)
    if name and name not in ("utf-8", "utf8"):
        try:
            return body.decode(codecs.lookup(name).name, "replace")
        except LookupError:
            pass
    if name in ("utf-8", "utf8"):
        return body.decode("utf-8", "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def fnv1a(data: bytes) -> str:
    """Entity tag of a body: its 64-bit FNV-1a hash in quotes."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f'"{h:x}"'
