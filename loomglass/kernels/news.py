"""Article ids of a news aggregator's links; the exchange over the network is outside the engine."""

import base64
import binascii
import json
import re
from urllib.parse import quote_plus

from .url import absolute_http, parse, query_pairs

# Fixed values of the link format: host, path words before an id, frame bytes, the prefix of ids that carry no link, and names of the exchange.
HOST, PLACES = "news.google.com", ("articles", "read")
FRAME_START, FRAME_END, SIGNED = b"\x08\x13\x22", b"\xd2\x01\x00", "AU_yqL"
RPC, ANSWER = "Fbv4je", "garturlres"


def article_id(raw: str) -> str | None:
    u = parse(raw.strip())
    parts = u.path.strip("/").split("/") if u and u.hostname.lower() == HOST else []
    return parts[-1] if len(parts) >= 2 and parts[-2] in PLACES and parts[-1] else None


def _base64(s: str) -> bytes | None:
    s = s.strip()
    if re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", s) or re.fullmatch(r"[A-Za-z0-9_-]*={0,2}", s):
        bare = s.rstrip("=")
        if ("=" in s and len(s) % 4) or len(bare) % 4 == 1:
            return None
        try:
            return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4))
        except binascii.Error:
            return None
    return None


def decode_legacy(ident: str) -> str | None:
    """The link an older id holds, or None."""
    raw = _base64(ident)
    if raw is None:
        return None
    raw = raw.removeprefix(FRAME_START).removesuffix(FRAME_END)
    if not raw or (raw[0] >= 0x80 and len(raw) < 2):
        return None
    size, skip = ((raw[0] & 0x7F) | raw[1] << 7, 2) if raw[0] >= 0x80 else (raw[0], 1)
    if not 0 < size <= len(raw) - skip:
        return None
    target = raw[skip : skip + size].decode("utf-8", "replace")
    return target if absolute_http(target.strip()) and not target.startswith(SIGNED) else None


def request_body(ident: str, name: str, context: list, timestamp: int | str, signature: str) -> str:
    """Form body that asks for an id's link."""
    inner = json.dumps([name, context, ident, timestamp, signature], separators=(",", ":"))
    return "f.req=" + quote_plus(json.dumps([[[RPC, inner, None, "0"]]], separators=(",", ":")))


def answer(body: str) -> str | None:
    """The link in a response: the first line start from which rows of JSON can be read holds it."""
    for start in (0, *(m.end() for m in re.finditer("\n", body))):
        try:
            rows = json.loads(body[start:])
            break
        except ValueError:
            continue
    else:
        return None
    for row in rows if isinstance(rows, list) else ():
        if isinstance(row, list) and len(row) >= 3 and row[1] == RPC and isinstance(row[2], str):
            try:
                inner = json.loads(row[2])
            except ValueError:
                continue
            if isinstance(inner, list) and len(inner) >= 2 and inner[0] == ANSWER and isinstance(inner[1], str) and absolute_http(inner[1].strip()):
                return inner[1]
    return None


def region_params(link: str) -> dict[str, str]:
    u = parse(link)
    values = dict(reversed(query_pairs(u.query))) if u else {}
    return {k: values[k] for k in ("hl", "gl", "ceid") if values.get(k)}
