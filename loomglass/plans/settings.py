"""Settings of an installation: YAML over defaults."""

import re
from dataclasses import dataclass, fields, replace

import yaml

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)")


def seconds(text: str | int) -> float:
    """A duration such as 1h30m or 250ms; a bare number counts nanoseconds. Raises ValueError."""
    raw = str(text).strip()
    sign, body = (-1, raw[1:]) if raw[:1] == "-" else (1, raw.removeprefix("+"))
    if re.fullmatch(r"[0-9]+", body):
        return sign * int(body) * 1e-9
    if not body or "".join(m.group(0) for m in _PART.finditer(body)) != body:
        raise ValueError(f"not a duration: {raw!r}")
    return sign * sum(float(n) * _UNITS[u] for n, u in _PART.findall(body))


@dataclass(frozen=True)
class Settings:
    # The defaults.
    db_path: str = "loomglass.db"
    site_dir: str = "configs/sites"
    user_agent: str = "loomglass/0.1"
    timeout: float = 20.0
    max_body_bytes: int = 5 << 20
    global_concurrency: int = 8
    per_host_interval: float = 1.0
    respect_robots: bool = True
    allow_private: bool = False
    cache_ttl: float = 86400.0
    max_elements: int = 100_000
    render_url: str = ""
    render_timeout: float = 30.0


def load(source: str | None) -> Settings:
    """Settings of a YAML text over the defaults. Unknown names are ignored, null leaves a default; a body limit or a number
    of requests that is not positive is the default again. Raises ValueError for what is no mapping or of another type."""
    try:
        values = yaml.safe_load(source or "") or {}
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None
    if not isinstance(values, dict):
        raise ValueError("settings are no mapping")
    out = Settings()
    for f in fields(Settings):
        v = values.get(f.name)
        if v is None:
            continue
        if f.type in (bool, int) and (isinstance(v, bool) != (f.type is bool) or not isinstance(v, f.type)):
            raise ValueError(f"{f.name}: want {f.type.__name__}")
        out = replace(out, **{f.name: seconds(v) if f.type is float else v if f.type is not str else str(v)})
    for name in ("max_body_bytes", "global_concurrency"):
        if getattr(out, name) <= 0:
            out = replace(out, **{name: getattr(Settings(), name)})
    return out
