"""Reading the dates that news markup carries.

Times without a date (10:30) are no date here: a year 0 cannot leave a Spark
timestamp for Python. Naive values are UTC.
"""

import re
from datetime import datetime, timedelta, timezone

UTC = timezone.utc
# Month names by number, Indonesian and English, long and short.
MONTHS = {
    1: "januari january jan", 2: "februari february feb", 3: "maret march mar", 4: "april apr", 5: "mei may", 6: "juni june jun",
    7: "juli july jul", 8: "agustus august agu aug", 9: "september sept sep", 10: "oktober october okt oct", 11: "november nov n", 12: "desember december des dec",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}
_ENGLISH = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_ZONE = r"(?P<z>Z|[+-]\d{2}:?\d{2})"
_CLOCK = r"(?P<H>\d{2}):(?P<M>\d{2})"
_NAME = r"(?P<b>[A-Za-z]+)"
# One row a written form; rows are tried in order, so a form that says more comes first and day-first comes before month-first.
_FORMS = [
    re.compile(p + r"\Z")
    for p in (
        rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})T{_CLOCK}:(?P<S>\d{{2}})(?P<f>[.,]\d+)?(?:{_ZONE})?",
        rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}) {_CLOCK}(?::(?P<S>\d{{2}})(?P<f>[.,]\d+)?)?",
        r"(?P<Y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})",
        r"(?P<Y>\d{4})/(?P<m>\d{2})/(?P<d>\d{2})",
        r"(?P<d>\d{2})/(?P<m>\d{2})/(?P<Y>\d{4})",
        r"(?P<m>\d{2})/(?P<d>\d{2})/(?P<Y>\d{4})",
        r"(?P<d>\d{2})-(?P<m>\d{2})-(?P<Y>\d{4})",
        rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})T{_CLOCK}",
        rf"{_CLOCK} (?P<d>\d{{2}}) {_NAME} (?P<Y>\d{{4}})",
        rf"(?P<d>\d{{1,2}}) {_NAME} (?P<Y>\d{{4}})(?: (?P<H>\d{{2}})[:.](?P<M>\d{{2}}))?",
        r"(?P<d>\d{2})(?P<b>[A-Za-z]{3})(?P<Y>\d{4})",
        rf"{_NAME} (?P<d>\d{{1,2}}), (?P<Y>\d{{4}})(?: {_CLOCK})?",
        rf"(?P<d>\d{{2}})\.(?P<m>\d{{2}})\.(?P<Y>\d{{4}})(?: {_CLOCK})?",
        r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
        r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})",
    )
]


def _zone(z: str | None) -> timezone:
    if not z or z == "Z":
        return UTC
    sign = -1 if z[0] == "-" else 1
    return timezone(sign * timedelta(hours=int(z[1:3]), minutes=int(z[-2:])))


def _from_match(g: dict) -> datetime | None:
    month = g.get("m")
    if g.get("b"):
        name = g["b"].lower()
        found = [k for k, m in enumerate(_ENGLISH, 1) if name in (m, m[:3])]
        if not found:
            return None
        month = found[0]
    try:
        micro = int((g.get("f") or ".0")[1:7].ljust(6, "0"))
        return datetime(int(g["Y"]), int(month), int(g["d"]), int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0), micro, _zone(g.get("z"))).astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def _clean(s: str) -> str:
    s = s.strip()
    if s.find("(") > 0:
        s = s[: s.find("(")]
    return re.sub(r"[ \t\n\xa0]+", " ", s).strip()


def _named(s: str) -> datetime | None:
    """Words in any order with a month's name, a day and a year among them; further small numbers are hour and minute."""
    words = [w for w in (f.strip(".,:-") for f in s.split()) if w]
    if len(s.split()) < 3:
        return None
    month = day = year = None
    hour = minute = 0
    for w in words:
        if month is None and w.lower() in MONTH_OF:
            month = MONTH_OF[w.lower()]
        elif re.fullmatch(r"[+-]?[0-9]+", w):
            n = int(w)
            if n >= 1000:
                year = n
            elif 1 <= n <= 31 and day is None:
                day = n
            elif n < 24 and hour == 0 and day is not None:
                hour = n
            elif n < 60:
                minute = n
    if not (month and day and year):
        return None
    try:
        return datetime(year, month, day, max(hour, 0), max(minute, 0), tzinfo=UTC)
    except ValueError:
        return None


def parse(s: str | None) -> datetime | None:
    """Best reading of a date, in UTC, or None."""
    s = _clean(s or "")
    for form in _FORMS:
        m = form.match(s)
        if m and (t := _from_match(m.groupdict())):
            return t
    return _named(s)


def parse_unambiguous(s: str) -> datetime | None:
    """parse(), but None for d/m/y dates that could be m/d/y as well."""
    m = re.fullmatch(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", s.strip())
    return None if m and int(m.group(1)) <= 12 else parse(s)


_ALL_MONTHS = "|".join(sorted({n for names in MONTHS.values() for n in names.split()} - {"n", "agu", "okt", "des"}, key=lambda n: (-len(n), n)))
_IN_TEXT = re.compile(
    rf"(?i)\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?)?|\d{{1,2}}\s+(?:{_ALL_MONTHS})\s+\d{{4}}|(?:{_ALL_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}", re.A
)


def find(text: str | None) -> datetime | None:
    """The first date in prose that can be read."""
    return next((t for m in _IN_TEXT.finditer(text or "") if (t := parse(m.group()))), None)


# Zone names that mail dates may carry, in hours.
_NAMED_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_MAIL = re.compile(r"(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}|\d{2}) (\d{2}):(\d{2})(?::(\d{2}))? ([+-]\d{4}|[A-Z]{1,4})\Z")


def parse_feed_date(s: str | None) -> datetime | None:
    """Mail-style dates, then any other."""
    m = _MAIL.match((s or "").strip())
    if m:
        day, name, year, hour, minute, second, zone = m.groups()
        months = [x[:3].title() for x in _ENGLISH]
        if name in months:
            full = int(year) if len(year) == 4 else int(year) + (1900 if int(year) >= 69 else 2000)
            offset = _zone(zone) if zone[0] in "+-" else timezone(timedelta(hours=_NAMED_ZONES.get(zone, 0)))
            try:
                return datetime(full, months.index(name) + 1, int(day), int(hour), int(minute), int(second or 0), tzinfo=offset).astimezone(UTC)
            except ValueError:
                return None
    return parse(s)


def iso(t: datetime | None) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if t else ""


def rfc1123(t: datetime | None) -> str:
    """Mail-style date, whatever the locale."""
    if t is None:
        return ""
    t = t.astimezone(UTC)
    day = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")[t.weekday()]
    return f"{day}, {t.day:02d} {_ENGLISH[t.month - 1][:3].title()} {t.year:04d} {t:%H:%M:%S} +0000"


def normalize_bound(value: str) -> str:
    """A day as YYYY-MM-DD; '' stays ''. Raises ValueError for what is no day or could be two."""
    value = value.strip()
    if not value:
        return ""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        try:
            datetime.strptime(value, "%Y-%m-%d")
            return value
        except ValueError:
            pass
    t = parse_unambiguous(value)
    if t is None:
        raise ValueError("want YYYY-MM-DD")
    return t.strftime("%Y-%m-%d")
