"""The rule engine: why an item is dropped, and what is left."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of, contains_any, filled, matches_any, on_domain
from ..kernels.dates import normalize_bound


class FieldError(ValueError):
    """A parameter that can't be used; field names it."""

    def __init__(self, field: str, value: str, message: str):
        super().__init__(f"{field}: {value!r}: {message}" if value else f"{field}: {message}")
        self.field, self.value = field, value


@dataclass(frozen=True)
class Rules:
    url_contains: tuple[str, ...] = ()
    url_not_contains: tuple[str, ...] = ()
    uri_matches: tuple[str, ...] = ()
    text_contains: tuple[str, ...] = ()
    text_not_contains: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    date_after: str = ""
    date_before: str = ""
    max_items: int = 0

    def checked(self) -> "Rules":
        """The rules with day bounds in one form. Raises FieldError for bad patterns or bounds."""
        for p in self.uri_matches:
            check_pattern(p)
        days = {}
        for name in ("date_after", "date_before"):
            try:
                days[name] = normalize_bound(getattr(self, name))
            except ValueError as e:
                raise FieldError(name, getattr(self, name), str(e)) from None
        return Rules(**{**vars(self), **days})


def check_pattern(p: str) -> None:
    """Patterns must mean the same in engines with and without backtracking: no look-around, no back-references."""
    try:
        re.compile(p)
    except re.error as e:
        raise FieldError("uri_matches", p, str(e)) from None
    if re.search(r"\(\?(?:<?[=!]|>)|\\[1-9]|\(\?P=|[*+?}]\+", p):
        raise FieldError("uri_matches", p, "look-around, back-references and possessive forms are not supported")


def tests(rules: Rules, link: str = "link", title: str = "title", summary: str = "summary", date: str = "date") -> list[tuple[str, Column]]:
    """(reason, whether it drops) in the order that decides."""
    r = rules.checked()
    text = F.concat_ws("\n", filled(title), filled(summary), filled(link))
    has_text = text != ""
    out: list[tuple[str, Column]] = []
    if r.url_contains:
        out.append(("url_contains", ~contains_any(link, r.url_contains)))
    if r.url_not_contains:
        out.append(("url_not_contains", contains_any(link, r.url_not_contains)))
    if r.uri_matches:
        out.append(("uri_matches", ~matches_any(link, r.uri_matches)))
    if r.text_contains:
        out.append(("text_contains", has_text & ~contains_any(text, r.text_contains)))
    if r.text_not_contains:
        out.append(("text_not_contains", has_text & contains_any(text, r.text_not_contains)))
    if r.domain:
        out.append(("domain", ~on_domain(link, r.domain)))
    if r.date_after or r.date_before:
        day = F.date_format(date, "yyyy-MM-dd")
        outside = [day < r.date_after] * bool(r.date_after) + [day > r.date_before] * bool(r.date_before)
        out.append(("date", F.col(date).isNull() | any_of(outside)))
    return out


def with_reason(items: DataFrame, rules: Rules, **names: str) -> DataFrame:
    """Adds drop_reason: the first rule that drops the item, null for those that stay."""
    return items.withColumn("drop_reason", F.coalesce(F.lit(None).cast("string"), *(F.when(test, reason) for reason, test in tests(rules, **names))))


def survivors(items: DataFrame, rules: Rules, **names: str) -> DataFrame:
    return with_reason(items, rules, **names).where("drop_reason is null").drop("drop_reason")


def drop_counts(items: DataFrame, rules: Rules, **names: str) -> DataFrame:
    """Items dropped by each reason."""
    return with_reason(items, rules, **names).where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("dropped"))
