"""Selectors over kernels.dom: a subset of CSS, and XPath after "xpath:".

CSS: tags, *, #id, .class, [attr], [attr=v] and the ~ | ^ $ * operators,
:first-child, :last-child, :nth-child(n|odd|even), :not(simple), the
combinators and commas. XPath: steps of / and //, tags or *, predicates with
@attr tests, contains(), starts-with(), not(), and/or, text() and numbers.
What doesn't parse matches nothing, so one bad entry doesn't spoil a list.
"""

import re
from collections.abc import Callable
from functools import lru_cache

from ..kernels.dom import Node, norm_space, plain_text, text_of
from .url import resolve

XPATH = "xpath:"
Test = Callable[[Node], bool]


class BadSelector(ValueError):
    pass


_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\.(?P<cls>(?:[\w-]|[^\x00-\x7f]|\\.)+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*(?P<flag>[iI])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"
)


def _unquote(v: str) -> str:
    return v[1:-1] if v[:1] in "\"'" else v


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    tests = {
        None: lambda v: True, "=": lambda v: v == value, "~=": lambda v: bool(value) and value in v.split(), "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value), "$=": lambda v: bool(value) and v.endswith(value), "*=": lambda v: bool(value) and value in v, "!=": lambda v: v != value,
    }
    if op == "!=":
        return lambda n: n.attr(name) != value
    test = tests[op]
    if fold:
        value = value.lower()
        return lambda n: name in n.attrs and test(n.attrs[name].lower())
    return lambda n: name in n.attrs and test(n.attrs[name])


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.kind == "element"] if n.parent else [n]


def _place(n: Node) -> int:
    return next(k for k, c in enumerate(_siblings(n), 1) if c is n)


def _pseudo(name: str, arg: str | None) -> Test:
    if name == "first-child":
        return lambda n: _siblings(n)[0] is n
    if name == "last-child":
        return lambda n: _siblings(n)[-1] is n
    if name == "only-child":
        return lambda n: len(_siblings(n)) == 1
    if name == "empty":
        return lambda n: not any(c.kind != "comment" for c in n.children)
    if name == "first-of-type":
        return lambda n: next(c for c in _siblings(n) if c.tag == n.tag) is n
    if name == "last-of-type":
        return lambda n: [c for c in _siblings(n) if c.tag == n.tag][-1] is n
    if name == "nth-child" and arg:
        text = arg.strip().lower().replace(" ", "")
        m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", {"odd": "2n+1", "even": "2n"}.get(text, text))
        if not m or not text:
            raise BadSelector(arg)
        a = 0 if m.group(1) is None else int(m.group(1) + "1" if m.group(1) in ("", "+", "-") else m.group(1))
        b = int(m.group(2) or 0)
        return lambda n: (_place(n) - b) % a == 0 and (_place(n) - b) // a >= 0 if a else _place(n) == b
    if name in ("not", "is", "has", "contains") and arg is not None:
        if name == "contains":
            return lambda n: _unquote(arg.strip()) in text_of(n)
        inner = css(arg)
        if name == "has":
            return lambda n: any(inner(x) for x in n.elements() if x is not n)
        return (lambda n: not inner(n)) if name == "not" else inner
    raise BadSelector(name)


def _compound(s: str, at: int) -> tuple[Test, int]:
    tests: list[Test] = []
    start = at
    while m := _SIMPLE.match(s, at):
        g = m.groupdict()
        if g["tag"]:
            if at != start:
                raise BadSelector(s)
            if g["tag"] != "*":
                tests.append(lambda n, t=g["tag"].lower(): n.tag == t)
        elif g["id"]:
            tests.append(lambda n, v=g["id"].replace("\\", ""): n.attr("id") == v)
        elif g["cls"]:
            tests.append(lambda n, v=g["cls"].replace("\\", ""): v in n.classes)
        elif g["attr"]:
            tests.append(_attribute(g["attr"], g["op"], _unquote(g["val"] or ""), bool(g["flag"])))
        else:
            tests.append(_pseudo(g["pseudo"], g["arg"]))
        at = m.end()
    if at == start:
        raise BadSelector(s)
    return (lambda n: n.kind == "element" and all(t(n) for t in tests)), at


def _linked(left: Test, how: str, right: Test) -> Test:
    def test(n: Node) -> bool:
        if not right(n):
            return False
        if how == " ":
            return any(left(a) for a in n.ancestors())
        if how == ">":
            return n.parent is not None and left(n.parent)
        own = _siblings(n)
        before = own[: next(k for k, c in enumerate(own) if c is n)]
        return bool(before) and left(before[-1]) if how == "+" else any(left(b) for b in before)

    return test


@lru_cache(1 << 10)
def css(selector: str) -> Test:
    """Test of an element against a selector list. Raises BadSelector."""
    groups, at, s = [], 0, selector.strip()
    test, at = _compound(s, 0)
    while at < len(s):
        m = re.compile(r"\s*([>+~,])\s*|\s+").match(s, at)
        if not m:
            raise BadSelector(selector)
        at = m.end()
        nxt, at = _compound(s, at)
        if m.group(1) == ",":
            groups.append(test)
            test = nxt
        else:
            test = _linked(test, m.group(1) or " ", nxt)
    groups.append(test)
    return groups[0] if len(groups) == 1 else lambda n: any(t(n) for t in groups)


_STEP = re.compile(r"(//|/)?(?:(descendant-or-self|descendant|child|following-sibling|parent|ancestor|self)::)?(\.\.|\.|\*|@?[\w:-]+(?:\(\))?)")


def _predicate(text: str) -> Callable[[Node, int, int], bool]:
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return lambda n, k, size: k == int(text)
    if text == "last()":
        return lambda n, k, size: k == size
    for word, join in ((" or ", any), (" and ", all)):
        parts = _split(text, word)
        if len(parts) > 1:
            tests = [_predicate(p) for p in parts]
            return lambda n, k, size: join(t(n, k, size) for t in tests)
    if m := re.fullmatch(r"not\((.*)\)", text, re.S):
        inner = _predicate(m.group(1))
        return lambda n, k, size: not inner(n, k, size)
    value = r"(@[\w:-]+|text\(\)|\.|normalize-space\((?:\.|text\(\)|@[\w:-]+)?\))"
    if m := re.fullmatch(rf"(contains|starts-with)\(\s*{value}\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)", text):
        get, want = _value(m.group(2)), _unquote(m.group(3))
        return (lambda n, k, size: want in get(n)) if m.group(1) == "contains" else (lambda n, k, size: get(n).startswith(want))
    if m := re.fullmatch(r"contains\(\s*concat\(\s*(\"\s\"|'\s')\s*,\s*(?:normalize-space\()?@class\)?\s*,\s*(\"\s\"|'\s')\s*\)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)", text):
        token = _unquote(m.group(3))
        return lambda n, k, size: token in f" {' '.join(n.classes)} "
    if m := re.fullmatch(rf"{value}\s*(!?=)\s*(\"[^\"]*\"|'[^']*')", text):
        get, want, equal = _value(m.group(1)), _unquote(m.group(3)), m.group(2) == "="
        if m.group(1)[0] == "@":
            return lambda n, k, size: m.group(1)[1:].lower() in n.attrs and (get(n) == want) == equal
        return lambda n, k, size: (get(n) == want) == equal
    if m := re.fullmatch(r"position\(\)\s*(<=|>=|=|<|>)\s*(\d+)", text):
        op, b = m.group(1), int(m.group(2))
        return lambda n, k, size: {"<=": k <= b, ">=": k >= b, "=": k == b, "<": k < b, ">": k > b}[op]
    if re.fullmatch(r"@[\w:-]+", text):
        return lambda n, k, size: text[1:].lower() in n.attrs
    if re.fullmatch(r"[.\w/@*:\[\]'\"= -]+", text) and not text.startswith("@"):
        return lambda n, k, size: bool(xpath(n, text))
    raise BadSelector(text)


def _split(text: str, word: str) -> list[str]:
    """Split at a word that stands outside quotes and brackets."""
    out, depth, quote, last = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text.startswith(word, k) and k >= last:
            out.append(text[last:k])
            last = k + len(word)
    return [*out, text[last:]]


def _value(text: str) -> Callable[[Node], str]:
    if text.startswith("normalize-space"):
        inner = text[len("normalize-space(") : -1] or "."
        get = _value(inner)
        return lambda n: norm_space(get(n))
    if text.startswith("@"):
        return lambda n: n.attr(text[1:])
    if text == "text()":
        return lambda n: "".join(c.data for c in n.children if c.kind == "text")
    return lambda n: text_of(n, inert=True)


def _brackets(s: str, at: int) -> int:
    """End of the bracketed predicate that begins at `at`."""
    depth, quote = 0, ""
    for k in range(at, len(s)):
        c = s[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if depth == 0:
                return k + 1
    raise BadSelector(s)


def xpath(root: Node, path: str) -> list[Node]:
    """Elements a path finds from a node. Raises BadSelector."""
    out: list[Node] = []
    for one in _split(path.strip(), "|"):
        one = one.strip()
        if one.startswith("(") and one.endswith(")"):
            one = one[1:-1]
        nodes, at, begun = [root], 0, False
        if one.startswith("/"):
            top = root
            while top.parent is not None:
                top = top.parent
            nodes = [top]
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or m.end() == at or (begun and not m.group(1)):
                raise BadSelector(path)
            begun = True
            sep, axis, name = m.groups()
            at = m.end()
            tests = []
            while at < len(one) and one[at] == "[":
                end = _brackets(one, at)
                tests.append(_predicate(one[at + 1 : end - 1]))
                at = end
            found: list[Node] = []
            for n in nodes:
                if name in (".", ".."):
                    got = [n] if name == "." else [n.parent] if n.parent else []
                    if sep == "//" and name == ".":
                        got = [x for x in n.walk() if x.kind == "element"]
                elif name.startswith("@") or name == "text()":
                    got = [n] if name == "text()" or name[1:].lower() in n.attrs else []
                else:
                    if axis == "ancestor":
                        pool = list(n.ancestors())
                    elif axis == "parent":
                        pool = [n.parent] if n.parent else []
                    elif axis == "self":
                        pool = [n]
                    elif axis == "following-sibling":
                        own = _siblings(n)
                        pool = own[_place(n) :]
                    elif sep == "//" or axis in ("descendant", "descendant-or-self"):
                        pool = [x for x in n.walk() if x is not n or axis == "descendant-or-self"]
                    else:
                        pool = n.children
                    got = [x for x in pool if x is not None and x.kind == "element" and name in ("*", "node()", x.tag)]
                groups: dict[int, list[Node]] = {}
                for x in got:
                    groups.setdefault(id(x.parent) if sep == "//" else 0, []).append(x)
                for group in groups.values():
                    for t in tests:
                        group = [x for k, x in enumerate(group, 1) if t(x, k, len(group))]
                    found += group
            nodes = list({id(x): x for x in found}.values())
        out += nodes
    order = {id(x): k for k, x in enumerate(root.walk())} if len(out) > 1 else {}
    return sorted({id(x): x for x in out}.values(), key=lambda x: order.get(id(x), 1 << 60))


def select_all(root: Node, selectors: list[str] | tuple[str, ...]) -> list[Node]:
    """Nodes of all selectors, selector by selector; blank ones, "0" and those that don't parse give none."""
    out: list[Node] = []
    for s in selectors:
        s = s.strip()
        if s in ("", "0"):
            continue
        try:
            if s.startswith(XPATH):
                out += xpath(root, s[len(XPATH) :]) if s[len(XPATH) :].strip() else []
            else:
                test = css(s)
                out += [n for n in root.walk() if n is not root and n.kind == "element" and test(n)]
        except BadSelector:
            continue
    return out


def select_one(root: Node, selectors) -> Node | None:
    found = select_all(root, selectors)
    return found[0] if found else None


def select_text(root: Node, selectors) -> str:
    return norm_space(text_of(select_one(root, selectors)))


def select_plain(root: Node, selectors) -> str:
    return plain_text(select_one(root, selectors))


def select_attr(root: Node, selectors, name: str, base: str) -> str:
    """First value of an attribute among the matches, as an absolute URL."""
    return next((resolve(v, base) for n in select_all(root, selectors) if (v := n.attr(name).strip())), "")
