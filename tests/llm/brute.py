"""Plain versions of the operators' results, over lists."""

import re
from collections import defaultdict

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def groups(nodes, linked):
    """Smallest member of each node's group."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def ngram_groups(rows, n=3, num=90, den=100):
    """{id: (set size, smallest id of the group)}."""
    sets = {}
    for i, text in rows:
        w = space_words(text)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    linked = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and den * (o := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - o)
    ]
    top = groups(ids, linked)
    return {i: (len(sets[i]), top[i]) for i in ids}


def contamination(rows, items, window=13):
    """[(id, words, hits, sorted item ids)] of each row."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        k = min(window, len(w))
        for at in range(len(w) - k + 1) if w else ():
            windows[tuple(w[at : at + k])].add("null" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[at : at + k]))) is not None:
                    hit.update(range(at, at + k))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return out


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    from loomglass.llm.pii import luhn

    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def repeated_runs(rows, length):
    """Ids of rows that share a run of so many words with another id, and which of their words lie in such runs."""
    runs = defaultdict(set)
    words = {i: space_words(t) for i, t in rows}
    for i, w in words.items():
        for at in range(len(w) - length + 1):
            runs[tuple(w[at : at + length])].add(i)
    cover = defaultdict(set)
    for i, w in words.items():
        for at in range(len(w) - length + 1):
            if len(runs[tuple(w[at : at + length])]) > 1:
                cover[i].update(range(at, at + length))
    return cover
