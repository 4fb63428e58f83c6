import random

import pytest
from brute import base_spans
from conftest import EDGES

from loomglass.llm import pii


def test_rules_equal_plain_patterns():
    r = random.Random(2)
    texts = ["".join(r.choice("0123456789@@..+-() ab%_") for _ in range(60)) for _ in range(20_000)] + [t or "" for _, t in EDGES]
    texts += ["4539 1488 0343 6467 and 4539148803436467", "a@b.c@d.e", "+1 (555) 123-4567", "1.2.3.4.5.6.7.8", "999.1.1.1 255.255.255.255", "0000000000000000001.2.3.4"]
    assert [t for t in texts if base_spans(t) != pii.base_spans(t)] == []


@pytest.fixture(scope="module")
def model():
    texts = [f"Some words here and contact {pii._made_up(r, k)} or other words follow in this line." for k in range(4) for r in [__import__("numpy").random.default_rng(k)] for _ in range(40)]
    return pii.SpanTagger().fit(*pii.training_windows(texts), steps=160)


def test_gradients_agree_with_differences():
    import numpy as np

    m = pii.SpanTagger()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    ids, y = r.integers(0, pii.N_CLASSES, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 0, 7, 8, 8]])
    _, g = m.step(ids, y)
    for name in ("E", "Wf", "Ub", "Bf", "O", "T", "S"):
        at = tuple(r.integers(0, s) for s in m.p[name].shape)
        if name == "E":
            at = (ids[0, 0], 1)
        old = m.p[name][at]
        values = []
        for d in (1e-3, -1e-3):
            m.p[name][at] = old + d
            values.append(m.step(ids, y)[0])
        m.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-3 - g[name][at]) < 5e-3, name


def test_model_adds_respelt_spans_and_keeps_base(model):
    text = "mail john.doe (at) mail7 [dot] com now, " + "filler " * 40 + "base 10.20.30.40 stays"
    spans = pii.all_spans(model, [text])[0]
    assert [(k, by) for _, k, _, by in spans if not by] == [(1, False)]
    assert all(pii.holds(k, text[s:e]) for s, k, e, by in spans if by)
    assert pii.redacted(text, spans).endswith("base [ip] stays")


def test_addresses_without_digits_are_decoded_and_redacted(spark):
    r = __import__("numpy").random.default_rng(4)
    name = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    texts = [f"Some words here and contact {name(4)}.{name(4)}@{name(7)}.com or other words follow in this line." for _ in range(80)]
    model = pii.SpanTagger().fit(*pii.training_windows(texts), steps=300)
    for at in ("(at)", "[at]", "{at}", "( at )"):
        assert pii.anchored_windows("word " * 40 + f"john {at} example" + " word" * 40)
    assert pii.anchored_windows("word " * 80) == []
    text = "Some words here and contact john.doe (at) example [dot] com or other words follow in this line."
    row = pii.spotted(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"], redact=True).first()
    assert [(s.kind, text[s.start : s.end], s.by_model) for s in row.pii] == [("email", "john.doe (at) example [dot] com", True)]
    assert row.clean == "Some words here and contact [email] or other words follow in this line."


def plain_window(model, text):
    """Labels of a window and each place's gain over outside, one character at a time."""
    import numpy as np

    p, h = model.p, pii.HIDDEN
    ids = [int(pii.CLASSES[min(ord(c), 256)]) for c in text]

    def lstm(order, d):
        hid, cell, out = np.zeros(h), np.zeros(h), {}
        for t in order:
            g = p["E"][ids[t]] @ p["W" + d] + p["B" + d] + hid @ p["U" + d]
            i, f, o, u = 1 / (1 + np.exp(-g[:h])), 1 / (1 + np.exp(-g[h : 2 * h])), 1 / (1 + np.exp(-g[2 * h : 3 * h])), np.tanh(g[3 * h :])
            cell = f * cell + i * u
            hid = o * np.tanh(cell)
            out[t] = hid
        return out

    f, b = lstm(range(len(ids)), "f"), lstm(range(len(ids) - 1, -1, -1), "b")
    e = [np.concatenate([f[t], b[t]]) @ p["O"] + p["o"] for t in range(len(ids))]
    allowed = lambda a, c: c == 0 or c % 2 == 1 or a in (c - 1, c)
    best = {c: (p["S"][c] + e[0][c], [c]) for c in range(pii.N_LABELS) if allowed(-1, c)}
    for t in range(1, len(ids)):
        best = {c: max(((s + p["T"][a, c] + e[t][c], path + [c]) for a, (s, path) in best.items() if allowed(a, c)), key=lambda x: x[0]) for c in range(pii.N_LABELS) if any(allowed(a, c) for a in best)}
    path = max(best.values(), key=lambda x: x[0])[1]
    return path, [float(e[t][c] - e[t][0]) for t, c in enumerate(path)]


def plain_spans(model, text):
    """All spans of a text: every window that the gate opens, and the heaviest set of what they say by trying all."""
    import re

    found = []
    for s in range(0, max(len(text), 1), pii.STRIDE):
        if any(s <= m.start() < s + pii.WIDTH for m in re.finditer(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]", text)):
            # a short window is filled up with class 0, as the network sees it
            part = text[s : s + pii.WIDTH]
            path, gain = plain_window(model, part + "\x00" * (pii.WIDTH - len(part)))
            t = 0
            while t < len(part):
                if path[t] % 2 == 1:
                    e = t + 1
                    while e < len(part) and path[e] == path[t] + 1:
                        e += 1
                    found.append([s + t, s + e, path[t] // 2, max(sum(gain[t:e]), 1e-3)])
                    t = e
                else:
                    t += 1
    joined = []
    for f in sorted(found, key=lambda f: (f[2], f[0], f[1])):
        if joined and joined[-1][2] == f[2] and f[0] < joined[-1][1]:
            joined[-1] = [joined[-1][0], max(joined[-1][1], f[1]), f[2], max(joined[-1][3], f[3])]
        else:
            joined.append(f)
    joined.sort()

    def heaviest(k, end):
        if k == len(joined):
            return 0.0, []
        skip = heaviest(k + 1, end)
        if joined[k][0] >= end:
            w, rest = heaviest(k + 1, joined[k][1])
            if w + joined[k][3] > skip[0]:
                return w + joined[k][3], [joined[k], *rest]
        return skip

    own = base_spans(text)
    out = [(s, k, e, False) for s, k, e in own]
    for s, e, k, _ in heaviest(0, 0)[1]:
        while s < e and not (text[s].isalnum() or text[s] in "+(["):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")]"):
            e -= 1
        if s < e and not any(s < b and a < e for a, _, b in own) and pii.holds(k, text[s:e]):
            out.append((s, k, e, True))
    return sorted(out)


def test_all_spans_equal_a_plain_version(model):
    np = __import__("numpy")
    r = np.random.default_rng(8)
    texts = []
    for k in range(40):
        span = pii._respelt(r, k % 4, pii._made_up(r, k % 4))
        texts.append("word and other words " * int(r.integers(0, 4)) + span + " then " + (pii._respelt(r, (k + 1) % 4, pii._made_up(r, (k + 1) % 4)) if k % 3 else "ünï 12 x") + " end of it" * int(r.integers(0, 9)))
    texts += [t for _, t in EDGES if t and len(t) < 200]
    got = pii.all_spans(model, texts)
    assert [t for t, g in zip(texts, got) if g != plain_spans(model, t)] == []
    assert sum(by for g in got for *_, by in g) > 10


def test_recall_and_precision_of_spellings_that_the_rules_do_not_know(spark):
    """A model trained as in production, on spans of new names and numbers in texts that it has not seen."""
    np = __import__("numpy")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit_tagger(docs.where("doc_id % 4 <> 0"))
    rows = [x.text for x in docs.where("doc_id % 4 = 0 and length(text) > 300").orderBy("doc_id").limit(150).collect()]
    r = np.random.default_rng(99)
    name = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    made = {0: lambda d: name(int(r.integers(3, 9))) + "." + name(5) + str(r.choice([" (at) ", "(at)", " [at] ", " @ "])) + name(6) + str(r.choice([" (dot) ", "[dot]", "."])) + "org",
            1: lambda d: str(r.choice([" . ", "-", ":"])).join(map(str, r.integers(1, 256, 4))),
            2: lambda d: str(r.choice([".", "/", "_"])).join((d + next(str(k) for k in range(10) if pii.luhn(d + str(k))))[i : i + 4] for i in range(0, 16, 4)),
            3: lambda d: f"({d[:3]}) {d[3:6]}-{d[6:10]}"}
    texts, want = [], []
    for k in range(4):
        for _ in range(60):
            t = str(r.choice(rows))
            at = t.find(" ", int(r.integers(100, 250)))
            at = at if at > 0 else 0
            span = made[k]("".join(map(str, r.integers(0, 10, 15))))
            texts.append(f"{t[:at]} {span}{t[at:]}")
            want.append((at + 1, k, at + 1 + len(span), True))
    found = [w in g for w, g in zip(want, pii.all_spans(model, texts))]
    recall = [sum(found[60 * k : 60 * k + 60]) / 60 for k in range(4)]
    untouched = sum(by for g in pii.all_spans(model, rows) for *_, by in g)
    print(recall, untouched)
    assert min(recall) >= 0.8 and untouched <= 3


def test_reconciled_keeps_the_heaviest_set():
    assert pii.reconciled([(0, 10, 0, 1.0), (5, 15, 0, 2.0), (20, 30, 1, 5.0), (25, 40, 2, 4.0), (29, 50, 3, 3.0)]) == [(0, 0, 15), (20, 1, 30)]


def test_edges(spark, edges, nothing, model):
    out = pii.spotted(edges, model, edges.columns, redact=True)
    assert out.count() == len(EDGES) and {c for c in out.columns} == {*edges.columns, "pii", "clean"}
    plain = {(r.doc_id, r.text, r.clean) for r in out.where("size(pii) = 0").collect()}
    assert all(t == c for _, t, c in plain)
    assert pii.spotted(nothing, model, ["doc_id"]).count() == 0
    assert pii.fit_tagger(nothing) is not None
    with pytest.raises(ValueError):
        pii.spotted(edges.withColumnRenamed("n", "pii"), model, ["pii"])
