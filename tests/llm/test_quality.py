import numpy as np
from conftest import EDGES
from pyspark.sql import functions as F

from loomglass.llm import quality, queries


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    f = quality.LineField(3)
    f.w, f.t, f.s = r.normal(size=3), r.normal(size=(2, 2)), r.normal(size=2)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    x = r.normal(size=(7, 3))
    good, pair, start, z = f.marginals(x, doc, True)
    want, zs, pairs = np.zeros(7), 0.0, np.zeros((2, 2))
    for d in range(3):
        rows = np.flatnonzero(doc == d)
        weights = {}
        for code in range(2 ** len(rows)):
            y = [code >> k & 1 for k in range(len(rows))]
            weights[tuple(y)] = np.exp(f.s[y[0]] + sum(x[i] @ f.w * v for i, v in zip(rows, y)) + sum(f.t[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        zs += np.log(total)
        for y, v in weights.items():
            want[rows] += np.array(y) * v / total
            for a, b in zip(y, y[1:]):
                pairs[a, b] += v / total
    assert np.allclose(good, want) and np.allclose(z, zs) and np.allclose(pair, pairs) and np.isclose(start.sum(), 3)


def test_lines():
    texts = ["a b\nC d!\n\nx", "", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, doc, size = quality.line_features(data, offs)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2] and size.tolist() == [4, 5, 1, 1, 0, 3] and x.shape == (6, quality.WIDTH) and np.isfinite(x).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, bad, n = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 0, (F.col("predicted") == 0).cast("int"))), F.count("*")).first()
    assert n > 80 and right >= 0.95 and bad >= 0.8


def plain_features(text):
    """The features of a document's lines, one line and one word at a time."""
    raw = (text or "").encode()
    lines = [x + b"\n" for x in raw.split(b"\n")[:-1]] + ([raw.split(b"\n")[-1]] if raw.split(b"\n")[-1] or not raw else [])
    split = lambda b: [w for w in b.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
    asis = lambda b: [w for w in b.replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
    own = []
    for x in lines:
        kinds = [int(quality.KIND[c]) for c in x]
        size, full, words, cased = len(x), max(len(x), 1), split(x), asis(x)
        per = max(len(words), 1)
        n = [kinds.count(k) for k in range(7)]
        up = sum(quality.KIND[w[0]] == 1 for w in cased) / per
        end = sum(quality.KIND[w[-1]] in (4, 5) for w in cased) / per
        stutter = sum(a == b for a, b in zip(words, words[1:])) / per
        same = sum(sorted(split(y)) == sorted(words) for y in lines)
        row = [v / full for v in n] + [np.log1p(size) / 8, np.log1p(len(words)) / 6, len(set(words)) / per, min((full - n[3]) / per / 10, 3), up, end, np.log1p(same - 1), stutter]
        own.append(row + [float(v > t) for v in (n[5] / full, n[1] / full, end, stutter) for t in quality.STEPS])
    none, out = [0.0] * quality.OWN, []
    for k, x in enumerate(own):
        alike = k > 0 and sorted(split(lines[k])) == sorted(split(lines[k - 1]))
        out.append([1.0, *x, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), float(alike)])
    return np.array(out, np.float32), [len(x) for x in lines]


def plain_score(field, text):
    """Score of one document by sums over all ways to end at each line."""
    x, size = plain_features(text)
    e = np.stack([np.zeros(len(x)), x.astype(float) @ field.w], 1)
    before, after = [field.s + e[0]], [np.zeros(2)]
    for k in range(1, len(x)):
        before.append(np.array([np.logaddexp(before[-1][0] + field.t[0, b], before[-1][1] + field.t[1, b]) + e[k, b] for b in (0, 1)]))
        after.append(np.array([np.logaddexp(field.t[a, 0] + e[-k, 0] + after[-1][0], field.t[a, 1] + e[-k, 1] + after[-1][1]) for a in (0, 1)]))
    good = [1 / (1 + np.exp((a + b)[0] - (a + b)[1])) for a, b in zip(before, after[::-1])]
    share = np.clip(np.average(good, weights=np.maximum(size, 1)), 1e-6, 1 - 1e-6)
    c, d = field.curve
    return 1 / (1 + np.exp(-(c * np.log(share / (1 - share)) + d)))


def test_query_equals_plain_version(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.fit_lines(docs, labels.where(~queries.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - plain_score(field, texts[r.doc_id])) < 1e-4, r.doc_id
        assert r.predicted == int(r.score >= 0.5)


def test_a_document_of_two_halves_has_good_and_bad_lines(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.fit_lines(docs, labels.where(~queries.held_out()))
    assert np.ptp(field.t) > 0.5 and field.t[0, 0] + field.t[1, 1] > field.t[0, 1] + field.t[1, 0]
    some = docs.join(labels.where(queries.held_out()), "doc_id").where("length(text) between 1200 and 6000").orderBy("doc_id").collect()
    lines = {q: [x for r in some if r.quality == q for x in r.text.split("\n") if len(x) > 60] for q in (0, 1)}
    noisy = [x for x in lines[0] if sum(c in "!#$%&*|" for c in x) > 5][:6]
    clean = lines[1][:6]
    assert len(noisy) == len(clean) == 6
    for first, second in ((clean, noisy), (noisy, clean)):
        data = np.frombuffer("\n".join(first + second).encode(), np.uint8)
        x, doc, _ = quality.line_features(data, np.array([0, len(data)]))
        good = field.marginals(x, doc)
        a, b = good[:6].mean(), good[6:].mean()
        assert (a > 0.8 and b < 0.2) if first is clean else (a < 0.2 and b > 0.8)


def test_expected_labels_meet_the_documents_labels():
    r = np.random.default_rng(4)
    f = quality.LineField(3)
    f.w, f.t, f.s = r.normal(size=3) * 2, r.normal(size=(2, 2)), r.normal(size=2)
    doc = np.repeat(np.arange(8), 5)
    x, size, label = r.normal(size=(40, 3)), r.integers(0, 50, 40), np.arange(8) % 2
    good, pair, start = f.expected(x, doc, size, label)
    weight = np.maximum(size, 1)
    share = np.bincount(doc, good * weight) / np.bincount(doc, weight)
    assert (share[label == 1] > 0.999).all() and (share[label == 0] <= 1 - quality.LEAST_BAD + 1e-6).all()
    free = np.bincount(doc, f.marginals(x, doc) * weight) / np.bincount(doc, weight)
    kept = (label == 0) & (free <= 1 - quality.LEAST_BAD)
    assert np.allclose(share[kept], free[kept]) and np.isclose(pair.sum(), 32) and np.isclose(start.sum(), 8)


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(k, k % 2, 7) for k in range(1, 14)] + [(3, 0, 7), (None, 1, 7), (4, None, 7)], "doc_id long, quality int, y int")
    field = quality.fit_lines(edges, labels)
    rows = quality.scored(edges, field, ["doc_id", "text", "n", "id"]).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text == "word"}) == 1
    assert quality.fit_lines(nothing, labels) is None and quality.fit_lines(edges, labels.limit(0)) is None
    assert {r.score for r in quality.scored(edges, None, ["doc_id"]).collect()} == {0.5}
    assert quality.scored(nothing, field, ["doc_id"]).count() == 0
