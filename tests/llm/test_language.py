import collections
import itertools
import math
import re

import numpy as np
import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from loomglass.llm import language, queries

VOCABULARY = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def test_forward_sums_all_segmentations():
    bodies = language.vocabulary(VOCABULARY)
    number = {b: k for k, b in enumerate(bodies)}
    r = np.random.default_rng(1)
    p = r.random((len(bodies), 2)) * 1e-2
    model = language.UnigramLanguages(VOCABULARY, ["a", "b"], np.array([0.5, 0.5]))
    scale = language.SCALE ** np.array([len(b) for b in bodies], float)
    model.p = p * scale[:, None]
    words = ["the", "straße", "x", "qqq", "hello"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    buf, place, order = language.marked_words(data, starts.astype(np.int64), ends.astype(np.int64))
    got = np.empty((len(words), 2))
    got[order] = language.Lattice(buf, place, language.table(VOCABULARY)).forward(model.p)
    for w, row in zip(words, got):
        raw = bytes([language.MARK]) + w.encode()
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(raw)]
            prob = np.ones(2)
            for a, b in zip(edges[:-1], edges[1:]):
                piece = raw[a:b]
                prob = prob * (p[number[piece]] if piece in number else language.FLOOR if b - a == 1 else 0.0)
            total += prob
        assert np.allclose(np.exp(row), total, rtol=1e-9), w


def test_long_words_do_not_underflow():
    model = language.UnigramLanguages(VOCABULARY, ["a"], np.ones(1))
    model.p[:] = 1e-5
    data = np.frombuffer(b"ab" * 4000, np.uint8)
    buf, place, order = language.marked_words(data, np.array([0]), np.array([len(data)]))
    assert math.isfinite(language.Lattice(buf, place, language.table(VOCABULARY)).forward(model.p)[0, 0])


def test_languages_without_spaces_are_learnt(spark):
    r = np.random.default_rng(6)
    letters = {"zh": "的一是不了人我在有他这中大来上国", "ja": "のにはをたがでてとしれさあるいか"}
    text = lambda l: "".join(r.choice(list(letters[l]), 120))
    rows = [(k, text("zh" if k % 4 else "ja"), "zh" if k % 4 else "ja") for k in range(48)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY)
    new = spark.createDataFrame([(k, text(l), l) for k, l in enumerate(["zh", "ja"] * 5)], "doc_id long, text string, lang string")
    assert all(x.lang_pred == x.lang for x in language.identified(new, model, ["doc_id", "lang"]).collect())


def test_expected_counts_of_a_long_word_add_up():
    bodies, pieces = language.vocabulary(VOCABULARY), language.table(VOCABULARY)
    p = np.full(len(bodies), 1e-4) * language.SCALE ** np.array([len(b) for b in bodies], float)
    raw = np.frombuffer(b"theword" * 300, np.uint8)
    buf, place, _ = language.marked_words(raw, np.array([0]), np.array([len(raw)]))
    c = language.Lattice(buf, place, pieces).expected(p, np.ones(1), pieces.n)
    assert math.isclose(sum(x * len(b) for x, b in zip(c, bodies)), len(raw) + 1, rel_tol=1e-6)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) and len(c.lower()) == 1 else c for c in text))


class Plain:
    """The model, one word and one place at a time."""

    def __init__(self, samples):
        bodies = language.vocabulary(VOCABULARY)
        self.size = max(map(len, bodies))
        self.p = {}
        for lang, texts in samples.items():
            counts = collections.Counter(w for t in texts for w in plain_words(t))
            p = dict.fromkeys(bodies, 1 / len(bodies))
            for _ in range(language.ROUNDS):
                c = collections.Counter()
                for w, n in counts.items():
                    for b, v in self.expected(p, w).items():
                        c[b] += n * v
                whole = sum(c.values()) + 0.02 * len(bodies)
                p = {b: (c[b] + 0.02) / whole for b in bodies}
            self.p[lang] = p

    def pieces(self, p, raw):
        return [(a, b, p.get(raw[a:b], language.FLOOR if b == a + 1 else 0.0), raw[a:b] in p) for b in range(1, len(raw) + 1) for a in range(max(0, b - self.size), b) if b == a + 1 or raw[a:b] in p]

    def forward(self, p, raw):
        f = [1.0] + [0.0] * len(raw)
        for a, b, v, _ in self.pieces(p, raw):
            f[b] += f[a] * v
        return f

    def expected(self, p, word):
        raw = bytes([language.MARK]) + word.encode()
        arcs, f, back = self.pieces(p, raw), self.forward(p, raw), [0.0] * len(raw) + [1.0]
        for a, b, v, _ in sorted(arcs, key=lambda x: (-x[1], -x[0])):
            back[a] += v * back[b]
        out = collections.Counter()
        for a, b, v, known in arcs:
            if known:
                out[raw[a:b]] += f[a] * v * back[b] / f[-1]
        return out

    def predict(self, prior, text):
        seen = collections.Counter(plain_words(text))
        score = {x: math.log(prior[x]) + sum(n * math.log(self.forward(p, bytes([language.MARK]) + w.encode())[-1]) for w, n in seen.items()) for x, p in self.p.items()}
        top = max(score.values())
        best = max(sorted(score), key=lambda x: score[x])
        return best, math.exp(score[best] - top) / sum(math.exp(v - top) for v in score.values())


def test_model_and_query_equal_a_plain_version(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    learnt = docs.where(~queries.held_out() & F.col("lang").isNotNull())
    chosen = [r for r in learnt.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()]
    monkeypatch.setattr(language, "DOCS_PER_LANGUAGE", 6)
    samples, prior = {}, collections.Counter(r.lang for r in chosen)
    for r in chosen:
        if len(samples.setdefault(r.lang, [])) < 6:
            samples[r.lang].append(r.text)
    plain = Plain(samples)
    model = language.fit_languages(docs.where(~queries.held_out()), VOCABULARY, per_language=6)
    scale = language.SCALE ** np.array([len(b) for b in language.vocabulary(VOCABULARY)], float)
    for k, x in enumerate(model.languages):
        assert np.allclose(model.p[:, k] / scale, [plain.p[x][b] for b in language.vocabulary(VOCABULARY)], rtol=1e-6, atol=1e-12)
    for r in language.identified(docs.limit(60), model, ["doc_id", "text"]).collect():
        want, score = plain.predict({x: n / sum(prior.values()) for x, n in prior.items()}, r.text) if any(c.isalpha() for c in r.text) else ("und", 0.0)
        assert r.lang_pred == want and abs(r.score - score) < 1e-6


def test_a_frequent_language_is_not_ranked_whole(spark):
    rows = [(k, "alpha beta gamma", "en") for k in range(6000)] + [(9000 + k, "un deux trois quatre " * (9000 if k else 1), "fr") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, VOCABULARY, per_language=50)
    assert model.languages == ["en", "fr"] and abs(model.prior[0] - 6000 / 6003) < 1e-12
    assert {r.lang_pred for r in language.identified(docs.where("doc_id >= 9000"), model, ["doc_id"]).collect()} == {"fr"}


def test_case_is_folded_in_all_scripts():
    for a, b in (("ŁÓDŹ", "łódź"), ("ПРИВЕТ", "привет"), ("ΑΒΓ", "αβγ"), ("ẠẢ", "ạả"), ("𐐀", "𐐨"), ("ABCÀ", "abcà"), ("İ漢😀", "İ漢😀")):
        assert language.lowered(np.frombuffer(a.encode(), np.uint8)).tobytes().decode() == b


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98


def test_edges(spark, edges, nothing):
    none = language.identified(edges, language.fit_languages(nothing, VOCABULARY), ["doc_id", "lang"])
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and none.count() == len(EDGES)
    model = language.fit_languages(edges, VOCABULARY)
    rows = language.identified(edges, model, ["doc_id", "text", "n"]).collect()
    assert {r.lang_pred for r in rows if r.text is None or not any(c.isalpha() for c in r.text)} == {"und"}
    assert {r.lang_pred for r in rows if r.text and any(c.isalpha() for c in r.text)} == {"en"} and all(0 <= r.score <= 1 for r in rows)
    assert language.identified(nothing, model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        language.identified(edges.withColumnRenamed("n", "score"), model, ["score"])
