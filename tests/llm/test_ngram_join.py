import random

import numpy as np
from brute import ngram_groups
from conftest import EDGES

from loomglass.llm import ngram_join
from loomglass.llm.common import utf8_view


def result(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.NgramJoin(docs, **options).components().collect()}


def test_groups_of_copies_against_all_pairs(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for n, copies in ((150, 70), (60, 40), (400, 12)):
        base = text(n)
        for _ in range(copies):
            d = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 2, 3, 4, 5, 8])):
                d[r.randrange(n)] = r.choice(vocabulary)
            rows.append(" ".join(d[: -r.randrange(1, 6)] if r.random() < 0.2 else d))
    hot = text(12)
    rows += [" ".join(text(r.randrange(3, 40)) + hot) for _ in range(40)] + ["x " * 50, "one two", "One  two", "one"]
    r.shuffle(rows)
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == ngram_groups(rows)


def test_edges(spark, edges, nothing):
    rows = [(i, t) for i, t in EDGES if i is not None]
    got = result(edges)
    assert got.pop(None) == (10, None)
    assert got == ngram_groups(rows)
    assert ngram_join.NgramJoin(edges).components().count() == len(EDGES)
    assert result(nothing) == {}


def test_prefixes_of_similar_sets_meet_under_every_order():
    import pyarrow as pa

    r = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    for _ in range(60):
        a = [r.choice(words) for _ in range(60)]
        b = list(a)
        b[r.randrange(60)] = "changed"
        data, offs = utf8_view(pa.array([" ".join(a), " ".join(b)]))
        token, bound = ngram_join.shingle_sets(data, offs)
        x, y = (set(token[bound[k] : bound[k + 1]].tolist()) for k in (0, 1))
        if 100 * len(x & y) >= 90 * len(x | y):
            for seed in ngram_join.SEEDS:
                t, cut = ngram_join.prefixes(token, bound, seed, None, 90, 100)
                assert set(t[: cut[1]].tolist()) & set(t[cut[1] :].tolist())
    assert ngram_join.prefix_length(np.array([0, 1, 5, 10, 300]), 90, 100).tolist() == [0, 1, 1, 2, 31]


def test_small_bitmaps_and_uncounted_tokens_change_no_group(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    line, rows = text(9), []
    for _ in range(50):  # short texts that share a line, and copies with a changed word
        rows.append(" ".join(line + text(2)))
        body = text(60)
        rows += [" ".join(body), " ".join(body[:30] + ["changed"] + body[31:])]
    rows = [(k, t) for k, t in enumerate(rows)]
    want = ngram_groups(rows)
    for most, share in ((1 << 30, 0.3), (1 << 8, 0.3), (1 << 12, 0.01)):
        monkeypatch.setattr(ngram_join, "MOST_BITS", most)
        monkeypatch.setattr(ngram_join, "LEAST_BITS", 1 << 8)
        monkeypatch.setattr(ngram_join, "SHARE", share)
        assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_bitmaps_grow_with_their_keys_up_to_a_bound():
    assert [ngram_join.fitted_bits(n) for n in (0, 1 << 20, 1 << 40)] == [18, 27, 28]
