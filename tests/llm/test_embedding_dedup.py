import math
import random

from brute import groups

from loomglass.llm.embedding_dedup import NeighbourDescent

SCHEMA = "vec_id long, embedding array<float>, label int, node int, grp string, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "g", "v") for i, v, y in rows], SCHEMA).repartition(3)


def expected(rows):
    def usable(v, y):
        return y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    ok = [(k, i, v, y) for k, (i, v, y) in enumerate(rows) if i is not None and usable(v, y)]
    linked = [(k, m) for k, _, v, y in ok for m, _, w, z in ok if k != m and y == z and len(v) == len(w) and cosine(v, w) >= 0.98]
    n = {k: 0 for k in range(len(rows))}
    for k, _ in linked:
        n[k] += 1
    ids = groups([i for i, _, _ in rows if i is not None], [(rows[a][0], rows[b][0]) for a, b in linked])
    return sorted((i, n[k], ids[i]) if i is not None else (-1, 0, -1) for k, (i, _, _) in enumerate(rows))


def test_against_all_pairs(spark):
    r = random.Random(5)
    rows, i = [], 0
    for size in (1, 2, 3, 30, 60):
        for _ in range(6 if size < 10 else 1):
            base = [r.gauss(0, 1) for _ in range(16)]
            for _ in range(size):
                noise = r.choice([0, 0.02, 0.05, 0.15])
                rows.append((i, [float(f"{x + r.gauss(0, noise):.4f}") for x in base], r.randrange(2)))
                i += 3
    rows = [(k, [x for x in v], y) for k, v, y in rows]
    import numpy as np

    rows = [(k, [float(np.float32(x)) for x in v], y) for k, v, y in rows]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in NeighbourDescent(frame(spark, rows)).links().collect())
    assert got == expected(rows)


def test_edges(spark):
    nan = float("nan")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, nan], 0), (4, [1.0, None], 0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [1.0, 0.0], 1), (9, [], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0)]
    got = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in NeighbourDescent(frame(spark, rows)).links().collect()}
    alone = {(k, 0, k, True) for k in (1, 2, 3, 4, 5, 8, 9, 10)}
    assert got == alone | {(None, 0, None, None), (6, 2, 6, True), (7, 2, 6, False)}
    assert NeighbourDescent(frame(spark, rows).limit(0)).links().count() == 0


def test_links_between_saturated_groups_are_found(spark):
    r = random.Random(3)
    turn = 0.166  # cosine 0.986 across, well above 0.999 inside
    rows = []
    for k in range(36):
        family, side = divmod(k // 12, 2) if k < 24 else (1, 0)
        base = [0.0] * 16
        base[8 * family], base[8 * family + 1] = math.cos(turn * side), math.sin(turn * side)
        rows.append((k, [x + r.gauss(0, 0.003) for x in base], 0))
    import numpy as np

    rows = [(k, [float(np.float32(x)) for x in v], y) for k, v, y in rows]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in NeighbourDescent(frame(spark, rows)).links().collect())
    assert got == expected(rows) == [(k, 23 if k < 24 else 11, 0 if k < 24 else 24) for k in range(36)]


def by_row(rows):
    """(id, links, smallest id reachable) of every row, rows with one id kept apart."""
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    linked = [(k, m) for k, (_, v, y) in enumerate(rows) for m, (_, w, z) in enumerate(rows) if k != m and y == z and cosine(v, w) >= 0.98]
    top = groups(range(len(rows)), linked)
    name = {}
    for k, (i, _, _) in enumerate(rows):
        name[top[k]] = min(i, name.get(top[k], i))
    return sorted((i, sum(a == k for a, _ in linked), name[top[k]]) for k, (i, _, _) in enumerate(rows))


def test_one_id_for_several_vectors_or_labels(spark):
    rows = [(5, [1.0, 0.02], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.0], 0), (7, [1.0, 0.01], 0), (8, [0.0, 1.0], 0), (8, [0.0, 1.0], 1), (9, [0.01, 1.0], 1), (9, [0.02, 1.0], 0), (3, [0.0, -1.0], 0), (3, [0.0, -1.0], 0)]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in NeighbourDescent(frame(spark, rows)).links().collect())
    assert got == by_row(rows)
    assert (8, 1, 8) in got and (9, 1, 8) in got and got.count((3, 1, 3)) == 2 and (5, 2, 5) in got


def test_very_large_and_very_small_numbers(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [5e-324, 5e-324], 0), (4, [1.0, -1.0], 0), (5, [float("inf"), 1.0], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in NeighbourDescent(docs).links().collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_ids_that_are_text(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [1.0, 0.01], "x"), ("c", [0.0, 1.0], "x")], "vec_id string, embedding array<double>, label string")
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in NeighbourDescent(docs).links().collect()) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_audit_asks_on_until_it_meets_links_and_what_it_misses_is_compared_exhaustively(spark, monkeypatch):
    r = random.Random(9)
    rows = [(k, [r.gauss(0, 1) for _ in range(12)], 0) for k in range(900)]
    rows += [(1000 + k, [x * 1.01 + 0.001 for x in rows[k][1]], 0) for k in range(20)]
    import loomglass.llm.embedding_dedup as ed

    monkeypatch.setattr(ed, "AUDIT", 8)
    monkeypatch.setattr(ed, "LINKED", 20)
    search = NeighbourDescent(frame(spark, rows))
    none = spark.createDataFrame([], "node long, component long")
    assert search.audit(none) == 0.0
    whole = search.exhausted(none)
    assert search.audit(whole) == 1.0
    monkeypatch.setattr(ed, "AUDIT_ROUNDS", 1)
    monkeypatch.setattr(ed, "GOAL", 2.0)  # never reached
    got = {x.vec_id: (x.n_links, x.component_id) for x in search.links().collect()}
    assert all(got[k] == got[1000 + k] == (1, k) for k in range(20)) and sum(n for n, _ in got.values()) == 40


def test_counts_by_many_blocks(spark, monkeypatch):
    """Blocks that link as a whole, in part and not at all."""
    import numpy as np

    import loomglass.llm.embedding_dedup as ed

    monkeypatch.setattr(ed, "BLOCK", 8)
    monkeypatch.setattr(ed, "OVERLAP", 3)
    r = random.Random(2)
    rows = []
    for k in range(40):  # a chain along a circle, whose ends don't link
        rows.append((k, [math.cos(k * 0.02), math.sin(k * 0.02), 0.0, 0.0], 0))
    for k in range(40):  # a tight group with copies
        rows.append((100 + k, [0.0, 0.0, 1.0, r.choice([0.0, 0.01, r.gauss(0, 0.02)])], 0))
    rows = [(k, [float(np.float32(x)) for x in v], y) for k, v, y in rows]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in NeighbourDescent(frame(spark, rows)).links().collect())
    assert got == expected(rows)
