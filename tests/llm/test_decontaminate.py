from brute import contamination
from conftest import EDGES

from loomglass.llm import decontaminate

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today and then some more words"), (2, None), (3, ""), (4, "word"), (5, "two words"), (None, "quick brown fox"), (4, "fox"),
    (7, " ".join(f"long{k % 977} word{k}" for k in range(500, 540))), (8, "the quick brown fox jumps over the lazy dog again and again today"),
]


def got(docs, items, **options):
    rows = decontaminate.contamination(docs, items, ["doc_id", "text"], **options).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, list(r.items)) for r in rows)


def test_against_all_windows(spark, edges, nothing):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = sorted((i if i is not None else -1, n, h, x) for i, n, h, x in contamination(EDGES, ITEMS))
    assert got(edges, items) == want
    assert got(edges, items, block_bytes=60) == want  # several blocks
    assert all(h == 0 for _, _, h, _ in got(edges, items.limit(0)))
    assert got(nothing, items) == []


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "__text", "__spans", "__items", "__spans_"]
    docs = spark.createDataFrame([(1, "two words here", "a", "b", "c", "d"), (2, None, "e", "f", "g", "h")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    items = spark.createDataFrame([(1, "two words"), (2, "words here")], "item_id long, text string")
    for keep in (names, [n for n in names if n != "text"]):
        rows = decontaminate.contamination(docs, items, keep, block_bytes=9).orderBy("doc_id").collect()
        assert [[r[n] for n in keep] for r in rows] == [[x[n] for n in keep] for x in docs.orderBy("doc_id").collect()]
        assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == [(3, 3, ["1", "2"]), (0, 0, [])]
