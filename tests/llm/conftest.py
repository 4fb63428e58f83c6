import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"long{k % 977} word{k}" for k in range(40_000))
#: (id, text) rows with every awkward case; other columns clash with names that operators use inside.
EDGES = [
    (1, None), (2, ""), (3, "word"), (3, "word"), (4, "   \n\t "), (5, LONG), (None, "a text without an id that is a little longer than others"), (7, "Ünïcødé ß İ Σς 漢字 \U0001f600 \x00\x1c end"),
    (8, "two words"), (9, "word"), (10, "the quick brown fox jumps over the lazy dog again and again today"), (11, "The quick brown fox jumps over the lazy dog again and again TODAY"), (12, "x" * 5000), (13, "12 34 @ 5.6.7 +"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, token string, n int, seed string, label int, hot boolean, prefix string"


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "en" if k % 2 else None, None, len(t) if t is not None else None, k, "n", "t", k, "s", 1, True, "p") for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
