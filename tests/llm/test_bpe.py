import random
import struct

import pytest
from conftest import EDGES
from tokenizers import Tokenizer

from loomglass.llm import bpe, queries

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"


def same(library, own, s):
    ids = library.encode(s, add_special_tokens=False).ids
    mine, decoded = own.encode(s)
    return list(struct.unpack(f"<{len(mine) // 4}I", mine)) == ids and decoded == library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def pair():
    return Tokenizer.from_file(PATH), bpe.tokenizer(PATH)


def test_equals_the_library(pair):
    r = random.Random(1)
    letters = "abcdefghinorstuAEIOU  ''\n'é́ÖΣς12<|>.,!?\x1c\x1f​　漢"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 50))) for _ in range(8000)]
    texts = [t.replace("<", "<|endoftext|>") if k % 9 == 0 else r.choice("aeiouxl") * r.randrange(30) + t if k % 3 == 0 else t for k, t in enumerate(texts)]
    texts += [t or "" for _, t in EDGES] + [chr(c) + "a" + chr(c) for c in range(1, 0x2FFF)]
    assert [t for t in texts if not same(*pair, t)] == []


def test_equals_the_library_on_mixed_scripts(pair):
    r = random.Random(6)
    kinds = ["".join(map(chr, range(0x20, 0x7F))), "".join(map(chr, range(0xA0, 0x100))), "漢字かなカナ한글中文大小", "e\u0301a\u0308o\u0327n\u0303\u200d\ufe0f", "АБВгдеѐ ΑΒΓαβγς", "\U0001f600\U0001f468\u200d\U0001f469 \u2028\u00a0", " \t\n"]
    texts = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(1, 60))) for _ in range(6000)]
    assert [t for t in texts if not same(*pair, t)] == []


def test_arcs_are_bounded(pair, monkeypatch):
    library, own = pair
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 30))) for _ in range(1500)]
    monkeypatch.setattr(bpe, "ARCS", 500)
    kept = own.automaton.arcs, own.automaton.older, own.known, own.older
    own.automaton.arcs, own.automaton.older, own.known, own.older = {}, {}, {}, {}
    try:
        assert [t for t in texts if not same(library, own, t)] == []
        assert 0 < len(own.automaton.arcs) <= 500 and len(own.automaton.older) <= 500
    finally:
        own.automaton.arcs, own.automaton.older, own.known, own.older = kept


def test_small_automaton_equals_merging():
    """Every string over three symbols, against merging by rank."""
    merges = [("a", "a"), ("b", "c"), ("aa", "b"), ("a", "bc"), ("aa", "aa"), ("c", "a")]
    vocab = {t: k for k, t in enumerate(dict.fromkeys([*"abc", *(a + b for a, b in merges)]))}
    own = bpe.MergeAutomaton(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}

    def merged(s):
        parts = list(s)
        while True:
            found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not found:
                return [vocab[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = ["".join(parts[k : k + 2])]

    import itertools

    for n in range(1, 9):
        for s in itertools.product("abc", repeat=n):
            assert own.encode("".join(s)) == merged(s), s


def test_edges(spark, edges, nothing, pair):
    library, _ = pair
    rows = bpe.encode_decode(edges, PATH, keep=["doc_id", "text", "n"]).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids))) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(nothing, PATH, keep=["doc_id"]).count() == 0
    again = bpe.decode(bpe.encode_decode(edges, PATH, keep=["doc_id"]).withColumnRenamed("decoded", "before"), PATH)
    assert all(r.before == r.decoded for r in again.collect())
    with pytest.raises(ValueError):
        bpe.encode_decode(edges.withColumnRenamed("n", "ids"), PATH, keep=["ids"])
