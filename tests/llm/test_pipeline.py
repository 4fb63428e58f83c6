import hashlib
import struct

import corpus_pipeline as cp
from brute import base_spans, contamination, ngram_groups
from tokenizers import Tokenizer

from loomglass.llm import quality, queries
from loomglass.llm.common import settled
from loomglass.llm.queries import held_out


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, outs = docs, []
    for name, stage in cp.STAGES:
        state = settled(stage(spark, state, sf), "test")
        outs.append(state.collect())
        assert name == cp.STAGES[-1][0] or state.columns == cp.COLUMNS
    first, second, third, fourth, last = outs
    field = quality.fit_lines(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    good = {r.doc_id for r in quality.scored(docs, field, ["doc_id"]).where("score >= 0.5").collect()}
    assert {r.doc_id for r in first} == good
    groups = ngram_groups([(r.doc_id, r.text) for r in first])
    assert {r.doc_id for r in second} == {top for _, top in groups.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, n, h, _ in contamination([(r.doc_id, r.text) for r in second], items) if not (h > 0 and 20 * h >= n)}
    assert {r.doc_id for r in third} == clean
    before = {r.doc_id: r for r in third}
    assert {r.doc_id for r in fourth} == clean
    for r in fourth:
        spans = base_spans(before[r.doc_id].text)
        assert base_spans(r.text) == [] and (spans or r.text != before[r.doc_id].text or r.n_chars == before[r.doc_id].n_chars)
        for s, _, e in spans:
            assert before[r.doc_id].text[s:e] not in r.text
    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in fourth}
    for r in last:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) == ids
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_registered(spark, sf):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run and len(cp.STAGES) == 5


def test_edges(spark, edges, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(10, 1, 0), (12, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    base = settled(edges.select(*cp.COLUMNS), "edges")
    for _, stage in cp.STAGES:
        assert stage(spark, base, sf).count() > 0
        assert stage(spark, base.limit(0), sf).count() == 0
    kept = cp.one_of_each_group(spark, base, sf).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 10, 12, 13] and sum(r.doc_id is None for r in kept) == 1
