"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of 13 words (an item with fewer words
is one window). A window is a set of word shingles and must be contained in a
document whole, so with shingles in one global order a single prefix token is
necessary: the rarest. The order is by document frequency, counted over all
documents. The join looks each document shingle up among the prefix tokens,
applies the bounds that position and length give (the window has to fit into
the document around the shingle), and verifies the survivors word for word.

The benchmark is read in blocks of at most BLOCK_BYTES of text; one block is
all that the driver holds and the index of one all that is ever broadcast. A
benchmark of several blocks takes one pass over the documents for each.

Results: a null text has no words; empty documents and items match nothing;
repeated documents get equal rows; item ids compare as strings, a null id is
the string 'null', and items that share an id count once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .carry import carried, free_name
from .common import BY_ALNUM, Words, configure, dropped, give_back, sequence_hash, settled, spans_of, text_map, utf8_view

WINDOW, SHINGLE = 13, 5
#: Benchmark text whose index may be broadcast at once.
BLOCK_BYTES = 4 << 20


class Index:
    """Windows of one block of items, their shingles, and the prefix tokens once frequencies are known."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, shingle: int):
        data, offs = utf8_view(pa.array(texts, pa.string()))
        length, begin, head, owner, sizes = [], [], [], [], []
        joined = bytearray()
        for i, j in spans_of(offs):
            w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], BY_ALNUM)
            for d in range(j - i):
                a, b = int(w.first[d]), int(w.first[d + 1])
                if a == b:
                    continue
                k = min(window, b - a)
                at = np.arange(a, b - k + 1)
                low = w.low.tobytes()
                places = []
                for x in range(a, b):
                    places.append(len(joined))
                    joined += low[w.start[x] : w.end[x]] + b" "
                places.append(len(joined))
                s = min(shingle, k)
                parts = sequence_hash(w.hash, np.arange(a, b - s + 1), s)
                for x, h in zip(at.tolist(), sequence_hash(w.hash, at, k)):
                    head.append(h)
                    length.append(k)
                    begin.append((places[x - a], places[x - a + k] - 1))
                    owner.append(i + d)
                    sizes.append(parts[x - a : x - a + k - s + 1])
        self.ids, self.text, self.shingle = ids, bytes(joined), shingle
        order = np.lexsort((np.array(head, np.uint64), np.array(length, np.int64)))
        self.windows: list[tuple[int, np.uint64, bytes, np.ndarray, list[int]]] = []
        for o in order:
            body = self.text[begin[o][0] : begin[o][1]]
            if self.windows and self.windows[-1][2] == body:
                self.windows[-1][4].append(owner[o])
            else:
                self.windows.append((length[o], head[o], body, sizes[o], [owner[o]]))
        self.sizes = sorted({min(shingle, w[0]) for w in self.windows})
        self.known = {s: np.unique(np.concatenate([w[3] for w in self.windows if min(shingle, w[0]) == s])) for s in self.sizes}
        self.base = dict(zip(self.sizes, np.cumsum([0, *(len(self.known[s]) for s in self.sizes)]).tolist()))

    def choose(self, frequency: dict[int, int]) -> None:
        """Keep each window's rarest shingle as its prefix token."""
        tokens: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.sizes}
        for n, (k, _, _, parts, _) in enumerate(self.windows):
            s = min(self.shingle, k)
            place = np.searchsorted(self.known[s], parts)
            _, token, offset = min((frequency.get(self.base[s] + int(p), 0), int(p), x) for x, p in enumerate(place))
            tokens[s].append((token, n, offset))
        self.prefix = {}
        for s, rows in tokens.items():
            rows.sort()
            token, number, offset = (np.array(c, np.int64) for c in zip(*rows))
            keys, first, count = np.unique(token, return_index=True, return_counts=True)
            self.prefix[s] = (self.known[s][keys], first, count, number, offset)
        self.length = np.array([w[0] for w in self.windows], np.int64)
        self.head = np.array([w[1] for w in self.windows], np.uint64)
        self.body = [w[2] for w in self.windows]
        self.owners = [[self.ids[i] for i in sorted(set(w[4]))] for w in self.windows]
        del self.windows, self.known

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every window that stands in the chunk."""
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, (keys, first, count, number, offset) in self.prefix.items():
            h, at = w.shingles(s)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == h)
            place, at = place[hit], at[hit]
            many = count[place]
            row = np.repeat(first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            start, window = np.repeat(at, many) - offset[row], number[row]
            doc = np.repeat(w.doc[at], many)
            fits = (start >= w.first[doc]) & (start + self.length[window] <= w.first[doc + 1])  # positional and length bounds
            start, window = start[fits], window[fits]
            for k in np.unique(self.length[window]):
                of = np.flatnonzero(self.length[window] == k)
                of = of[sequence_hash(w.hash, start[of], int(k)) == self.head[window[of]]]
                found_at.append(start[of])
                found.append(window[of])
        start, window = np.concatenate(found_at), np.concatenate(found)
        low = w.low.tobytes()
        exact = [
            b" ".join(low[a:b] for a, b in zip(w.start[x : x + self.length[n]].tolist(), w.end[x : x + self.length[n]].tolist())) == self.body[n]
            for x, n in zip(start.tolist(), window.tolist())
        ]
        exact = np.array(exact, bool)
        return start[exact], window[exact]


def _frequencies(docs: DataFrame, text: str, index: Index) -> dict[int, int]:
    """Document frequency of each of the block's shingles over all documents."""
    known, base = index.known, index.base

    def kernel(batch, data, offs):
        w = Words(data, offs, BY_ALNUM)
        pairs = []
        for s, keys in known.items():
            h, at = w.shingles(s)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            pairs.append(np.unique(w.doc[at[hit]] * (1 << 32) + place[hit] + base[s]) & 0xFFFFFFFF)
        token, n = np.unique(np.concatenate(pairs), return_counts=True)
        return {"token": token.astype(np.int64), "n": n.astype(np.int64)}

    counted = text_map(docs, [], text, "token long, n long", kernel)
    return {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # at most the block's shingles


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int):
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k).select(F.coalesce(F.col(item).cast("string"), F.lit("null")), text).collect()
        rows = [r for r in rows if r[1]]
        if rows or n == 1:
            yield [r[0] for r in rows], [r[1] for r in rows]


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """keep, n_words, n_hit (words inside any occurrence), items (sorted ids) and spans (word ranges, end exclusive)."""
    spark = docs.sparkSession
    configure(spark)
    base, name, _ = carried(docs, keep, text, ["n_words", "n_hit", "items", "spans"])
    marks = free_name("__spans", base.columns), free_name("__items", base.columns)
    state = base.select("*", F.lit(None).cast("binary").alias(marks[0]), F.lit(None).cast("array<string>").alias(marks[1]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    shared, done = None, None
    for ids, texts in _blocks(benchmark, item, item_text, block_bytes):
        if shared is not None:  # a pass of its own for each further block: one index in memory at a time
            after = settled(state.drop("n_words", "n_hit"), "decontaminate")
            shared.destroy()
            if done is not None:
                dropped(spark, done)
            state = done = after
        index = Index(ids, texts, window, shingle)
        index.choose(_frequencies(docs, text, index) if index.sizes else {})
        shared = spark.sparkContext.broadcast(index)
        state = state.mapInArrow(_pass(shared, name, marks), f"{fields}, n_words long, n_hit long")
    spans = F.transform(
        F.sequence(F.lit(0), (F.octet_length(marks[0]) / 16).cast("int") - 1),
        lambda i: F.struct(*(F.conv(F.hex(F.substring(F.col(marks[0]), i * 16 + 1 + o, F.lit(8))), 16, 10).cast("long").alias(n) for o, n in ((0, "start"), (8, "end")))),
    )
    return state.select(*keep, "n_words", "n_hit", F.col(marks[1]).alias("items"), F.when(F.octet_length(marks[0]) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def _pass(shared, name: str, marks: tuple[str, str]):
    def run(batches):
        index: Index = shared.value
        for batch in batches:
            names = batch.schema.names
            data, offs = utf8_view(batch.column(name))
            for i, j in spans_of(offs):
                part = batch.slice(i, j - i)
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], BY_ALNUM)
                start, window = index.matches(w) if index.sizes else (np.zeros(0, np.int64),) * 2
                n = np.diff(w.first)
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[window] if len(start) else start, -1)
                inside = np.cumsum(edge[:-1]) > 0
                items: list[set] = [set(x or ()) for x in part.column(marks[1]).to_pylist()]
                for x, k in zip(w.doc[start].tolist(), window.tolist()):
                    items[x].update(index.owners[k])
                before = part.column(marks[0]).to_pylist()
                spans, hits = [], []
                for d in range(j - i):
                    here = inside[w.first[d] : w.first[d + 1]]
                    if before[d]:
                        here = here.copy()
                        for a, b in np.frombuffer(before[d], ">i8").reshape(-1, 2):
                            here[a:b] = True
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], here.view(np.int8), [0])))) if here.any() else np.zeros(0, np.int64)
                    spans.append(turn.astype(">i8").tobytes())
                    hits.append(int(here.sum()))
                new = {marks[0]: pa.array(spans, pa.binary()), marks[1]: pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                columns = [new.get(c, part.column(m)) for m, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(hits, pa.int64())], [*names, "n_words", "n_hit"])
        give_back()

    return run
