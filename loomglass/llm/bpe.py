"""Byte-pair encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens by one
gadget per merge, in rank order. It starts as one state with a loop for every
base symbol. The gadget of merge (a, b) -> ab

* adds an arc ``ab`` to every state that has an arc ``a``,
* gives ``ab`` a target state that copies the arcs which the target of ``b``
  has at that moment, and
* cuts the arc ``b`` out of the target of ``a``.

The accepted token sequences are exactly the canonical encodings, one for
each string. Written out, states times symbols would be 2.4e9 arcs for a
vocabulary of 49k, so a state is stored as what its gadget did (whom it
copied, when, and which arcs were cut). Whether a state has an arc is derived
from that when it is first asked for and kept in a table of at most ARCS
entries a generation (two generations, the older one is dropped).

Next to it stands the spelling table: the vocabulary's labels as a trie with
failure links, which after each symbol of a word gives the labels that end
there. Encoding takes one step of that table for each symbol and never goes
back: beginnings of a canonical encoding are canonical, so at each place
exactly one of the labels that end there has a live arc from the state that
was reached where it begins. That is the state reached here. The encoding is
read off from the word's end. Decoding emits the label of each arc.

Results: null and empty texts have no ids and decode to ''. Strings of special
tokens become their ids wherever they stand in the raw text. Repeated rows get
equal results. Other columns pass through untouched.
"""

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .carry import carried
from .common import configure, give_back

ARCS = 1 << 18


class MergeAutomaton:
    """A BPE vocabulary and merge list compiled as the module describes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.labels = {i: t for t, i in vocab.items()}
        self.n = n = max(vocab.values()) + 1
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}  # by state * n + symbol
        self.older: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self._spell(vocab)

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        if self.born[ab] >= 0:  # the label exists; its states stay as they are
            return
        self.left[ab], self.right[ab], self.born[ab] = a, b, rank
        self.cut.setdefault((a, b), rank)

    def _spell(self, vocab: dict[str, int]) -> None:
        """The spelling table: next node by symbol, failure link, and the (token, symbols) that end at each node, longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        depth = [0]
        for label, token in vocab.items():
            node = 0
            for symbol in self.symbols(label):
                to = self.next[node].get(symbol)
                if to is None:
                    to = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    own.append(-1)
                    depth.append(depth[node] + 1)
                node = to
            own[node] = token
        self.fail = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        queue = [0]
        for node in queue:  # by depth
            for symbol, to in self.next[node].items():
                if node:
                    back = self.fail[node]
                    while back and symbol not in self.next[back]:
                        back = self.fail[back]
                    self.fail[to] = self.next[back].get(symbol, 0)
                rest = self.ends[self.fail[to]]
                self.ends[to] = ((own[to], depth[to]), *rest) if own[to] >= 0 else rest
                queue.append(to)

    def symbols(self, label: str) -> list[str]:
        """A label's or word's base symbols: its characters, the last one with the suffix if the label ends a word."""
        if self.suffix and label.endswith(self.suffix):
            body = label.removesuffix(self.suffix)
            return [*body[:-1], body[-1:] + self.suffix]
        return list(label)

    def arc(self, state: int, symbol: int) -> bool:
        """Does the state that `state` leads to have an arc for `symbol`?"""
        key = state * self.n + symbol
        known = self.arcs.get(key)
        if known is None:
            known = self.older.get(key)
            if known is None:
                known = self._derive(state, symbol)
            if len(self.arcs) >= ARCS:
                self.older, self.arcs = self.arcs, {}
            self.arcs[key] = known
        return known

    def _derive(self, x: int, y: int) -> bool:
        """Replay the gadgets that made or cut this arc, latest first."""
        never = len(self.cut) + 1
        before = never  # arcs cut at this rank or later are not cut yet
        while True:
            if self.cut.get((x, y), never) < before:
                return False
            if self.born[x] < 0 and self.born[y] < 0:
                return True
            if self.born[y] >= self.born[x]:  # the arc came with y's gadget, if x had an arc for its left part
                rank = self.born[y]
                y = self.left[y]
                if self.cut.get((x, y), never) <= rank:
                    return False
                before = rank
            else:  # x's state was copied from its right part's
                before = self.born[x]
                x = self.right[x]

    def encode(self, word: str) -> list[int]:
        """Ids of one word, written in byte names: one step of the spelling table for each symbol, then the path read off from the end."""
        if not word:
            return []
        nexts, fail, ends, arcs, n = self.next, self.fail, self.ends, self.arcs, self.n
        taken = [(-1, 0)]  # the arc by which each place was reached, and its symbols
        node, at = 0, 0
        for symbol in (*word[:-1], word[-1] + self.suffix):
            at += 1
            while symbol not in nexts[node]:
                if not node:
                    raise KeyError(f"no label begins with {symbol!r}")
                node = fail[node]
            node = nexts[node][symbol]
            for step in ends[node]:
                y, size = step
                x = taken[at - size][0]
                if x < 0:
                    if size == at:
                        break
                    continue
                live = arcs.get(x * n + y)
                if live is None:
                    live = self.arc(x, y)
                    arcs = self.arcs
                if live:
                    break
            else:
                raise ValueError("the merges are not those of one canonical encoding")
            taken.append(step)
        ids = []
        while at:
            y, size = taken[at]
            ids.append(y)
            at -= size
        return ids[::-1]


class WordTokenizer:
    """The whole text-to-ids path of a vocabulary file with word ends: normalise, split, run the automaton."""

    #: White space that no word spans; str.split() would also cut at U+001C to U+001F.
    SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    KEEP, LONG = 1 << 18, 64
    #: Below U+0130 every character is its own normal form; letters and lower cases there stay there.
    NEAR = "".join(map(chr, range(0x130)))

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        rules = Tokenizer.from_file(path)  # for the normaliser and the word splitter that the file states
        self.normalise, self.words = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.near = re.compile("[" + re.escape(self.NEAR[:0x1C] + self.NEAR[0x20:]) + "]*")
        letters, digits = ("".join(map(re.escape, (c for c in self.NEAR if unicodedata.category(c)[0] == k))) for k in "LN")
        self.near_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+").findall
        self.near_names = {ord(c): self.words(c + "a")[0][0].removesuffix("a") for c in self.NEAR if not c.isspace()}
        self.simple = rules.normalizer.normalize_str("Éx\t") == "éx " and [w for w, _ in self.words("it's a12!é")] == ["it", "'s", "a", "1", "2", "!", "Ã©"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.known: dict[str, tuple[bytes, str]] = {}  # filled up to KEEP, then the older one, so that memory is bounded
        self.older: dict[str, tuple[bytes, str]] = {}
        self.odd = re.compile("[\x1c-\x1f]")

    def _word(self, piece: str) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32 bits) and labels of a stretch without white space."""
        got = self.known.get(piece) or self.older.get(piece)
        if got is None:
            ids: list[int] = []
            if self.simple and self.near.fullmatch(piece):
                words = [w.translate(self.near_names) for w in self.near_words(piece.lower())]
            else:
                words = [w for w, _ in self.words(self.normalise(piece))]
            for word in words:
                ids += self.automaton.encode(word)
            got = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
            if len(piece) <= self.LONG:
                if len(self.known) >= self.KEEP:
                    self.older, self.known = self.known, {}
                self.known[piece] = got
        return got

    def decode(self, ids) -> str:
        """The labels of the arcs taken, in order."""
        return " ".join(self.labels[i] for i in ids)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        ids, labels = [], []
        parts = self.special_split.split(text) if text and self.special_split else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                labels.append(part)
                continue
            for piece in self.SPACE.split(part) if self.odd.search(part) else part.split():
                a, b = self._word(piece)
                if a:
                    ids.append(a)
                    labels.append(b)
        return b"".join(ids), " ".join(labels)


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and decoded (the text of those ids) to the kept columns."""
    configure(df.sparkSession)
    keep = df.columns if keep is None else keep
    base, name, fields = carried(df, keep, text, ["ids", "decoded"])

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            got = [t.encode(x.as_py()) for x in batch.column(name)]
            columns = [*(batch.column(c) for c in keep), pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])
        give_back()

    return base.mapInArrow(run, f"{fields}ids binary, decoded string")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of a binary ids column as encode_decode() writes it."""

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        for s in batches:
            yield s.map(lambda b: t.decode(int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)) if b is not None else None)

    return df.withColumn("decoded", F.pandas_udf(one, "string")(ids))
