"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. Each language has a probability
for every piece; a word's probability is the sum over all of its
segmentations into pieces, found by the forward algorithm, and a text's is the
product over its words. The posterior over languages, with the languages'
shares as prior, gives prediction and score.

Piece probabilities are fitted by expectation-maximisation (the backward
algorithm gives expected piece counts) on at most DOCS_PER_LANGUAGE labelled
documents a language, those with the smallest hashes of their ids among the
ones of at most DOC_BYTES (longer ones, at most LONG_DOCS a language, only where
there are fewer short ones than that); the shares of languages are counted over all
labelled rows. Since hashes are uniform, rows are first cut to twice the
number wanted by a bound on the hash that follows from the language's count;
only what is left is ranked, so no task gets all rows of a frequent language.

Letters of any script are lower-cased if that keeps their length in UTF-8, in
texts and pieces alike; pieces of more than LONGEST bytes or with inner white
space are left out; bytes that no piece covers have a small fixed probability.

Results: texts that are null or have no letter are 'und' with score 0. Without
any labelled row all texts are 'und'. Repeated rows get equal results.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .carry import carried
from .common import BY_SPACE, LOWER, U64, Words, configure, mixed, spans_of, text_map

DOCS_PER_LANGUAGE, DOC_BYTES, LONG_DOCS, ROUNDS, LONGEST = 400, 1 << 16, 8, 4, 12
#: Rows that may be broadcast to mark the sample.
SAMPLE_ROWS = 1_000_000
MARK = 1  # byte that stands for the word start in place of the vocabulary's sign
FLOOR = 1e-7  # of a byte that no piece covers
SCALE = 4.0  # mean factor by which a byte shrinks a word's probability; kept out of the sums and put back in logs
BLOCK = 6  # languages at once
RESCALED = 16  # bytes after which expected counts are rescaled, at least LONGEST
FIT_BYTES = 1 << 18  # of words in one lattice while fitting; a longer word is a lattice of its own


@functools.lru_cache(1)
def _lower_points() -> np.ndarray:
    """Lower case of every code point below 0x20000 that keeps its length in UTF-8, else the point itself."""
    out = np.arange(0x20000, dtype=np.uint32)
    for p in range(0x80, 0x20000):
        low = chr(p).lower()
        if len(low) == 1 and low != chr(p) and not 0xD800 <= p < 0xE000 and len(low.encode()) == len(chr(p).encode()):
            out[p] = ord(low)
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8, byte for byte."""
    out = LOWER[data]
    top = int(data.max()) if len(data) else 0
    for size, first, last in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF0)):
        if top < first:
            break
        lead = np.flatnonzero((data >= first) & (data <= last))
        point = data[lead].astype(np.uint32) & (0x7F >> size)
        for k in range(1, size):
            point = point << 6 | data[lead + k] & 0x3F
        low = _lower_points()[np.minimum(point, 0x1FFFF)]
        at = np.flatnonzero((low != point) & (point < 0x20000))
        lead, low = lead[at], low[at]
        for k in range(size - 1, 0, -1):
            out[lead + k] = low & 0x3F | 0x80
            low = low >> 6
        out[lead] = low | (0x100 - (0x100 >> size))
    return out


@functools.lru_cache(2)
def vocabulary(path: str) -> list[bytes]:
    """Usable pieces, in byte order; their places are the piece numbers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = lowered(np.frombuffer(sp.id_to_piece(i).replace("▁", chr(MARK)).encode(), np.uint8)).tobytes()
            if MARK not in piece[1:] and len(piece) <= LONGEST:
                out.add(piece)
    return sorted(out)


def _keys(b: np.ndarray, size: int) -> np.ndarray:
    """Keys of all stretches of size bytes: up to 12 bytes packed into two words and mixed."""
    n = len(b) - size + 1
    low, high = np.zeros(n, U64), np.full(n, size, U64)
    for j in range(size):
        part = b[j : j + n].astype(U64)
        if j < 8:
            low |= part << U64(8 * j)
        else:
            high |= part << U64(8 * (j - 7))
    return mixed(low ^ mixed(high))


class PieceTable:
    """Open hash table over the vocabulary's keys: stretch of bytes to piece number, or -1."""

    BITS = 18

    def __init__(self, path: str):
        bodies = vocabulary(path)
        keys = np.concatenate([_keys(np.frombuffer(b, np.uint8), len(b)) for b in bodies])
        number = np.arange(len(keys), dtype=np.int32)
        size = 1 << self.BITS
        self.n = len(keys)
        self.key, self.piece = np.zeros(size, U64), np.full(size, -1, np.int32)
        left = np.arange(self.n)
        slot = (keys >> U64(64 - self.BITS)).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.piece[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.key[slot[put]], self.piece[slot[put]] = keys[left[put]], number[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> U64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.key[slot] == keys, self.piece[slot], -1)
        left = np.flatnonzero((out < 0) & (self.piece[slot] >= 0))
        at = slot[left]
        for _ in range(self.probes):
            if not len(left):
                break
            at = (at + 1) & ((1 << self.BITS) - 1)
            hit = self.key[at] == keys[left]
            out[left[hit]] = self.piece[at[hit]]
            more = ~hit & (self.piece[at] >= 0)
            left, at = left[more], at[more]
        return out


@functools.lru_cache(2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


def marked_words(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with their start marks one after another, longest first, and the order taken."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    size, start = size[order], start[order]
    total = int(size.sum()) + len(size)
    place = np.concatenate(([0], np.cumsum(size + 1)))
    buf = np.full(total, MARK, np.uint8)
    into = np.ones(total, bool)
    into[place[:-1]] = False
    buf[into] = low[np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))]
    return buf, place, order


class Lattice:
    """Pieces that end at every byte of a list of words, by length."""

    def __init__(self, buf: np.ndarray, place: np.ndarray, pieces: PieceTable):
        self.place, self.size = place, np.diff(place)
        n = len(buf)
        inside = np.arange(n) - np.repeat(place[:-1], self.size)  # bytes before this one in its word
        self.arcs = []
        for k in range(1, LONGEST + 1):
            if n < k:
                break
            found = np.full(n, -1, np.int32)
            ok = np.flatnonzero(inside[k - 1 :] >= k - 1)
            found[ok + k - 1] = pieces.find(_keys(buf, k)[ok] if len(ok) < n - k + 1 else _keys(buf, k))
            self.arcs.append(found)  # by the last byte

    def live(self, t: int) -> np.ndarray:
        return self.place[: np.searchsorted(-self.size, -t, "left")] + t  # words longer than t: their byte t

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """log P(word) under each column of piece probabilities (last row: of no piece), all segmentations summed."""
        n, m = len(self.size), logp.shape[1]
        ring = np.zeros((LONGEST + 1, n, m))
        ring[0] = 1
        shift = np.zeros((n, m))
        out = np.zeros((n, m))
        steps = int(self.size[0]) if n else 0
        for t in range(steps):
            at = self.live(t)
            w = len(at)
            now = np.zeros((w, m))
            for k, found in enumerate(self.arcs[: t + 1], 1):
                piece = found[at]
                if k == 1:
                    p = np.where((piece >= 0)[:, None], logp[piece], FLOOR * SCALE)
                    now += ring[t % (LONGEST + 1), :w] * p
                else:
                    rows = np.flatnonzero(piece >= 0)
                    if len(rows):
                        now[rows] += ring[(t + 1 - k) % (LONGEST + 1), rows] * logp[piece[rows]]
            ring[(t + 1) % (LONGEST + 1), :w] = now
            last = np.searchsorted(-self.size, -(t + 1), "left")  # of those, which go on
            if last < w:
                out[last:w] = np.log(np.maximum(now[last:w], 1e-300)) + shift[last:w] - (t + 1) * np.log(SCALE)
            if t % 64 == 63 and last:
                top = np.maximum(ring[:, :last].max(0), 1e-300)
                ring[:, :last] /= top
                shift[:last] += np.log(top)
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected piece counts of weighted words under one language's probabilities."""
        n = len(self.arcs[0]) if self.arcs else 0
        a = np.zeros(n + len(self.size))  # one more place a word: before its first byte
        up, down = np.zeros_like(a), np.zeros_like(a)  # logs of what each place was divided by
        shifted = self.place[:-1] + np.arange(len(self.size))
        a[shifted] = 1
        word = np.repeat(np.arange(len(self.size)), self.size)
        steps = int(self.size[0]) if len(self.size) else 0
        prob = [np.where(f >= 0, p[f], FLOOR * SCALE if k == 0 else 0.0) for k, f in enumerate(self.arcs)]
        back = np.arange(LONGEST)  # the places that others are still reached from
        for t in range(steps):
            at = self.live(t)
            to = at + word[at] + 1
            up[to] = up[to - 1]
            for k in range(1, min(t + 1, len(self.arcs)) + 1):
                a[to] += a[to - k] * prob[k - 1][at]
            if t % RESCALED == RESCALED - 1:
                near = to[:, None] - back
                top = np.maximum(a[near].max(1, keepdims=True), 1e-300)
                a[near] /= top
                up[near] += np.log(top)
        b = np.zeros_like(a)
        b[shifted + self.size] = 1
        so_far = np.zeros(len(self.size))
        for t in range(steps - 1, -1, -1):
            at = self.live(t)
            to = at + word[at] + 1
            if t % RESCALED == RESCALED - 1:
                near = to[:, None] - back
                top = np.maximum(b[near].max(1), 1e-300)
                b[near] /= top[:, None]
                so_far[: len(at)] += np.log(top)
            down[to] = so_far[: len(at)]
            for k in range(1, min(t + 1, len(self.arcs)) + 1):
                b[to - k] += b[to] * prob[k - 1][at]
        end = shifted + self.size
        z, whole = np.maximum(a[end], 1e-300), up[end]
        out = np.zeros(n_pieces)
        to = np.arange(n) + word + 1
        for k, found in enumerate(self.arcs, 1):
            use = np.flatnonzero(found >= 0)
            w = word[use]
            scale = np.exp(np.minimum(up[to[use] - k] + down[to[use]] - whole[w], 600))
            out += np.bincount(found[use], weight[w] * a[to[use] - k] * b[to[use]] * prob[k - 1][use] / z[w] * scale, n_pieces)
        return out


class UnigramLanguages:
    """Languages, their shares and piece probabilities (scaled by SCALE for each byte of the piece)."""

    def __init__(self, path: str, languages: list[str], prior: np.ndarray):
        self.path, self.languages, self.prior = path, languages, prior
        keys = table(path)
        self.p = np.zeros((keys.n, len(languages)))

    def fit(self, words: list[dict[str, int]]) -> "UnigramLanguages":
        """words: for each language how often its sample has each word."""
        pieces = table(self.path)
        scale = SCALE ** np.array([len(b) for b in vocabulary(self.path)], float)
        for j, counts in enumerate(words):
            text = list(counts)
            data = np.frombuffer("".join(text).encode(), np.uint8)
            ends = np.cumsum([len(w.encode()) for w in text]).astype(np.int64)
            offs = np.concatenate(([0], ends)).astype(np.int64)
            number = np.array([counts[w] for w in text], float)
            parts = []
            for x, y in spans_of(offs, FIT_BYTES):
                buf, place, order = marked_words(data, offs[x:y], offs[x + 1 : y + 1])
                parts.append((Lattice(buf, place, pieces), number[x:y][order]))
            p = np.full(pieces.n, 1 / pieces.n)
            for _ in range(ROUNDS):
                c = sum((lattice.expected(p * scale, weight, pieces.n) for lattice, weight in parts), np.zeros(pieces.n))
                p = (c + 0.02) / (c.sum() + 0.02 * pieces.n)
            self.p[:, j] = p * scale
        return self

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language's number, posterior) of each text."""
        low = lowered(data)
        w = Words(low, offs, BY_SPACE)
        _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        buf, place, order = marked_words(low, w.start[first], w.end[first])
        lattice = Lattice(buf, place, table(self.path))
        by_word = np.empty((len(first), len(self.languages)))
        for j in range(0, len(self.languages), BLOCK):
            by_word[order, j : j + BLOCK] = lattice.forward(self.p[:, j : j + BLOCK])
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(by_word[back], 0)))
        score = total[w.first[1:]] - total[w.first[:-1]] + np.log(self.prior)
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
        best = post.argmax(1)
        return best, post[np.arange(len(best)), best]


def fit_languages(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> UnigramLanguages | None:
    """Fit on labelled rows; what docs holds decides which may be learnt from."""
    configure(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    share = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not share:
        return None
    per = max(1, min(per_language, SAMPLE_ROWS // len(share)))
    bounds = [(x, 2**63 - 1 if n <= 2 * per else int(2**64 * min(1.0, 2 * per / n)) - 2**63) for x, n in share.items()]
    bound = docs.sparkSession.createDataFrame(bounds, f"l {dict(docs.dtypes)[lang]}, bound long")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("long", "h", "id"))
    sized = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h"), (F.octet_length(text) > DOC_BYTES).alias("long"))
    few = sized.drop("text").join(F.broadcast(bound), "l").where("h <= bound").select("l", "long", "h", "id").distinct()
    sample = few.withColumn("r", rank).where(f"r <= {per} and (not long or r <= {LONG_DOCS})").select("id", "l", "long")
    taken = sized.drop("h").join(F.broadcast(sample), ["id", "l", "long"])

    def kernel(batch, data, offs):
        low = lowered(data)
        w = Words(low, offs, BY_SPACE)
        lang_of = batch.column("l").to_pylist()
        numbers = {x: k for k, x in enumerate(dict.fromkeys(lang_of))}
        owner = np.array([numbers[x] for x in lang_of], np.uint64)[w.doc]
        _, first, count = np.unique(w.hash ^ mixed(owner + U64(1)), return_index=True, return_counts=True)
        raw = low.tobytes()
        return {
            "l": pa.array([lang_of[w.doc[x]] for x in first.tolist()], pa.string()),
            "word": pa.array([raw[w.start[x] : w.end[x]].decode("utf-8", "replace") for x in first.tolist()], pa.string()),
            "n": pa.array(count.astype(np.int64)),
        }

    rows = text_map(taken, ["l"], "text", "l string, word string, n long", kernel).groupBy("l", "word").agg(F.sum("n").alias("n")).collect()  # of the sample
    languages = sorted(share)
    words: dict[str, dict[str, int]] = {x: {} for x in languages}
    for r in rows:
        words[r.l][r.word] = r.n
    prior = np.array([share[x] for x in languages], float)
    return UnigramLanguages(path, languages, prior / prior.sum()).fit([dict(sorted(words[x].items())) for x in languages])


def identified(docs: DataFrame, model: UnigramLanguages | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred and score of every whole text."""
    configure(docs.sparkSession)
    base, name, fields = carried(docs, keep, text, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times pieces, whatever the corpus

    def kernel(batch, data, offs):
        model, texts = shared.value, batch.column(name)
        letter = np.zeros(len(data) + 1, np.int64)
        np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122), out=letter[1:])
        some = letter[offs[1:]] > letter[offs[:-1]]
        for d in np.flatnonzero(~some & (np.diff(offs) > 0)).tolist():
            some[d] = any(c.isalpha() for c in texts[d].as_py())
        if model is None:
            some[:] = False
            best, score = np.zeros(len(some), int), np.zeros(len(some))
        else:
            best, score = model.predict(data, offs)
        names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0))], [*keep, "lang_pred", "score"])

    return text_map(base, base.columns, name, f"{fields}lang_pred string, score double", kernel)
