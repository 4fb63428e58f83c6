"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad. A line's features are shares of
character kinds, word statistics and repetition, next to the same features of
the lines before and after it; transitions tie neighbouring lines together.
Forward-backward marginals, weighted by the lines' lengths, give a document's
share of good text, which a fitted two-parameter logistic curve maps to a
score.

Documents are labelled, lines are not: what a line is, is latent. A document
labelled good has good lines; one labelled bad has a LEAST_BAD share of bad
text at least, wherever it stands. The field is fitted by expectation and
maximisation. It starts from a field of lines on their own, without neighbours
or transitions, that takes each line for what its document is called: clean
lines are far more often in good documents, so it finds them good. Then each
document's forward-backward posterior, tilted by the smallest multiplier under
which its length-weighted share meets that constraint, says what its lines are
(so good lines of bad documents become good), and the weights are fitted to
those expected labels and transitions. Features are of a line and its
neighbours only, so that a document can hold good and bad stretches.

It is fitted on at most TRAIN_DOCS labelled documents (those with the smallest
hashes of their ids) of at most DOC_LINES lines; longer ones are scored like
all others, but not learnt from.

Results: a null or empty text counts as one empty line and gets a score too;
repeated rows get equal scores; without any labelled row every score is 0.5.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .carry import carried
from .common import BY_SPACE, Words, configure, text_map

TRAIN_DOCS, DOC_LINES = 3000, 100
LEAST_BAD, EM_ROUNDS = 0.3, 4
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4)


def _kinds() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # other symbols
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f\n", b".,;:'\"?-()")):
        kind[list(chars)] = k
    kind[128:] = 6
    return kind


KIND = _kinds()
BASE = 15
OWN = BASE + len(STEPS) * 4
WIDTH = 1 + 3 * OWN + 1


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document, length) of every line of a chunk; an empty document has one empty line."""
    n_docs = len(offs) - 1
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([offs[:-1], breaks]))
    empty = np.flatnonzero(np.diff(offs) == 0)
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offs, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    if len(empty):
        order = np.argsort(np.concatenate([doc, empty]), kind="stable")
        doc = np.concatenate([doc, empty])[order]
        starts = np.concatenate([starts, offs[empty]])[order]
        ends = np.concatenate([ends, offs[empty]])[order]
    n = len(starts)
    size = ends - starts
    kind = KIND[data]
    share = np.zeros((7, n))
    for k in range(7):
        total = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))
        share[k] = total[ends] - total[starts]
    w = Words(data, offs, BY_SPACE)
    line = np.searchsorted(starts, w.start, "right") - 1 if n else w.start
    words = np.bincount(line, minlength=n)
    key = np.unique(w.hash * np.uint64(0x9E3779B97F4A7C15) ^ line.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), return_index=True)[1]
    distinct = np.bincount(line[key], minlength=n)
    total = np.concatenate(([np.uint64(0)], np.cumsum(w.hash)))
    first = np.searchsorted(line, np.arange(n + 1))
    body = (total[first[1:]] - total[first[:-1]]) ^ doc.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    _, back, seen = np.unique(body, return_inverse=True, return_counts=True)
    upper_start = np.bincount(line, weights=(KIND[data[w.start]] == 1) if len(w.start) else None, minlength=n) if len(line) else np.zeros(n)
    symbol_end = np.bincount(line, weights=np.isin(KIND[data[w.end - 1]], (4, 5)) if len(w.end) else None, minlength=n) if len(line) else np.zeros(n)
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])) + 1
    stutter = np.bincount(line[again], minlength=n)
    full = np.maximum(size, 1)
    per_word = np.maximum(words, 1)
    symbols, capitals, digits = share[5] / full, share[1] / full, share[2] / full
    base = np.stack([
        share[0] / full, capitals, digits, share[3] / full, share[4] / full, symbols, share[6] / full,
        np.log1p(size) / 8, np.log1p(words) / 6, distinct / per_word, np.minimum((full - share[3]) / per_word / 10, 3),
        upper_start / per_word, symbol_end / per_word, np.log1p(seen[back] - 1) if n else np.zeros(0), stutter / per_word,
    ])
    steps = np.stack([r > t for r in (symbols, capitals, symbol_end / per_word, stutter / per_word) for t in STEPS])
    own = np.concatenate([base, steps]).T
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    k = own.shape[1]
    out[:, 1 : 1 + k] = own
    same = doc[1:] == doc[:-1]
    out[1:, 1 + k : 1 + 2 * k][same] = own[:-1][same]
    out[:-1, 1 + 2 * k : 1 + 3 * k][same] = own[1:][same]
    alike = np.zeros(n, bool)
    alike[1:] = same & (body[1:] == body[:-1])
    out[:, -1] = alike
    return out, doc, size


class LineField:
    """Two-state linear-chain CRF: emission weights for "good", a start weight and a 2x2 transition table."""

    def __init__(self, width: int):
        self.w, self.t, self.s = np.zeros(width), np.zeros((2, 2)), np.zeros(2)
        self.curve = (1.0, 0.0)

    @staticmethod
    def _layout(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first line, lines) of each document that occurs, longest first."""
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(doc)))
        order = np.argsort(-count, kind="stable")
        return first[order], count[order]

    def marginals(self, x: np.ndarray, doc: np.ndarray, pairs: bool = False, tilt: np.ndarray | float = 0.0):
        """P(good) of each line; with pairs also expected transition and start counts and the log-partition sum. tilt is added to the lines' scores of being good."""
        first, count = self._layout(doc)
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ self.w + tilt
        a, b = np.zeros_like(e), np.zeros_like(e)
        steps = int(count[0]) if len(count) else 0
        for t in range(steps):
            at = first[: np.searchsorted(-count, -t, "left")] + t
            a[at] = e[at] + (self.s if t == 0 else np.logaddexp(a[at - 1, :1] + self.t[0], a[at - 1, 1:] + self.t[1]))
        for t in range(steps - 2, -1, -1):
            at = first[: np.searchsorted(-count, -(t + 1), "left")] + t
            m = e[at + 1] + b[at + 1]
            b[at] = np.logaddexp(m[:, :1] + self.t[:, 0], m[:, 1:] + self.t[:, 1])
        g = a + b
        z = np.logaddexp(g[:, 0], g[:, 1])
        good = np.exp(g[:, 1] - z)
        if not pairs:
            return good
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        joint = a[inner][:, :, None] + self.t[None] + (e + b)[inner + 1][:, None, :] - z[inner][:, None, None]
        return good, np.exp(joint).sum(0), np.array([(1 - good[first]).sum(), good[first].sum()]), z[first].sum()

    def fit(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.08, ridge: float = 1e-4) -> "LineField":
        """Expectation-maximisation over the lines' latent labels; then the curve on documents."""
        x, y = x.astype(float), label[doc].astype(float)
        alone = x.copy()
        alone[:, 1 + OWN :] = 0
        self._climb(alone, np.arange(len(doc)), y, np.zeros((2, 2)), np.array([(1 - y).sum(), y.sum()]), rounds, rate, ridge)
        self.w[0] += self.s[1] - self.s[0]
        self.s = np.zeros(2)
        for _ in range(EM_ROUNDS):
            y, seen, starts = self.expected(x, doc, size, label)
            self._climb(x, doc, y, seen, starts, rounds // 2, rate / 2, ridge)
        share = self.share(x, doc, size, len(label))
        z, c, d = np.log(share / (1 - share)), 1.0, 0.0
        for _ in range(200):  # Newton steps with a small ridge
            q = 1 / (1 + np.exp(-np.clip(c * z + d, -30, 30)))
            g = np.array([((q - label) * z).sum() + c - 1, (q - label).sum()])
            h = np.array([[(q * (1 - q) * z * z).sum() + 1, (q * (1 - q) * z).sum()], [(q * (1 - q) * z).sum(), (q * (1 - q)).sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            c, d = c - np.clip(step[0], -1, 1), d - np.clip(step[1], -1, 1)
        self.curve = (float(max(c, 1e-3)), float(d))
        return self

    def _climb(self, x, doc, y, seen, starts, rounds, rate, ridge) -> None:
        """Full-batch Adam towards expected labels y, transitions and starts."""
        m, v = np.zeros(len(self.w) + 6), np.zeros(len(self.w) + 6)
        for k in range(1, rounds + 1):
            good, pair, start, _ = self.marginals(x, doc, True)
            g = np.concatenate([x.T @ (good - y), (pair - seen).ravel(), start - starts]) / len(y)
            p = np.concatenate([self.w, self.t.ravel(), self.s])
            g += ridge * p
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
            self.w, self.t, self.s = p[: len(self.w)], p[len(self.w) : -2].reshape(2, 2), p[-2:]

    def expected(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray):
        """(P(good) of each line, transition counts, start counts) given the documents' labels.

        Lines of good documents are good. A bad document's posterior is tilted
        by the smallest multiplier, found by bisection, with which a LEAST_BAD
        share of its text is bad.
        """
        weight = np.maximum(size, 1) / np.maximum(np.bincount(doc, np.maximum(size, 1), len(label)), 1)[doc]
        per_line = weight * np.bincount(doc, minlength=len(label))[doc]
        bad = label == 0
        low, high = np.zeros(len(label)), np.full(len(label), 40.0)
        met = bad & (np.bincount(doc, self.marginals(x, doc) * weight, len(label)) <= 1 - LEAST_BAD)
        high[met] = 0
        for _ in range(10):
            middle = (low + high) / 2
            ok = np.bincount(doc, self.marginals(x, doc, tilt=-middle[doc] * per_line) * weight, len(label)) <= 1 - LEAST_BAD
            low, high = np.where(ok, low, middle), np.where(ok, middle, high)
        tilt = np.where(bad[doc], -high[doc] * per_line, 60.0)
        good, pair, start, _ = self.marginals(x, doc, True, tilt)
        return good, pair, start

    def share(self, x, doc, size, n_docs) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, kept off 0 and 1."""
        weight = np.maximum(size, 1).astype(float)
        good = np.bincount(doc, self.marginals(x, doc) * weight, n_docs) / np.maximum(np.bincount(doc, weight, n_docs), 1e-9)
        return np.clip(good, 1e-6, 1 - 1e-6)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, doc, size = line_features(data, offs)
        share = self.share(x, doc, size, len(offs) - 1)
        c, d = self.curve
        return 1 / (1 + np.exp(-np.clip(c * np.log(share / (1 - share)) + d, -30, 30)))


def fit_lines(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> LineField | None:
    """Fit on at most train_docs documents that have a label; labels decides which rows may be learnt from."""
    configure(docs.sparkSession)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("__y"))
    rows = rows.orderBy(F.xxhash64(doc_id), doc_id).limit(train_docs)  # bounded, so it may be broadcast

    def kernel(batch, data, offs):
        x, doc, size = line_features(data, offs)
        cut = np.searchsorted(doc, np.arange(len(offs)))
        some = np.flatnonzero(np.diff(cut) <= DOC_LINES)
        part = lambda v: pa.array([v[cut[k] : cut[k + 1]].tobytes() for k in some.tolist()], pa.binary())
        return {"id": batch.column("id").take(pa.array(some)), "y": batch.column("y").cast(pa.int32()).take(pa.array(some)), "x": part(x), "size": part(size)}

    taken = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(rows.withColumnRenamed(doc_id, "id")), "id").withColumnRenamed("__y", "y")
    got = text_map(taken, ["id", "y"], "text", f"id {dict(taken.dtypes)['id']}, y int, x binary, size binary", kernel).toPandas().sort_values(["id", "x"], kind="stable")
    if got.empty:
        return None
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    doc = np.repeat(np.arange(len(x)), [len(a) for a in x])
    size = np.concatenate([np.frombuffer(b, np.int64) for b in got["size"]])
    return LineField(WIDTH).fit(np.concatenate(x), doc, size, got["y"].to_numpy())


def scored(docs: DataFrame, field: LineField | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep and score, the probability-like quality of every whole text."""
    configure(docs.sparkSession)
    base, name, fields = carried(docs, keep, text, ["score"])

    def kernel(batch, data, offs):
        score = field.score(data, offs) if field else np.full(len(offs) - 1, 0.5)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    return text_map(base, base.columns, name, f"{fields}score double", kernel)
