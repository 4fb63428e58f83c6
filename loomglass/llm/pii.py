"""Personal data: exact rules, and a character BiLSTM-CRF for spellings the rules don't know.

Rules give the base spans (kinds email, ip, card, phone). The model reads
overlapping windows of characters, a bidirectional LSTM scores the labels
(outside, and begin and inside of each kind) and CRF transitions pick the best
path. The windows' spans are reconciled over the whole text: pieces of one
kind that overlap are joined, then a heaviest set of spans that don't overlap
is kept by weighted interval scheduling. A model's span counts if it overlaps
no base span and still holds what its kind needs (an address with a domain,
four bytes, a card number that passes Luhn, 10 to 15 digits), whatever marks
stand between.

What a model's span needs is a digit, an "@" or an "at" in brackets, so windows
that hold none of them, nor a "dot" in brackets, are taken as all-outside and
are not run through the network.

The model is trained in numpy on at most TRAIN_DOCS documents of at most
TRAIN_BYTES whose base spans are the labels, partly respelt in ways the rules
don't match, and on made-up spans (MADE_UP of each kind) put into their texts.

Results: null and empty texts have no spans; offsets are code points, end
exclusive; repeated rows get equal results.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .carry import carried
from .common import configure, give_back

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_BYTES, TRAIN_STEPS, TRAIN_BATCH = 500, 1 << 16, 450, 64
MADE_UP = (500, 120, 120, 300)  # made-up spans of each kind, an address has the most spellings
WIDTH, STRIDE = 96, 64
HIDDEN, EMBED = 16, 10
N_LABELS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_GATE = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind. Each kind's leftmost matches that don't overlap; failing ones are dropped.

    An address is found from its "@": the run of local characters before it
    is where a leftmost match begins, so no run is scanned twice. An ip
    begins where a run of digits does, for the same reason.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _classes() -> np.ndarray:
    """Class of every code point below 256; higher ones share one."""
    own = "@.+-_()[]{}/%=:;,'\"!#$*&|<> \n\t"
    out = np.full(257, 2, np.int64)
    out[128:256] = 3
    out[256] = 4
    out[48:58] = 5
    out[65:91] = 6
    out[97:123] = 7 + np.arange(26)
    for k, c in enumerate(own):
        out[ord(c)] = 33 + k
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


def char_classes(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class SpanTagger:
    """Embedding, forward and backward LSTM, linear layer and CRF, with their gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"E": r.normal(0, 0.3, (N_CLASSES, e)), "O": r.normal(0, 0.2, (2 * h, N_LABELS)), "o": np.zeros(N_LABELS), "T": np.zeros((N_LABELS, N_LABELS)), "S": np.zeros(N_LABELS)}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.3, (e, 4 * h))
            self.p["U" + d] = r.normal(0, 0.2, (h, 4 * h))
            self.p["B" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.bar = np.zeros((N_LABELS, N_LABELS), np.float32)  # moves that no labelling has
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            for a in range(N_LABELS):
                if a not in (inside - 1, inside):
                    self.bar[a, inside] = -1e4
        self.start_bar = np.array([-1e4 if j and j % 2 == 0 else 0 for j in range(N_LABELS)], np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        h = HIDDEN
        pre = x @ self.p["W" + d] + self.p["B" + d]
        out = np.zeros((n, t, h), np.float32)
        hid, cell, trace = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = pre[:, i] + hid @ self.p["U" + d]
            s = _sigmoid(g[:, : 3 * h])
            u = np.tanh(g[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * u
            th = np.tanh(new)
            if keep:
                trace.append((i, s, u, cell, th, hid))
            cell, hid = new, s[:, 2 * h :] * th
            out[:, i] = hid
        return out, trace

    def _lstm_back(self, x, d, trace, dout, grad):
        h = HIDDEN
        n = len(x)
        dx = np.zeros_like(x)
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i, s, u, cell, th, before in reversed(trace):
            dh = dh + dout[:, i]
            dc = dc + dh * s[:, 2 * h :] * (1 - th * th)
            dg = np.concatenate([dc * u * s[:, :h] * (1 - s[:, :h]), dc * cell * s[:, h : 2 * h] * (1 - s[:, h : 2 * h]), dh * th * s[:, 2 * h :] * (1 - s[:, 2 * h :]), dc * s[:, :h] * (1 - u * u)], 1)
            grad["W" + d] += x[:, i].T @ dg
            grad["U" + d] += before.T @ dg
            grad["B" + d] += dg.sum(0)
            dx[:, i] = dg @ self.p["W" + d].T
            dh, dc = dg @ self.p["U" + d].T, dc * s[:, h : 2 * h]
        return dx

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids]
        f, tf = self._lstm(x, "f", keep)
        b, tb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], 2)
        e = both @ self.p["O"] + self.p["o"]
        return (e, x, both, tf, tb) if keep else e

    def step(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of a batch and its gradients."""
        e, x, both, tf, tb = self.emissions(ids, True)
        n, t, k = e.shape
        trans, start = self.p["T"] + self.bar, self.p["S"] + self.start_bar
        a, b = np.zeros_like(e), np.zeros_like(e)

        def lse(m, axis):
            top = m.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(m - top).sum(axis))

        a[:, 0] = start + e[:, 0]
        for i in range(1, t):
            a[:, i] = e[:, i] + lse(a[:, i - 1, :, None] + trans, 1)
        for i in range(t - 2, -1, -1):
            b[:, i] = lse(trans + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        m = np.exp(a + b - z[:, None, None])
        hot = np.eye(k, dtype=np.float32)[y]
        grad = {q: np.zeros_like(v) for q, v in self.p.items()}
        joint = np.zeros((k, k), np.float32)
        for i in range(t - 1):
            joint += np.exp(a[:, i, :, None] + trans + (e[:, i + 1] + b[:, i + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(joint, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grad["T"] = joint
        grad["S"] = (m[:, 0] - hot[:, 0]).sum(0)
        de = (m - hot).astype(np.float32)
        gold = (e * hot).sum() + trans[y[:, :-1], y[:, 1:]].sum() + start[y[:, 0]].sum()
        grad["O"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k)
        grad["o"] = de.sum((0, 1))
        dboth = de @ self.p["O"].T
        dx = self._lstm_back(x, "f", tf, dboth[:, :, :HIDDEN], grad) + self._lstm_back(x, "b", tb, dboth[:, :, HIDDEN:], grad)
        np.add.at(grad["E"], ids, dx)
        return float(z.sum() - gold) / n, {q: v / n for q, v in grad.items()}

    def fit(self, ids: np.ndarray, y: np.ndarray, steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, rate: float = 0.02, seed: int = 3) -> "SpanTagger":
        r = np.random.default_rng(seed)
        m, v = ({q: np.zeros_like(w) for q, w in self.p.items()} for _ in range(2))
        for k in range(1, steps + 1):
            pick = r.integers(0, len(ids), min(batch, len(ids)))
            _, g = self.step(ids[pick], y[pick])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            lr = rate * min(1.0, 2 * (1 - k / (steps + 1)))
            for q, w in self.p.items():
                w_g = g[q] * min(1.0, 5 / (norm + 1e-9))
                m[q] = 0.9 * m[q] + 0.1 * w_g
                v[q] = 0.99 * v[q] + 0.01 * w_g * w_g
                self.p[q] = (w - lr * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label path of each window, and how far each label's score is above that of outside."""
        e = self.emissions(ids)
        n, t, k = e.shape
        trans = self.p["T"] + self.bar
        best, back = self.p["S"] + self.start_bar + e[:, 0], np.zeros((n, t, k), np.int8)
        for i in range(1, t):
            m = best[:, :, None] + trans
            back[:, i] = m.argmax(1)
            best = m.max(1) + e[:, i]
        y = np.zeros((n, t), np.int64)
        y[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            y[:, i - 1] = back[np.arange(n), i, y[:, i]]
        return y, np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] - e[:, :, 0]


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) kept out of the windows' (start, end, kind, weight) spans of one text."""
    joined: list[list] = []
    for s, e, k, w in sorted(found, key=lambda f: (f[2], f[0], f[1])):
        if joined and joined[-1][2] == k and s < joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
            joined[-1][3] = max(w, joined[-1][3])
        else:
            joined.append([s, e, k, w])
    joined.sort(key=lambda f: f[1])
    ends = [f[1] for f in joined]
    total, take = [0.0], []
    for i, (s, _, _, w) in enumerate(joined):
        before = int(np.searchsorted(ends[:i], s, "right"))
        take.append(total[before] + w > total[i])
        total.append(max(total[i], total[before] + w))
    out, i = [], len(joined)
    while i:
        i -= 1
        if take[i]:
            s, e, k, _ = joined[i]
            out.append((s, k, e))
            i = int(np.searchsorted(ends[:i], s, "right"))
    return sorted(out)


def holds(kind: int, span: str) -> bool:
    """What a model's span must still have."""
    digits = _DIGITS.sub("", span)
    if kind == 0:
        return bool(re.fullmatch(r"\S+\s?(?:@|[\[({]\s?at\s?[\])}])\s?[\w-]+(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[\w-]+)+", span))
    if kind == 1:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and len(span) <= 2 * len(digits) and not re.search(r"[^\W\d_]", span)
    return 10 <= len(digits) <= 15 and len(span) <= 2 * len(digits) and not re.search(r"[^\W\d_]", span) and not re.fullmatch(r"[0-9]+", span)


def anchored_windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an "@", or an "at" or "dot" in brackets."""
    out: list[int] = []
    for m in _GATE.finditer(text):
        last = m.start() // STRIDE
        for w in range(max(0, last - (WIDTH - 1) // STRIDE), last + 1):
            if w * STRIDE <= m.start() < w * STRIDE + WIDTH and (not out or w * STRIDE > out[-1]):
                out.append(w * STRIDE)
    return out


def model_spans(model: SpanTagger, texts: list[str], at_once: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans that the model finds in each text."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in anchored_windows(t)]
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(jobs), at_once):
        part = jobs[k : k + at_once]
        ids = np.zeros((len(part), WIDTH), np.int64)
        for row, (i, s) in enumerate(part):
            c = char_classes(texts[i][s : s + WIDTH])
            ids[row, : len(c)] = c
        y, gain = model.decode(ids)
        for row in np.flatnonzero((y > 0).any(1)).tolist():
            i, s = part[row]
            labels, n = y[row].tolist(), min(WIDTH, len(texts[i]) - s)
            t = 0
            while t < n:
                if labels[t] % 2 == 1:
                    e = t + 1
                    while e < n and labels[e] == labels[t] + 1:
                        e += 1
                    found[i].append((s + t, s + e, labels[t] // 2, max(float(gain[row, t:e].sum()), 1e-3)))
                    t = e
                else:
                    t += 1
    return [reconciled(f) if f else [] for f in found]


def all_spans(model: SpanTagger | None, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, by model) of each text, base spans first decided."""
    base = [base_spans(t) for t in texts]
    extra = model_spans(model, texts) if model else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, extra):
        rows = [(*s, False) for s in own]
        for s, k, e in more:
            while s < e and not (text[s].isalnum() or text[s] in "+(["):
                s += 1
            while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")]"):
                e -= 1
            if s < e and not any(s < b and a < e for a, _, b in own) and holds(k, text[s:e]):
                rows.append((s, k, e, True))
        out.append(sorted(rows))
    return out


def _respelt(r: np.random.Generator, kind: int, span: str) -> str:
    """Another way to write a span, in a spelling the rules don't match, or the same."""
    if r.random() < 0.4:
        return span
    digits = _DIGITS.sub("", span)
    mark = str(r.choice([".", "/", " - ", "_", " . "]))
    if kind == 0:
        local, _, domain = span.partition("@")
        dot = str(r.choice([".", ".", " [dot] ", " (dot) ", "[dot]", "(dot)", "{dot}"]))
        return (local if r.random() < 0.8 else local.replace(".", dot)) + str(r.choice([" @ ", " (at) ", "(at)", "[at]", " [at] ", "{at}", " @"])) + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", str(r.choice([" . ", "-", ":", ". "])))
    if kind == 2:
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return f"({digits[-10:-7]}) {digits[-7:-4]}{mark}{digits[-4:]}" if r.random() < 0.5 else mark.join((digits[-10:-7], digits[-7:-4], digits[-4:]))


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: around base spans (some respelt), around other digits, and made-up spans of kinds that lack some."""
    r = np.random.default_rng(seed)
    ids, labels = [], []

    def add(left: str, span: str, kind: int, right: str) -> None:
        a = left[-int(r.integers(4, 60)) :]
        c = char_classes((a + span + right)[:WIDTH])
        y = np.zeros(WIDTH, np.int64)
        row = np.zeros(WIDTH, np.int64)
        row[: len(c)] = c
        if kind >= 0:
            y[len(a) : len(a) + len(span)] = 2 + 2 * kind
            y[len(a)] = 1 + 2 * kind
        ids.append(row)
        labels.append(y)

    count = [0] * len(KINDS)
    plain = []
    for t in texts:
        spans = base_spans(t)
        for n, (s, k, e) in enumerate(spans):
            before = spans[n - 1][2] if n else 0
            after = spans[n + 1][0] if n + 1 < len(spans) else len(t)
            if before <= s and e <= after and e - s < 40:
                count[k] += 1
                for _ in range(3):
                    add(t[max(before, s - 60) : s], _respelt(r, k, t[s:e]), k, t[e:after][:WIDTH])
        for m in _ANCHOR.finditer(t):
            if not any(a - 2 <= m.start() < b + 2 for a, _, b in spans):
                left, right = max((b for _, _, b in spans if b <= m.start()), default=0), min((a for a, _, _ in spans if a > m.start()), default=len(t))
                add(t[max(left, m.start() - 60) : m.start()], "", -1, t[m.start() : right][:WIDTH])
        if len(t) > 150:
            plain.append(t)
    plain = plain or ["word " * 60]
    for k in range(len(KINDS)):
        for _ in range(max(MADE_UP[k] // 2, MADE_UP[k] - count[k])):
            t = str(plain[int(r.integers(len(plain)))])
            at = int(r.integers(60, max(61, len(t) - 80)))
            add(t[max(0, at - 60) : at] + " ", _respelt(r, k, _made_up(r, k)), k, " " + t[at : at + WIDTH])
    for _ in range(200):
        t = str(plain[int(r.integers(len(plain)))])
        at = int(r.integers(60, max(61, len(t) - 80)))
        fake = "".join(r.choice(list("0123456789abcdef"), int(r.integers(3, 40)))) if r.random() < 0.5 else f"{r.integers(1, 99)}.{r.integers(0, 99)}"
        add(t[max(0, at - 60) : at] + " ", "", -1, fake + " " + t[at : at + WIDTH])
    return np.array(ids), np.array(labels)


def _made_up(r: np.random.Generator, kind: int) -> str:
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), "".join(map(str, r.integers(0, 10, 16)))
    if kind == 0:
        first, last, host = ("".join(r.choice(letters, int(r.integers(2, 10)))) for _ in range(3))
        local = first + str(r.choice(["", ".", "_", "-", "."])) + (last if r.random() < 0.8 else digits[:2])
        return f"{local}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'])}"
    if kind == 1:
        return ".".join(map(str, r.integers(1, 256, 4)))
    if kind == 2:
        return digits[:15] + next(str(d) for d in range(10) if luhn(digits[:15] + str(d)))
    return f"+{digits[0]} ({digits[1:4]}) {digits[4:7]}-{digits[7:11]}"


def fit_tagger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> SpanTagger:
    """Train on the at most train_docs documents with a digit or "@" of at most TRAIN_BYTES whose ids have the smallest hashes."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]") & F.col("id").isNotNull() & (F.octet_length("t") <= TRAIN_BYTES))
    # ids first, so that no task sends texts for the choice; the marked rows are train_docs ids, so they may be broadcast
    chosen = rows.select("id", F.xxhash64("id").alias("h"), F.xxhash64("t").alias("k")).orderBy("h", "id", "k").limit(train_docs).select("id", "k").distinct()
    marked = rows.withColumn("k", F.xxhash64("t")).join(F.broadcast(chosen), ["id", "k"]).dropDuplicates(["id", "k"])
    rows = sorted(marked.select("id", "k", "t").collect(), key=lambda r: (r.id, r.k))
    return SpanTagger().fit(*training_windows([r.t for r in rows]))


def spotted(docs: DataFrame, model: SpanTagger | None, keep: list[str], text: str = "text", redact: bool = False) -> DataFrame:
    """keep and pii (kind, start, end, by_model of each span, by start, then kind as listed in KINDS).

    With redact there is also clean: the text with every span replaced by its kind in brackets.
    """
    configure(docs.sparkSession)
    base, name, fields = carried(docs, keep, text, ["pii", "clean"])
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_model", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in batches:
            raw = batch.column(name).to_pylist()
            texts = [x or "" for x in raw]
            spans = all_spans(shared.value, texts)
            columns = [*(batch.column(c) for c in keep), pa.array([[{"kind": KINDS[k], "start": s, "end": e, "by_model": m} for s, k, e, m in x] for x in spans], shape)]
            names = [*keep, "pii"]
            if redact:
                columns.append(pa.array([y if y is None else redacted(y, x) for x, y in zip(spans, raw)], pa.string()))
                names.append("clean")
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return base.mapInArrow(run, f"{fields}pii array<struct<kind:string,start:bigint,end:bigint,by_model:boolean>>" + (", clean string" if redact else ""))


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of the first one's kind."""
    out, at = [], 0
    for s, k, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
