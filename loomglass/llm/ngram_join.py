"""Jaccard self-join of documents' word n-gram sets by several global token orders.

A document's set holds the hashes of its distinct n-grams; documents with one
set are one node from the start. For a threshold t, two sets of that
similarity share a token among the first n - ceil(t n) + 1 of each under any
global order. Three orders are used, each a random permutation of its own:

1. Under the first order, rare tokens come before frequent ones. Nodes that
   share a prefix token meet in that token's bucket, subject to the length
   bound; buckets with the same members count once. This gives the candidates.
2. Of those, pairs must share prefix tokens under the second and the third
   order as well: the filters are intersected.
3. Survivors are verified on the whole sets.

How frequent tokens are is counted over all documents, for the tokens that the
permutation puts first (a SHARE of all, twice what a prefix takes). Tokens met
once come first, those met seldom next, then the ones not counted, and
frequent ones last. Which of the tokens not counted are frequent is counted
where prefixes hold them. What was counted is kept in bitmaps of at least
BITS_PER_KEY bits a key (an eighth of that for tokens met twice), as large as
the counts ask for and of MOST_BITS at most; where there are more
keys than that, only the more frequent ones are kept (the bound on the count
is raised in powers of two). Any bitmap gives a global order, so they touch
speed only.

Only connectivity is asked for, so a pair whose nodes are known to be connected
is not verified: each node's first candidate goes first.

A bucket of more than BUCKET nodes is not enumerated. Its nodes are rewritten
relative to a reference set, as what they add to it and what they lack of it;
the reference is what at least two of three central members hold. Let d be the
size of such a difference. Nodes x and y are similar if their differences
differ in at most D = (|x| + |y|) (1 - t) / (1 + t) elements, so

* if d_x + d_y <= D they are similar. With s_z = |z| (1 - t) / (1 + t) - d_z
  that is s_x + s_y >= 0. So both are, by the same sum, similar to the node
  with the largest s: links to this one node connect them all, and no pair of
  two such nodes is followed further;
* else they share at least (d_x + d_y - D) / 2 elements of their differences,
  and prefix filters apply again: D/2 + 1 elements of the smaller difference
  against D + 1 of the larger one, less where the sizes of both ask for more
  overlap, added elements before lacking ones. Among copies with edits, edits
  are rare where the text they share is not.

Buckets that come out large again are rewritten for another reference, which
takes away what most of their nodes share; what is left after REBASES rounds
is enumerated, so no link is lost.

Results: null and empty texts have an empty set and link with nothing; repeated
rows share their component; rows with a null id get a null component_id unless
linked to others, and never name one. Hash collisions (52 bits a token, 64 bits
a set) are taken as equality.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BY_SPACE, DOC_BITS, U64, Bitmap, Words, arrow_rows, components, configure, distinct_tokens, dropped, ids_of, mixed, release, sequence_hash, settled, text_map

N, NUMERATOR, DENOMINATOR = 3, 90, 100
BUCKET, SHARE, PER_ROW, REBASES = 16, 0.2, 64, 12
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 18, 1 << 28
#: References of large buckets that may be broadcast.
BASE_BYTES = 16 << 20
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F)
WIDTH = 64 - DOC_BITS


class Rarity:
    """Classes of tokens under the first order: 0 counted and met once, 1 seldom, 2 not counted, 3 met often."""

    def __init__(self, twice: Bitmap | None = None, often: Bitmap | None = None):
        self.twice, self.often = twice, often

    def classes(self, token: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.full(len(token), 2, U64)
        if self.twice is None:
            return out
        first = np.flatnonzero(key < U64(int(SHARE * 2**64)))
        out[first] = np.where(self.often.has(token[first]), 3, self.twice.has(token[first]))
        return out


def fitted_bits(keys: int, per_key: int | None = None) -> int:
    """log2 of the bits that a bitmap of so many keys gets."""
    return max(LEAST_BITS, min(MOST_BITS, 2 * (per_key or BITS_PER_KEY) * keys)).bit_length() - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct tokens of all documents one after another, bounds of each document's)."""
    w = Words(data, offs, BY_SPACE)
    h, at = w.shingles(n)
    doc = w.doc[at]
    count = np.diff(w.first)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            h = np.concatenate([h, sequence_hash(w.hash, w.first[few], k)])
            doc = np.concatenate([doc, few])
    return distinct_tokens(doc, h, len(offs) - 1)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n + (-num * n) // den + 1, 0)  # n - ceil(t n) + 1


def prefixes(token: np.ndarray, bound: np.ndarray, seed: int, rarity: Rarity | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix tokens of all documents, bounds) under one order."""
    n = np.diff(bound)
    doc = np.repeat(np.arange(len(n)), n)
    key = mixed(token ^ U64(seed))
    rank = rarity.classes(token, key) if rarity else np.zeros(len(token), U64)
    order = np.argsort(doc.astype(U64) << U64(WIDTH) | rank << U64(WIDTH - 2) | key >> U64(DOC_BITS + 2))
    take = prefix_length(n, num, den)
    keep = np.arange(len(token)) - np.repeat(bound[:-1], n) < np.repeat(take, n)
    return token[order[keep]], np.concatenate(([0], np.cumsum(take)))


def _signatures(token: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names for each set; 0 and 0 for the empty one."""
    n = np.diff(bound)
    names = []
    for s in (0xA54FF53A5F1D36F1, 0x510E527FADE682D1):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed(token ^ U64(s)))))
        name = mixed(total[bound[1:]] - total[bound[:-1]] + n.astype(U64))
        names.append(np.where(n > 0, np.where(name == 0, U64(1), name), U64(0)))
    return names[0], names[1]


def _cut(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    raw, size = values.tobytes(), values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.array([raw[size * a : size * b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())


def packed(token: np.ndarray) -> np.ndarray:
    """Tokens as five bytes each: their upper 40 bits, in the same order."""
    return np.ascontiguousarray((token >> U64(WIDTH - 40)).view(np.uint8).reshape(-1, 8)[:, :5])


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(U64).ravel() << U64(WIDTH - 40)


class NgramJoin:
    """One self-join; components() gives the result and the parts stay readable on their own."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR, bucket: int = BUCKET):
        self.spark = docs.sparkSession
        configure(self.spark)
        self.docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.id_type = dict(self.docs.dtypes)["id"]
        self.n, self.num, self.den, self.bucket = n, num, den, bucket

    def rarity(self):
        """Counts of tokens over all documents, as the bitmaps of an order; broadcast, as their size is bounded."""
        n = self.n

        def kernel(batch, data, offs):
            token, bound = shingle_sets(data, offs, n)
            _, first = np.unique(_signatures(token, bound)[0], return_index=True)  # copies within the chunk count once
            once = np.zeros(len(offs) - 1, bool)
            once[first] = True
            token = token[np.repeat(once, np.diff(bound))]
            token, count = np.unique(token[mixed(token ^ U64(SEEDS[0])) < U64(int(SHARE * 2**64))], return_counts=True)
            return {"token": ids_of(token), "count": count.astype(np.int64)}

        rows = text_map(self.docs, [], "text", "token long, count long", kernel)
        counts = settled(rows.groupBy("token").agg(F.sum("count").alias("m")).where("m > 1"), "counts")
        classes = {r.p: r.c for r in counts.groupBy(F.floor(F.log2("m")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()}  # 63 rows at most
        bitmaps = []
        for least, per_key in ((2, BITS_PER_KEY // 8), (self.bucket + 1, BITS_PER_KEY)):
            inside = lambda m: sum(c for p, c in classes.items() if 2 << p > m)  # noqa: E731  tokens with a count of m or more, or a few more
            while per_key * inside(least) > MOST_BITS:
                least *= 2
            bitmaps.append(Bitmap(counts.where(F.col("m") >= least), "token", fitted_bits(inside(least), per_key), WIDTH))
        dropped(self.spark, counts)
        release(self.spark)
        return self.spark.sparkContext.broadcast(Rarity(*bitmaps))

    def nodes(self, rarity) -> tuple[DataFrame, DataFrame]:
        """(id, n, one, two of every row; node, one, two, n, prefix of every distinct set). A node is a number; one and two name its set."""
        n, num, den = self.n, self.num, self.den

        def kernel(batch, data, offs):
            h, bound = shingle_sets(data, offs, n)
            tokens, cut = prefixes(h, bound, SEEDS[0], rarity.value, num, den)
            one, two = _signatures(h, bound)
            return {"id": batch.column("id"), "n": np.diff(bound).astype(np.int64), "one": ids_of(one), "two": ids_of(two), "prefix": _cut(tokens, cut)}

        wide = settled(text_map(self.docs, ["id"], "text", f"id {self.id_type}, n long, one long, two long, prefix binary", kernel), "wide")
        distinct = wide.where("n > 0").groupBy("one", "two").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        nodes = settled(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # short numbers make small shuffles
        rows = settled(wide.select("id", "n", "one", "two"), "rows")
        dropped(self.spark, wide)
        return rows, nodes

    def candidates(self, nodes: DataFrame, rarity) -> tuple[DataFrame, DataFrame]:
        """(a, b) pairs of small buckets; (token, node, n) rows of large ones."""
        bucket, num, den = self.bucket, self.num, self.den

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                prefix = b.column("prefix").to_pylist()
                size = np.array([len(p) // 8 for p in prefix], np.int64)
                token = np.frombuffer(b"".join(prefix), U64)
                rank = rarity.value.classes(token, mixed(token ^ U64(SEEDS[0])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_of(token)), pa.array(np.repeat(b.column("node").to_numpy(), size)), pa.array(np.repeat(b.column("n").to_numpy(), size)), pa.array(rank == 3), pa.array(rank == 2)], ["token", "node", "n", "hot", "late"]
                )

        rows = settled(nodes.select("node", "n", "prefix").mapInArrow(tokens, "token long, node long, n long, hot boolean, late boolean"), "tokens")
        # frequent ones among the tokens that were not counted
        plain, late = (rows.where(x).select("token", "node", "n") for x in ("not hot and not late", "late"))
        many = settled(late.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > bucket).select("token"), "late")
        hot = rows.where("hot").select("token", "node", "n").union(late.join(many, "token", "left_semi"))

        def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sorted rows in; a row for each bucket of 2 to `bucket` nodes, or for each row of a larger one."""
            rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
            large: int | None = None  # a token whose bucket is already known to be large
            for b in _and_none(batches):
                if b is not None:
                    rest = tuple(np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(rest, ("token", "node", "n")))
                token, node, n = rest
                if not len(token):
                    continue
                first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                size = np.diff(np.append(first, len(token)))
                if b is not None:  # the last bucket may go on
                    if size[-1] <= bucket:
                        first, size, keep = first[:-1], size[:-1], first[-1]
                    else:
                        keep = len(token)
                else:
                    keep = len(token)
                big = size > bucket
                if large is not None and len(first) and token[first[0]] == large:
                    big[0] = True
                large = int(token[first[-1]]) if len(big) and big[-1] else None
                rest = tuple(x[keep:] for x in rest)
                if large is not None and len(rest[0]) and rest[0][0] != large:
                    large = None
                small = np.flatnonzero(~big & (size > 1))
                member = np.repeat(first[small] - np.concatenate(([0], np.cumsum(size[small])))[:-1], size[small]) + np.arange(int(size[small].sum()))
                cut = pa.array(np.concatenate(([0], np.cumsum(size[small]))).astype(np.int32))
                wide = np.flatnonzero(np.repeat(big, size))
                k = len(small)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(token[wide])]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(node[wide])]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(n[wide])]),
                        pa.concat_arrays([pa.ListArray.from_arrays(cut, pa.array(node[member])), pa.nulls(len(wide), pa.list_(pa.int64()))]), pa.concat_arrays([pa.ListArray.from_arrays(cut, pa.array(n[member])), pa.nulls(len(wide), pa.list_(pa.int64()))]),
                    ],
                    ["token", "node", "n", "nodes", "sizes"],
                )

        cold = plain.union(late.join(many, "token", "left_anti"))
        parted = cold.repartition("token").sortWithinPartitions("token", "node").mapInArrow(buckets, "token long, node long, n long, nodes array<long>, sizes array<long>")
        with arrow_rows(self.spark, 1 << 15):
            met = settled(parted, "buckets")
        small = met.where("nodes is not null").select("nodes", "sizes").dropDuplicates(["nodes"])
        pair = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: F.struct(
            F.get("nodes", j).alias("a"), F.get("nodes", i).alias("b"), F.least(F.get("sizes", i), F.get("sizes", j)).alias("x"), F.greatest(F.get("sizes", i), F.get("sizes", j)).alias("y"))))))
        pairs = small.select(pair.alias("p")).select("p.*").where(f"x * {den} >= y * {num}").select("a", "b").distinct()
        large = met.where("nodes is null").select("token", "node", "n").union(hot)
        out = settled(pairs, "pairs"), settled(self.once(large), "large")
        dropped(self.spark, rows, met, many)
        release(self.spark)
        return out

    @staticmethod
    def once(large: DataFrame) -> DataFrame:
        """Buckets of several nodes, one of those with the same members."""
        seen = large.groupBy("token").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).where("m > 1")
        return large.join(seen.groupBy("m", "s", "x").agg(F.min("token").alias("token")).select("token"), "token")

    def sets(self, pairs: DataFrame, large: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, prefixes under the second and third order, whole set) of every node that is in a candidate pair or large bucket."""
        n, num, den = self.n, self.num, self.den
        met = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
        asked = settled(nodes.select("node", "one", "two").join(met, "node", "left_semi"), "asked")
        wanted = Bitmap(asked, "one", fitted_bits(asked.count()))

        def kernel(batch, data, offs):
            token, bound = shingle_sets(data, offs, n)
            one, other = _signatures(token, bound)
            keep = np.flatnonzero(wanted.has(one) & (one != 0))
            keep = keep[np.unique(np.stack([one[keep], other[keep]], 1), axis=0, return_index=True)[1]]
            two, cut2 = prefixes(token, bound, SEEDS[1], None, num, den)
            three, cut3 = prefixes(token, bound, SEEDS[2], None, num, den)
            # equal tokens have equal lower halves, so filters on those lose nothing
            columns = {"second": _cut(two.astype(np.uint32), cut2), "third": _cut(three.astype(np.uint32), cut3), "whole": _cut(packed(token), bound)}
            return {"one": ids_of(one[keep]), "two": ids_of(other[keep])} | {k: v.take(pa.array(keep)) for k, v in columns.items()}

        raw = text_map(self.docs, [], "text", "one long, two long, second binary, third binary, whole binary", kernel)
        out = settled(raw.join(asked, ["one", "two"]).drop("one", "two").dropDuplicates(["node"]), "sets")
        dropped(self.spark, asked)
        release(self.spark)
        return out

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those pairs (a, b) that pass the other orders' filters and then the threshold on whole sets."""
        num, den = self.num, self.den

        def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [
                    all(len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) for x, y in ((p, q), (r, s)))
                    for p, q, r, s in zip(*(b.column(c).to_pylist() for c in ("second_a", "second_b", "third_a", "third_b")))
                ]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(b.column("whole_a").to_pylist(), b.column("whole_b").to_pylist()):
                    x, y = unpacked(x), unpacked(y)
                    both = len(np.intersect1d(x, y, True))
                    ok.append(den * both >= num * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        def joined(what: DataFrame, *columns: str) -> DataFrame:
            for side in "ab":
                what = what.join(sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
            return what

        left = settled(joined(pairs, "second", "third").mapInArrow(meets, "a long, b long"), "filtered")
        out = settled(joined(left, "whole").mapInArrow(same, "a long, b long"), "links")
        dropped(self.spark, left)
        return out

    def relative(self, large: DataFrame, sets: DataFrame, rarity) -> tuple[DataFrame | None, DataFrame | None]:
        """(links, candidate pairs) of large buckets."""
        num, den = self.num, self.den

        def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for members in b.column("members").to_pylist():
                    token, n = np.unique(np.concatenate([unpacked(m) for m in members]), return_counts=True)
                    out.append(packed(token[n >= min(2, len(members))]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("pivot"), pa.array(out, pa.binary())], ["pivot", "base"])

        def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows (pivot, element, node, n, d, role, place): role 1 to be met by a larger difference, 2 by a smaller one, 0 for the node itself."""
            for b in batches:
                out: list[list] = [[] for _ in range(7)]
                for pivot, node, p, x in zip(*(b.column(c).to_pylist() for c in ("pivot", "node", "base", "whole"))):
                    p, x = unpacked(p), unpacked(x)
                    more, less = np.setdiff1d(x, p, True), np.setdiff1d(p, x, True)
                    n, d = len(x), len(more) + len(less)
                    most = (n + n * den // num) * (den - num) // (den + num)
                    key = mixed(more ^ U64(SEEDS[0]))
                    more = more[np.lexsort((key, rarity.value.classes(more, key)))]
                    less = less[np.argsort(mixed(less ^ U64(SEEDS[0])))]
                    order = ids_of(np.concatenate([more, less]))
                    for part, role in ((order[: most // 2 + 1], 1), (order[: most + 1], 2), (np.zeros(int(d <= most), np.int64), 0)):
                        for k, v in enumerate((pivot, part, node, n, d, role, np.arange(len(part)))):
                            out[k].append(v if isinstance(v, np.ndarray) else np.full(len(part), v))
                if out[0]:
                    kinds = [pa.int64()] * 5 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], ["pivot", "element", "node", "n", "d", "role", "place"])

        links, pairs = None, None
        for k in range(REBASES + 1):
            if large.isEmpty():
                break
            if k == REBASES:  # enumerate what is left
                a, b = (large.select("token", F.col("node").alias(x), F.col("n").alias("n" + x)) for x in "ab")
                found = a.join(b, "token").where(f"a < b and least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b")
                pairs = settled(found if pairs is None else pairs.union(found), "relative")
                break
            # central members: those whose prefix holds most of what others share have least of their own
            central = large.join(large.groupBy("node").agg(F.count("*").alias("c")), "node")
            first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("c"), F.xxhash64("node", F.lit(k)), "node"))
            three = central.withColumn("r", first).where("r <= 3").groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("three"))
            three = settled(three.select("token", F.xxhash64("three").alias("pivot"), "three"), "central")
            wholes = three.dropDuplicates(["pivot"]).select("pivot", F.explode("three").alias("node")).join(sets.select("node", "whole"), "node")
            base = settled(wholes.groupBy("pivot").agg(F.collect_list("whole").alias("members")).mapInArrow(references, "pivot long, base binary"), "references")
            group = large.join(three.select("token", "pivot"), "token").select("pivot", "node").distinct()
            size = base.agg(F.sum(F.octet_length("base"))).first()[0] or 0
            ready = group.join(sets.select("node", "whole"), "node").join(F.broadcast(base) if size <= BASE_BYTES else base, "pivot")
            rows = settled(ready.mapInArrow(differences, "pivot long, element long, node long, n long, d long, role int, place int"), "differences")
            near = rows.where("role = 0").select("pivot", "node", "n", "d")
            slack = f"n * {den - num} - d * {den + num}"
            best = near.groupBy("pivot").agg(F.max(F.struct(F.expr(slack).alias("s"), F.col("node").alias("rep"))).alias("r")).select("pivot", "r.s", "r.rep")
            sure = near.join(best, "pivot").where(f"node != rep and s + {slack} >= 0")
            sure = settled(sure.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct(), "sure")
            links = sure if links is None else links.union(sure)
            # nodes that such links connect to one another need no further pair among themselves
            told = rows.where("role > 0").join(best.select("pivot", "s"), "pivot", "left").withColumn("linked", F.coalesce(F.expr(f"s + {slack} >= 0"), F.lit(False))).drop("s")
            one, two = F.col("role") == 1, F.col("role") == 2
            met = told.groupBy("pivot", "element").agg(F.count_if(one).alias("s"), F.count_if(two).alias("l"), F.count_if(one & F.col("linked")).alias("sl"), F.count_if(two & F.col("linked")).alias("ll"))
            met = met.withColumn("work", F.expr("s * l - sl * ll")).where("s > 0 and l > 1 and work > 0")
            met = settled(met.select("pivot", "element", (F.col("work") > PER_ROW * (F.col("s") + F.col("l"))).alias("again")), "met")
            few = told.join(met.where("not again").select("pivot", "element"), ["pivot", "element"])
            small = few.where("role = 1").select("pivot", "element", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("d").alias("du"), F.col("place").alias("iu"), F.col("linked").alias("lu"))
            wide = few.where("role = 2").select("pivot", "element", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("d").alias("dv"), F.col("place").alias("iv"), F.col("linked").alias("lv"))
            # a shared element lies early enough in both orders for the overlap that these two sizes need
            most = f"((nu + nv) * {den - num} div {den + num})"
            near = f"(du < dv or (du = dv and u != v)) and 2 * iu <= {most} - (dv - du) and 2 * iv <= {most} + (dv - du) and least(nu, nv) * {den} >= greatest(nu, nv) * {num}"
            sides = [(small.where("not lu"), wide), (small.where("lu"), wide.where("not lv"))]
            found = reduce(DataFrame.union, (x.join(y, ["pivot", "element"]).where(near).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")) for x, y in sides)).distinct()
            pairs = settled(found if pairs is None else pairs.union(found), "relative")
            again = told.join(met.where("again").select("pivot", "element"), ["pivot", "element"])
            large = settled(self.once(again.select(F.xxhash64("pivot", "element").alias("token"), "node", "n").distinct()), "large")
        return links, pairs

    def connected(self, pairs: DataFrame, large: DataFrame, sets: DataFrame, rarity) -> DataFrame:
        """(node, component) over all links, from as many verified pairs as that takes."""
        links, more = self.relative(large, sets, rarity)
        release(self.spark)
        rest = pairs if more is None else settled(pairs.union(more).distinct(), "pairs")
        # one candidate for each node first: most of the others then lie within components
        first = settled(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        new = self.verified(first, sets)
        comp = settled(components(new if links is None else new.union(links)), "components")
        left = settled(apart(rest.join(first, ["a", "b"], "left_anti"), comp), "rest")
        if not left.isEmpty():
            new = self.verified(left, sets)
            comp = settled(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)), "components")
        return comp

    def components(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        rarity = self.rarity()
        rows, nodes = self.nodes(rarity)
        pairs, large = self.candidates(nodes, rarity)
        sets = self.sets(pairs, large, nodes)
        comp = self.connected(pairs, large, sets, rarity)
        dropped(self.spark, pairs, large, sets)
        low = rows.where("n > 0").groupBy("one", "two").agg(F.min("id").alias("low"))
        named = low.join(nodes.select("one", "two", "node"), ["one", "two"]).join(comp, "node", "left").select("one", "two", "low", F.coalesce("component", "node").alias("component"))
        named = settled(named, "named")
        dropped(self.spark, nodes, comp)
        lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
        by_node = named.join(lowest, "component").select("one", "two", "component_id")
        return rows.join(by_node, ["one", "two"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes have different labels; a node without one is its own."""
    for side in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias("l" + side)), side, "left")
    return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _and_none(items):
    yield from items
    yield None
