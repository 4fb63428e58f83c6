"""Near-duplicate vectors by NN-descent.

Vectors are compared only within a label (and length). Equal vectors are one
node. A neighbour graph of LIST neighbours a node starts from TABLES
orderings of the nodes by random-hyperplane signatures, in each of which
overlapping blocks of neighbouring nodes are compared densely. Then rounds of
local joins refine it: around every node, its neighbours and the nodes it is a
neighbour of are compared with one another if one of the two edges is new, and
a node keeps the LIST best it has met. Edges under FLOOR are not followed.
Rounds end when few edges change.

Edges of at least the threshold are links. A list whose last entry is a link
is saturated and may hide more. Links that leave a saturated component are
found by comparing all such components of a label: each is cut into blocks of
at most BLOCK nodes with a centre and a radius (an angle), pairs of blocks that
are too far apart to hold a link are passed over, and all others are compared
node by node; components with a link between them become one. Links within
components are counted by blocks: two blocks whose balls lie wholly within the
threshold's angle are only added up, the others are multiplied, which counts
without listing.
(Small components are treated the same, so that link counts are exact within
every component.) Last, the recall is audited: a sample of nodes is compared
with all nodes; it is made larger until LINKED of them have links, or all of
AUDIT_MOST were asked. Each linked node counts for as much, whatever the number
of its links. If less than GOAL of their links lie within components, more
orderings are added and the search resumes; after AUDIT_ROUNDS of that, what is
left apart is compared exhaustively in blocks.

Results: a vector that is null, zero or holds null or non-finite components,
or has no label or id, links with nothing and is its own component (null if
its id is). Every row is a vector of its own, also where rows share an id: an
id may stand for several vectors or labels, each with its own links; components
are named by the smallest id in them.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, arrow_rows, components, configure, dropped, mixed, settled

THRESHOLD, FLOOR = 0.98, 0.7
TABLES, LIST, REVERSE, ROUNDS, CHANGE = 4, 10, 12, 4, 0.002
BLOCK, OVERLAP = 512, 128
AUDIT, AUDIT_MOST, LINKED, GOAL, AUDIT_ROUNDS = 256, 4096, 64, 0.98, 6
BITS = 48
SLACK = 1e-6  # angle by which blocks must be clear of the threshold to be judged as a whole


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # else squares of very large or small numbers are lost
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distances(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """For rows of two lists of balls: (one, other, least and greatest angle between their members); the other is the one where it is null."""
    for x, y in zip(batch.column("x"), batch.column("y")):
        p = x.as_py()
        q = y.as_py() if y.is_valid else p
        u, w = (np.frombuffer(b"".join(r["centre"] for r in z)).reshape(len(z), -1) for z in (p, q))
        angle = np.arccos(np.clip(u @ w.T, -1, 1))
        reach = np.array([r["radius"] for r in p])[:, None] + np.array([r["radius"] for r in q])
        yield p, q, angle - reach, angle + reach


class NeighbourDescent:
    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD):
        self.spark = vectors.sparkSession
        configure(self.spark)
        self.threshold = threshold
        base = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
        self.kind = "<f4" if "float" in dict(base.dtypes)["v"] else "<f8"
        self.rows = settled(base.mapInArrow(self._keys(), f"id {dict(base.dtypes)['id']}, grp string, one long, two long, vec binary"), "vectors")
        one = self.rows.where("grp is not null").groupBy("grp", "one", "two").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        self.nodes = settled(one.withColumn("node", F.monotonically_increasing_id()), "nodes")  # an id may stand for several vectors, so it is no name
        self.recall: float | None = None

    def _keys(self):
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists, labels, ids = b.column("v"), b.column("label"), b.column("id")
                n = len(b)
                offs, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(float)  # null components are nan
                size = np.where(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (lists, labels, ids)]), np.diff(offs), 0)
                one, two, vec, ok = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n, np.zeros(n, bool)
                for length in np.unique(size[size > 0]).tolist():
                    at = np.flatnonzero(size == length)
                    v = values[offs[at][:, None] + np.arange(length)] + 0.0  # one zero
                    good = np.isfinite(v).all(1) & (v != 0).any(1)
                    at, v = at[good], v[good]
                    bits, place = np.ascontiguousarray(v).view(U64), np.arange(length, dtype=U64)
                    one[at] = mixed(mixed(bits + mixed(place + U64(1))).sum(1)).view(np.int64)
                    two[at] = mixed(mixed(bits ^ mixed(place + U64(1 << 40))).sum(1)).view(np.int64)
                    raw, step = v.astype(kind).tobytes(), length * int(kind[2])
                    for k, i in enumerate(at.tolist()):
                        vec[i] = raw[k * step : (k + 1) * step]
                    ok[at] = True
                grp = [f"{w}:{x}" if good else None for w, x, good in zip(size.tolist(), labels.to_pylist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(grp, pa.string()), pa.array(one, mask=~ok), pa.array(two, mask=~ok), pa.array(vec, pa.binary())], ["id", "grp", "one", "two", "vec"])

        return run

    def ordered(self, table: int) -> DataFrame:
        """Edges (a, b, sim) out of blocks of one ordering of the nodes."""
        kind = self.kind

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for b in batches:
                vec = b.column("vec").to_pylist()
                sig = np.zeros(len(vec), np.int64)
                for size in {len(x) for x in vec}:
                    at = [k for k, x in enumerate(vec) if len(x) == size]
                    v = unit([vec[k] for k in at], kind)
                    if size not in planes:
                        planes[size] = np.random.default_rng(1000 + table).normal(size=(v.shape[1], BITS))
                    sig[at] = ((v @ planes[size]) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(sig), b.column("node"), b.column("vec")], ["grp", "sig", "node", "vec"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail: list[tuple] = []
            for b in batches:
                rows = [*tail, *zip(b.column("grp").to_pylist(), b.column("node").to_pylist(), b.column("vec").to_pylist())]
                tail = rows[-OVERLAP:]
                a, c, s = [], [], []
                k = 0
                while k < len(rows):
                    e = k
                    while e < len(rows) and rows[e][0] == rows[k][0]:
                        e += 1
                    node = np.array([r[1] for r in rows[k:e]])
                    v = unit([r[2] for r in rows[k:e]], kind)
                    k = e
                    m = v @ v.T
                    np.fill_diagonal(m, -2)
                    m[node[:, None] == node[None, :]] = -2
                    few = min(LIST, len(node) - 1)
                    if few < 1:
                        continue
                    best = np.argpartition(-m, few - 1, 1)[:, :few]
                    sim = np.take_along_axis(m, best, 1)
                    x, y = np.nonzero(sim >= FLOOR)
                    a.append(node[x])
                    c.append(node[best[x, y]])
                    s.append(sim[x, y])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(c), pa.int64()), pa.array(np.concatenate(s))], ["a", "b", "sim"])

        sorted_nodes = self.nodes.select("grp", "node", "vec").mapInArrow(signed, "grp string, sig long, node long, vec binary").repartitionByRange("grp", "sig", "node").sortWithinPartitions("grp", "sig", "node")
        with arrow_rows(self.spark, BLOCK - OVERLAP):
            return settled(sorted_nodes.mapInArrow(blocks, "a long, b long, sim double"), "ordering")

    @staticmethod
    def best(edges: DataFrame) -> DataFrame:
        """The LIST best neighbours of each node, and whether an edge is new (an edge met again is not)."""
        one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
        return one.withColumn("r", rank).where(F.col("r") <= LIST).drop("r")

    def local_join(self, graph: DataFrame) -> DataFrame:
        """Edges found among the neighbours of every node."""
        kind = self.kind
        last = graph.groupBy("a").agg(F.count("*").alias("c"), F.min("sim").alias("low")).select(F.col("a").alias("u"), F.when(F.col("c") >= LIST, F.col("low")).otherwise(F.lit(FLOOR)).alias("need"))
        back = graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim", "fresh").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("r") <= REVERSE).drop("r", "sim")
        around = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").union(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        live = around.groupBy("v").agg(F.max("fresh").alias("any"), F.count("*").alias("c")).where("any = 1 and c > 1").select("v")
        members = around.join(live, "v").join(last, "u", "left").join(self.nodes.select(F.col("node").alias("u"), "vec"), "u")
        rings = members.groupBy("v").agg(F.collect_list(F.struct("u", "fresh", F.coalesce("need", F.lit(FLOOR)).alias("need"), "vec")).alias("m"))  # LIST + REVERSE at most

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c, s = [], [], []
                for ring in b.column("m").to_pylist():
                    u = np.array([r["u"] for r in ring])
                    new = np.array([r["fresh"] for r in ring], bool)
                    need = np.array([r["need"] for r in ring])
                    v = unit([r["vec"] for r in ring], kind)
                    m = v @ v.T
                    x, y = np.nonzero((m >= need[:, None]) & (new[:, None] | new[None, :]) & ~np.eye(len(u), dtype=bool))
                    a.append(u[x])
                    c.append(u[y])
                    s.append(m[x, y])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(c), pa.int64()), pa.array(np.concatenate(s))], ["a", "b", "sim"])

        return rings.select("m").mapInArrow(pairs, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))

    def refined(self, edges: DataFrame) -> DataFrame:
        """NN-descent from the edges given (fresh is 1 for those not yet followed)."""
        graph = settled(self.best(edges), "graph")
        size = max(1, graph.count())
        for _ in range(ROUNDS):
            found = self.local_join(graph)
            old = graph.withColumn("fresh", F.lit(0))
            after = settled(self.best(old.unionByName(found.withColumn("fresh", F.lit(1)))), "graph")
            dropped(self.spark, graph)
            graph = after
            if graph.where("fresh = 1").count() <= CHANGE * size:
                break
        return graph

    def joined(self, comp: DataFrame, graph: DataFrame) -> DataFrame:
        """comp with those components made one that have links between saturated lists, which neither list shows."""
        full = graph.groupBy("a").agg(F.count("*").alias("c"), F.min("sim").alias("low")).where((F.col("c") >= LIST) & (F.col("low") >= self.threshold)).select(F.col("a").alias("node"))
        hidden = comp.join(full, "node").select("component").distinct()
        links = self.crossing(comp.join(hidden, "component"))
        if links.isEmpty():
            return comp
        merged = settled(components(links), "merged").select(F.col("node").alias("component"), F.col("component").alias("into"))
        return settled(comp.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "components")

    def balls(self, comp: DataFrame) -> DataFrame:
        """(grp, component, piece, m, centre, radius, copies): blocks of at most about BLOCK nodes of each component given, each within an angle of its centre; grp has the label."""
        kind = self.kind
        sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
        piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).cast("int")
        parts = comp.join(sizes, "component").withColumn("piece", piece).join(self.nodes.select("node", "grp", "copies", "vec"), "node")
        parts = parts.groupBy("grp", "component", "piece").agg(F.collect_list(F.struct("node", "copies", "vec")).alias("m"), F.sum("copies").alias("copies"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                centre, radius = [], []
                for rows in b.column("m").to_pylist():
                    v = unit([r["vec"] for r in rows], kind)
                    c = v.mean(0)
                    c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else v[0]
                    centre.append(c.tobytes())
                    radius.append(float(np.arccos(np.clip((v @ c).min(), -1, 1))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "component", "piece", "m", "copies")), pa.array(centre, pa.binary()), pa.array(radius, pa.float64())], ["grp", "component", "piece", "m", "copies", "centre", "radius"])

        with arrow_rows(self.spark, 4):
            return settled(parts.mapInArrow(run, "grp string, component long, piece int, m array<struct<node:bigint,copies:bigint,vec:binary>>, copies long, centre binary, radius double"), "balls")

    @staticmethod
    def met(parts: DataFrame, by: list[str]) -> DataFrame:
        """(x, y): chunks of at most about BLOCK balls of one group, each chunk with itself (y null) and with each later one; balls without their nodes."""
        number = parts.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("component", "piece"), F.col("chunks")).cast("int")
        groups = parts.drop("m").join(number, by).withColumn("chunk", chunk).groupBy(*by, "chunk").agg(F.collect_list(F.struct("component", "piece", "copies", "centre", "radius")).alias("x"), F.max("chunks").alias("chunks"))
        first = groups.select(*by, "chunk", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("other"), "x")
        return first.join(groups.select(*by, F.col("chunk").alias("other"), F.col("x").alias("y")), [*by, "other"]).select("x", F.when(F.col("chunk") != F.col("other"), F.col("y")).alias("y"))

    def crossing(self, comp: DataFrame) -> DataFrame:
        """Pairs (a, b) of the components given that have a link between them."""
        kind, threshold = self.kind, self.threshold
        theta = float(np.arccos(min(1.0, threshold))) + SLACK

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], [], []]
                for p, q, far, _ in _distances(b):
                    cp, cq = (np.array([r["component"] for r in z]) for z in (p, q))
                    maybe = (far <= theta) & (cp[:, None] != cq)
                    for i, j in np.argwhere(np.triu(maybe) if q is p else maybe).tolist():
                        for k, v in enumerate((p[i]["component"], p[i]["piece"], q[j]["component"], q[j]["piece"])):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["a", "pa", "b", "pb"])

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sides = ([[r["vec"] for r in rows] for rows in b.column(c).to_pylist()] for c in "xy")
                has = [bool((unit(x, kind) @ unit(y, kind).T >= threshold).any()) for x, y in zip(*sides)]
                yield b.select(["a", "b"]).filter(pa.array(has, pa.bool_()))

        parts = self.balls(comp)
        with arrow_rows(self.spark, 4):
            pairs = settled(self.met(parts, ["grp"]).mapInArrow(close, "a long, pa int, b long, pb int"), "pairs")
            one, two = (parts.select(F.col("component").alias(c), F.col("piece").alias("p" + c), F.col("m").alias(m)) for c, m in (("a", "x"), ("b", "y")))
            out = settled(pairs.join(one, ["a", "pa"]).join(two, ["b", "pb"]).select("a", "b", "x", "y").mapInArrow(linked, "a long, b long").distinct(), "crossing")
        dropped(self.spark, parts, pairs)
        return out

    def counted(self, comp: DataFrame) -> DataFrame:
        """(node, links to other rows) within each component of more than one node.

        Two blocks whose balls lie within the threshold's angle as a whole link entirely and are only added up; those
        too far apart are passed over; products are made of the others.
        """
        kind, threshold = self.kind, self.threshold
        theta = float(np.arccos(min(1.0, threshold)))
        parts = self.balls(comp)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each pair of blocks to multiply (other >= 0), and one for each block with the rows that surely link to all of its nodes (other -1)."""
            for b in batches:
                out: list[list] = [[], [], [], []]
                for p, q, far, near in _distances(b):
                    sure, maybe = near <= theta - SLACK, far <= theta + SLACK
                    ids = [np.array([r["piece"] for r in z]) for z in (p, q)]
                    copies = [np.array([r["copies"] for r in z], np.int64) for z in (p, q)]
                    if q is p:
                        more = sure @ copies[1]  # its own rows too, but for a node itself
                        rows = [(ids[0], more)]
                        pairs = np.argwhere(np.triu(maybe & ~sure))
                    else:
                        rows = [(ids[0], sure @ copies[1]), (ids[1], sure.T @ copies[0])]
                        pairs = np.argwhere(maybe & ~sure)
                    component = p[0]["component"]
                    for piece, n in rows:
                        some = np.flatnonzero(n)
                        for k, v in enumerate(([component] * len(some), piece[some].tolist(), [-1] * len(some), n[some].tolist())):
                            out[k] += v
                    for k, v in enumerate(([component] * len(pairs), ids[0][pairs[:, 0]].tolist(), ids[1][pairs[:, 1]].tolist(), [0] * len(pairs))):
                        out[k] += v
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["component", "piece", "other", "links"])

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node, links = [], []
                for x, y in zip(b.column("x"), b.column("y")):
                    p = x.as_py()
                    q = y.as_py() if y.is_valid else None
                    v = unit([r["vec"] for r in p], kind)
                    w = unit([r["vec"] for r in q], kind) if q else v
                    near = v @ w.T >= threshold
                    if q is None:
                        np.fill_diagonal(near, False)
                    node.append(np.array([r["node"] for r in p]))
                    links.append(near @ np.array([r["copies"] for r in (q or p)]))
                    if q is not None:
                        node.append(np.array([r["node"] for r in q]))
                        links.append(near.T @ np.array([r["copies"] for r in p]))
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node), pa.int64()), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])

        with arrow_rows(self.spark, 4):
            pairs = settled(self.met(parts, ["component"]).mapInArrow(told, "component long, piece int, other int, links long"), "meetings")
            x, y = (parts.select("component", F.col("piece").alias(n), F.col("m").alias(m)) for n, m in (("piece", "x"), ("other", "y")))
            both = pairs.where("other >= 0").join(x, ["component", "piece"]).join(y, ["component", "other"]).select("x", F.when(F.col("piece") != F.col("other"), F.col("y")).alias("y"))
            made = both.mapInArrow(products, "node long, links long")
            whole = pairs.where("other < 0").groupBy("component", "piece").agg(F.sum("links").alias("links"))
            sure = parts.join(whole, ["component", "piece"]).select(F.explode("m").alias("n"), "links").select(F.col("n.node").alias("node"), "links")
            # a block that is sure of itself counts each node's own copies as links
            own = pairs.where("piece = other").select("component", "piece", F.lit(True).alias("multiplied")).distinct()
            less = parts.join(own, ["component", "piece"], "left_anti").select(F.explode("m").alias("n")).select(F.col("n.node").alias("node"), (-F.col("n.copies")).alias("links"))
            out = settled(made.union(sure).union(less).groupBy("node").agg(F.sum("links").alias("links")), "counts")
        dropped(self.spark, parts, pairs)
        return out

    def exhausted(self, comp: DataFrame) -> DataFrame:
        """comp with all links, by comparing all blocks of a label; only pairs of components come out of it."""
        kind, threshold = self.kind, self.threshold
        sizes = self.nodes.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
        own = self.nodes.join(comp, "node", "left").select("grp", "vec", F.coalesce("component", "node").alias("c")).join(sizes, "grp")
        parts = own.withColumn("piece", F.pmod(F.xxhash64("vec"), "pieces").cast("int")).groupBy("grp", "piece").agg(F.collect_list(F.struct("c", "vec")).alias("m"), F.max("pieces").alias("pieces"))
        parts = settled(parts, "blocks")
        met = parts.select("grp", F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("other"), F.col("m").alias("x")).join(parts.select("grp", F.col("piece").alias("other"), F.col("m").alias("y")), ["grp", "other"])

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: set[tuple[int, int]] = set()
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                    cx, cy = (np.array([r["c"] for r in z]) for z in (x, y))
                    near = (unit([r["vec"] for r in x], kind) @ unit([r["vec"] for r in y], kind).T >= threshold) & (cx[:, None] != cy)
                    i, j = np.nonzero(near)
                    found |= set(zip(np.minimum(cx[i], cy[j]).tolist(), np.maximum(cx[i], cy[j]).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([a for a, _ in found], [c for _, c in found])], ["a", "b"])

        with arrow_rows(self.spark, 4):
            links = settled(met.select("x", "y").mapInArrow(linked, "a long, b long").distinct(), "rest")
        dropped(self.spark, parts)
        both = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
        return settled(components(both), "components")

    def audit(self, comp: DataFrame) -> float:
        """Mean share of their links that linked nodes of the sample (those with the smallest hashes) have within components."""
        kind, threshold = self.kind, self.threshold
        one, two = (comp.select(F.col("node").alias(s), F.col("component").alias("c" + s)) for s in "ab")
        most = AUDIT
        while True:
            asked = self.nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(most).select("node", "grp", "vec").collect()
            by_grp: dict[str, list] = {}
            for r in asked:
                by_grp.setdefault(r.grp, []).append((r.node, bytes(r.vec)))

            def scan(batches: Iterator[pa.RecordBatch], by_grp=by_grp) -> Iterator[pa.RecordBatch]:
                query = {g: (np.array([n for n, _ in q]), unit([v for _, v in q], kind)) for g, q in by_grp.items()}
                for b in batches:
                    grp, node, vec = (b.column(c).to_pylist() for c in ("grp", "node", "vec"))
                    a, c = [], []
                    for g in set(grp) & query.keys():
                        at = [k for k, x in enumerate(grp) if x == g]
                        names, q = query[g]
                        x, y = np.nonzero(unit([vec[k] for k in at], kind) @ q.T >= threshold)
                        own = np.array([node[k] for k in at])[x]
                        far = own != names[y]
                        a.append(names[y][far])
                        c.append(own[far])
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(c), pa.int64())], ["a", "b"])

            truth = self.nodes.select("grp", "node", "vec").mapInArrow(scan, "a long, b long")
            by_node = truth.join(one, "a", "left").join(two, "b", "left").groupBy("a").agg(F.avg((F.col("ca").eqNullSafe(F.col("cb")) & F.col("ca").isNotNull()).cast("int")).alias("r"))
            got = by_node.agg(F.count("*"), F.avg("r")).first()
            if got[0] >= LINKED or most >= AUDIT_MOST or len(asked) < most:
                return got[1] if got[0] else 1.0
            most *= 4

    def links(self) -> DataFrame:
        """vec_id, n_links, component_id and kept of every row, and the recall that the audit saw."""
        graph, comp = None, None
        for k in range(AUDIT_ROUNDS):
            orderings = [self.ordered(k * TABLES + t) for t in range(TABLES)]
            fresh = reduce(DataFrame.union, orderings).withColumn("fresh", F.lit(1))
            old, graph = graph, self.refined(fresh if graph is None else graph.withColumn("fresh", F.lit(0)).unionByName(fresh))
            dropped(self.spark, *orderings, *([old] if old is not None else []))
            comp = self.joined(settled(components(graph.where(F.col("sim") >= self.threshold)), "components"), graph)
            self.recall = self.audit(comp)
            if self.recall >= GOAL:
                break
        else:
            comp = self.exhausted(comp)
        dropped(self.spark, graph)
        counts = self.counted(comp)
        told = self.nodes.select("grp", "one", "two", "node", "low", "copies").join(comp, "node", "left").join(counts, "node", "left").withColumn("c", F.coalesce("component", "node"))
        names = told.groupBy("c").agg(F.min("low").alias("name"))
        told = told.join(names, "c").select("grp", "one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "name")
        out = self.rows.drop("vec").join(told, ["grp", "one", "two"], "left")
        name = F.coalesce("name", "id")
        return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), (name.cast("long") if dict(self.rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") else name).alias("component_id"), (F.col("id") == name).alias("kept"))
