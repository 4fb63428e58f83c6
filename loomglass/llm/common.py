"""Shared pieces: durable intermediate tables, connected components and byte-level text kernels.

Intermediate results are Parquet tables under the folder that
``spark.checkpoint.dir`` names, which driver and executors share, so a lost
executor only costs the tasks it ran.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship

#: Rows in one Arrow batch sent to Python; with it and CHUNK_BYTES a Python worker's memory stays bounded.
BATCH_ROWS = 256
#: Text bytes that a kernel handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows that a kernel handles at once, whatever batches the session sends.
MOST_ROWS = 1024
#: Files of a settled table for each core of the cluster.
FILES_PER_CORE = 4
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> None:
    """Session settings the operators count on: small Arrow batches, and workers that can import this package."""
    ship(spark)
    # every shared result is a settled table, so no query reads another one's shuffle files
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a session of one process that names none (as in tests) gets one made; a cluster must name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomglass-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomglass/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    The last stage's partitions are gathered to FILES_PER_CORE for each of the cluster's cores, so that a small result
    of many partitions is not as many files. With dynamic allocation the cores are not known, and nothing is gathered.
    """
    path, context = fresh_path(df.sparkSession, name), df.sparkSession.sparkContext
    steady = context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() != "true"
    (df.coalesce(FILES_PER_CORE * context.defaultParallelism) if steady else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind settled() tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver give back what finished jobs held: plans, collected parts and broadcasts."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge table; component is the smallest node reachable.

    Alternating large-star and small-star steps: each node's links move to
    its smallest neighbour until every node points at its component's
    minimum. Links never visit the driver; each step is a settled table and
    the old one is deleted.
    """
    spark = edges.sparkSession
    links = settled(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "cc")
    state = None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*").where("hi > lo").distinct()
        )
        after = settled(small, "cc")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
        dropped(spark, links)
        links = after
        if now == state:
            break
        state = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, next to others on its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's; others have none
        ctypes.CDLL(None).malloc_trim(0)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans_of(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_map(df: DataFrame, columns: list[str], text: str, schema: str, kernel: Callable) -> DataFrame:
    """One pass of a byte-level kernel over a text column.

    kernel(batch, bytes, offsets) gets at most CHUNK_BYTES of text with the
    batch's rows and returns a RecordBatch or a dict of columns.
    """
    def run(batches):
        for batch in (b.slice(k, MOST_ROWS) for b in batches for k in range(0, b.num_rows, MOST_ROWS)):
            data, offs = utf8_view(batch.column(text))
            for i, j in spans_of(offs):
                got = kernel(batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield got if isinstance(got, pa.RecordBatch) else pa.RecordBatch.from_pydict(got)
        give_back()

    return df.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher over an array of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    """Truth table over byte values: part of a word or not."""
    table = np.ones(256, bool)
    for a, b in separators:
        table[a : b + 1] = False
    return table


#: Words end at ASCII white space.
BY_SPACE = word_bytes([(0x20, 0x20), (0x09, 0x0D)])
#: Words are ASCII letters and digits and all that isn't ASCII.
BY_ALNUM = word_bytes([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ROOT, _BYTE = 0x9E3779B97F4A7C15 | 1, mixed(np.arange(256, dtype=U64) + U64(77))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
                out = np.empty(size, U64)
                out[0] = 1
                have = 1
                while have < size:  # doubling
                    step = U64(pow(base, have, 1 << 64))
                    out[have : 2 * have] = out[: min(have, size - have)] * step
                    have *= 2
                _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of a chunk of documents: byte bounds, document index and a 64-bit hash of the lower-cased word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.low = LOWER[data]
        self.n_docs = len(offs) - 1
        inside = table[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            cut = offs[1:-1]
            cut = cut[cut < len(data)]
            before = np.empty_like(inside)
            before[0] = False
            before[1:] = inside[:-1]
            before[cut] = False
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            after[cut[cut > 0] - 1] = False
            first &= ~before
            last &= ~after
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # of each document's words
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[self.low] * up[: len(data)], out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word's index) of every k consecutive words of a document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return sequence_hash(self.hash, at, k), at


def sequence_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of k words from each position."""
    out = np.full(len(at), k * 0x632BE59BD9B4E019 & (1 << 64) - 1, U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + words[at + j]
    return mixed(out)


def ids_of(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed longs that Spark has."""
    return hashes.view(np.int64)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Larger Arrow batches for a job over narrow rows, run within the block."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


class Bitmap:
    """Set of keys as a bitmap of fixed size: it may claim a key it lacks, never the reverse."""

    def __init__(self, keys: DataFrame, column: str, bits: int = 23, width: int = 64):
        """Keys are the lowest `width` bits of a long. It is built where the rows are; what comes to the driver
        is the bitmap's non-zero words, 2^bits / 64 at most."""
        self.shift, self.bits = width - bits, bits
        slot = f"shiftrightunsigned({column}, {self.shift})"
        rows = keys.select(F.expr(f"shiftright({slot}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
        words = rows.groupBy("word").agg(F.bit_or("bit").alias("v")).toArrow()  # a row a word as Python objects would fill the driver
        table = np.zeros(max(1, (1 << bits) // 64), np.int64)
        table[words.column("word").to_numpy()] = words.column("v").to_numpy()
        self.table, self.size = table.view(U64), words.num_rows

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> U64(self.shift)).astype(np.int64)
        return (self.table[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1


#: Bits of a sort key that number the documents of a chunk; the rest is a token's.
DOC_BITS = 12


def distinct_tokens(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): each document's distinct hashes, cut to their upper 64 - DOC_BITS bits, sorted."""
    if n_docs > 1 << DOC_BITS:
        raise ValueError("too many rows in a batch")
    key = np.sort(doc.astype(U64) << U64(64 - DOC_BITS) | h >> U64(DOC_BITS))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << (64 - DOC_BITS)) - 1), np.searchsorted(key >> U64(64 - DOC_BITS), np.arange(n_docs + 1, dtype=U64))
