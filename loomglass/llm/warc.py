"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing: each task streams its pages into one archive of gzip members (one
member a record) and emits an index row a record: file, offset, length, URL
and digest. A task attempt writes a file of its own name, and the index that
Spark commits names only the files of the attempts that count, so a lost
executor leaves at most files that nothing refers to.

Payloads of at least SMALL bytes that are equal are stored once: the record of
the smallest page_id is the response, the others revisit it. Which payload
has copies is decided on digests alone; the lookup is salted, so that a
payload shared by a third of all pages spreads over tasks.

Reading: the index rows wanted are dealt out by file and stretch of PART bytes
of it (less, if that gives fewer stretches than the cluster has cores), so a
task reads about as many bytes however large the archives are. Each task sorts
its rows by offset, neighbouring records are read by one range request (gaps up to GAP bytes are read over,
ranges end at RANGE bytes), and each record's payload is checked against its
digest.

Results: a null html is an empty payload; a null URL gives a record without
target; repeated rows give a record each, all responses if they have the
smallest page_id; a null page_id never becomes the one referred to.
"""

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import configure, fresh_path, settled

SMALL, SALTS = 100, 64
GAP, RANGE, PART = 64 << 10, 8 << 20, 128 << 20
LEAST_PART = 1 << 20
#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # the pages carry no time of capture

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, not compressed."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return fields, block.partition(b"\r\n\r\n")[2]


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of every page."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    narrow = base.where(F.octet_length("payload") >= SMALL).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = narrow.where("n > 1 and first is not null").select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(shared, ["payload_digest", "salt"], "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def written(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Write the archives below folder (else a fresh shared one) and return their index, itself a settled table."""
    spark = pages.sparkSession
    configure(spark)
    folder = folder or fresh_path(spark, "warc")

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        context = TaskContext.get()
        file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:12]}.warc.gz"  # a task may run several partitions
        at = 0
        with where.open_output_stream(f"{path}/{file}", compression=None) as out:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload = r["payload"].encode()
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = record_bytes(r["page_id"], r["url"], payload, r["payload_digest"], r["refers_to"])
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    rows.append((r["page_id"], r["url"], f"{folder}/{file}", at, len(member), len(payload), r["payload_digest"], "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return settled(planned(pages, **names).mapInArrow(run, INDEX), "warc-index")


_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in INDEX.split(", ")]


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[str, int, int, list[int]]]:
    """(file, begin, end, rows' numbers) of the reads that cover sorted (file, offset, length) rows."""
    out: list[tuple[str, int, int, list[int]]] = []
    for n, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and 0 <= offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            out[-1][3].append(n)
            out[-1] = (file, out[-1][1], offset + length, out[-1][3])
        else:
            out.append((file, offset, offset + length, [n]))
    return out


def read_back(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, fetched by coalesced ranges; payload is null for revisits or if not asked for."""
    configure(index.sparkSession)

    def run(batches):
        stream, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            got = []
            for file, begin, end, members in ranges(rows):
                if opened != file:
                    if stream is not None:
                        stream.close()
                    where, path = fs.FileSystem.from_uri(file)
                    stream, opened = where.open_input_file(path), file
                block = stream.read_at(end - begin, begin)
                for n in members:
                    _, offset, length = rows[n]
                    fields, payload = parsed(zlib.decompress(block[offset - begin : offset - begin + length], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {file}:{offset}")
                    size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                    number = [int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")]
                    got.append((number[0], fields.get("warc-target-uri"), size, digest, kind, number[1], payload if payloads and kind == "response" else None))
            if got:
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], [c.split()[0] for c in RECORD.split(", ")])
        if stream is not None:
            stream.close()

    cores = index.sparkSession.sparkContext.defaultParallelism
    total = index.agg(F.sum("length")).first()[0] or 0
    part = max(LEAST_PART, min(PART, total // (2 * cores)))
    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / part).alias("stretch"))
    stretches = wanted.groupBy("file").agg(F.count_distinct("stretch").alias("n")).agg(F.sum("n")).first()[0] or 1
    # as many tasks as stretches: the rows of an index are small, so Spark would gather them into few
    dealt = wanted.repartitionByRange(stretches, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, RECORD)
