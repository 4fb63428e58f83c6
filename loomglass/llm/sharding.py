"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

A store is a folder with data/ (Parquet files that are never changed) and
manifest/ (a Parquet table a version, and a small pointer file that names it).
A shard is a run of rows in one data file, named by its number, with its rows
and bytes.

* append() writes an arrival without a shuffle: what each input task holds
  becomes one small shard. It commits a version that lists the old shards and
  the new ones.
* compact() groups live shards of similar size: tier k holds sizes in
  [SMALL_BYTES * FAN^k, SMALL_BYTES * FAN^(k+1)), the lowest also all smaller
  ones. Shards of a tier are taken in order of their number and packed, by a
  running sum of bytes, into outputs of about TARGET_BYTES; tiers with at least
  FAN shards are merged, shards of half the target or more stay. There are as
  many tasks as outputs, and each output is dealt by a number that is known to
  hash to a task of its own, so a task holds about a target's bytes however
  large the store is. Then a version is committed in which the outputs replace their
  inputs. Only the files of the shards to be merged are read.

A commit first writes the version's manifest to a folder of its own, then
creates the pointer file v<number> only if there is none of that name, which
is what decides between writers. A pointer that is still empty (its writer
stopped, or has not ended) counts as no version, but its number is taken. A
reader takes the highest version, so it sees all of a commit or nothing. Data
files of writes that were not committed are never read, and a job that loses
an executor only repeats tasks.

Manifests hold a row for each file; one task orders the rows of a tier.

Results: null texts count no bytes and are kept; repeated rows are kept; an
empty arrival commits a version without new shards; a store without rows gives
an empty table of the arrival's columns. Other columns are carried along,
whatever their names: the store's own columns take names that are free, and
where the rows have a column "shard", their shard's number is in "shard_".
Arrivals must have the same columns.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .carry import free_name
from .common import configure, fresh_path

SMALL_BYTES, TARGET_BYTES, FAN = 4 << 20, 64 << 20, 4
MANIFEST = "shard long, rows long, bytes long, path string, version long"


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str | None = None, text: str = "text", key: str = "doc_id", small: int = SMALL_BYTES, target: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.text, self.key = spark, text, key
        configure(spark)
        self.folder = folder or fresh_path(spark, "shards")
        self.small, self.target, self.fan = small, target, fan
        path = self._path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def _pointers(self) -> list[tuple[int, bool]]:
        """(number, whether it is committed) of every pointer file."""
        root = self._path(f"{self.folder}/manifest")
        files = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted((int(n[1:]), size > 0) for n, size in files if n[:1] == "v" and n[1:].isdigit())

    def versions(self) -> list[int]:
        return [n for n, done in self._pointers() if done]

    def _told(self, version: int | None = None) -> dict:
        """What a version's pointer says, else the latest's: its manifest's path, and the schema of the rows."""
        known = self.versions()
        if not known:
            return {}
        stream = self.fs.open(self._path(f"{self.folder}/manifest/v{known[-1] if version is None else version:08d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, else of the latest."""
        told = self._told(version)
        if not told:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(told["manifest"])

    def commit(self, shards: DataFrame, version: int, schema: StructType | None = None) -> None:
        """Make a version visible by creating its pointer; fails if another writer has that number."""
        schema = schema or self._schema()
        path = f"{self.folder}/manifest/rows-{uuid.uuid4().hex}"
        shards.select("shard", "rows", "bytes", "path", "version").coalesce(1).write.parquet(path)
        try:
            out = self.fs.create(self._path(f"{self.folder}/manifest/v{version:08d}"), False)
        except Exception as e:  # FileAlreadyExistsException, by whatever name the file system has for it
            raise RuntimeError(f"version {version} was taken by another writer") from e
        out.write(bytearray(json.dumps({"manifest": path, "schema": schema.jsonValue()}).encode()))
        out.close()

    def _schema(self, version: int | None = None) -> StructType:
        told = self._told(version)
        return StructType.fromJson(told["schema"]) if told else StructType()

    def _next(self) -> int:
        return max((n for n, _ in self._pointers()), default=0) + 1

    def _own(self, schema: StructType) -> tuple[str, str]:
        """Names of the columns in data files that hold a row's shard and bytes."""
        return free_name("__shard", schema.names), free_name("__bytes", schema.names)

    def _write(self, rows: DataFrame, shard: str, size: str, version: int) -> DataFrame:
        """Write rows that carry their shard's number; returns the new shards as they stand on disk."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        own = self.spark.read.schema(rows.schema).parquet(path).select(F.col(shard).alias("shard"), F.col(size).alias("size"), F.input_file_name().alias("path"))
        return own.groupBy("shard", "path").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).select("shard", "rows", "bytes", "path", F.lit(version).cast("long").alias("version"))

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards; returns the version."""
        version, live, schema = self._next(), self.manifest(), self._schema()
        if schema.names and schema.names != rows.columns:
            raise ValueError(f"the store's columns are {schema.names}")
        shard, size = self._own(rows.schema)
        base = (live.agg(F.max("shard")).first()[0] or 0) + 1
        sized = rows.withColumn(size, F.coalesce(F.octet_length(F.col(f"`{self.text}`")), F.lit(0)).cast("long")).withColumn(shard, F.spark_partition_id().cast("long") + F.lit(base))
        self.commit(live.union(self._write(sized, shard, size, version)), version, rows.schema)
        return version

    def plan(self, live: DataFrame) -> DataFrame:
        """(shard, output) for the live shards to be merged; outputs are numbered from 1."""
        tier = F.greatest(F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)) / F.lit(float(self.small))) / F.log(F.lit(float(self.fan)))), F.lit(-1))
        sized = live.where(F.col("bytes") * 2 < self.target).withColumn("tier", tier)
        run = Window.partitionBy("tier").orderBy("shard")
        packed = sized.withColumn("before", F.sum("bytes").over(run) - F.col("bytes")).withColumn("n", F.count("*").over(Window.partitionBy("tier")))
        packed = packed.where(F.col("n") >= self.fan).withColumn("slot", F.floor(F.col("before") / self.target))
        many = packed.withColumn("members", F.count("*").over(Window.partitionBy("tier", "slot"))).where("members > 1")
        first, outputs = F.lit(1), 1
        for r in many.groupBy("tier").agg(F.max("slot").alias("last")).orderBy("tier").collect():  # a tier is a power of FAN: a few rows
            first = F.when(F.col("tier") == r.tier, outputs).otherwise(first)
            outputs += r.last + 1
        return many.select("shard", (first + F.col("slot")).cast("long").alias("output"))

    def _placed(self, plan: DataFrame, outputs: int) -> DataFrame:
        """The plan with place, for each output a number that repartition(outputs, place) puts into a partition of its own."""
        slots = plan.select("output").distinct().withColumn("slot", F.row_number().over(Window.orderBy("output")) - 1)
        number = F.col("id").cast("int")
        places = self.spark.range(40 * outputs + 100).groupBy(F.pmod(F.hash(number), F.lit(outputs)).alias("slot")).agg(F.min(number).alias("place"))
        return plan.join(slots.join(places, "slot", "left").select("output", F.coalesce("place", "slot").alias("place")), "output")

    def compact(self) -> int | None:
        """One round; returns the version it committed, or None if nothing was to merge."""
        live = self.manifest()
        plan = self.plan(live)
        outputs = plan.agg(F.count_distinct("output")).first()[0]
        if not outputs:
            return None
        version, schema = self._next(), self._schema()
        shard, size = self._own(schema)
        base = live.agg(F.max("shard")).first()[0]
        new, place = (free_name(n, [*schema.names, shard, size]) for n in ("__to", "__place"))
        to = self._placed(plan, outputs).select(F.col("shard").alias(shard), (F.col("output") + F.lit(base)).alias(new), F.col("place").alias(place))
        moved = self._read(live.join(plan, "shard", "left_semi"), schema).join(to, shard).drop(shard).withColumnRenamed(new, shard)
        merged = self._write(moved.repartition(outputs, F.col(place)).select(*(F.col(f"`{c}`") for c in [*schema.names, size, shard])), shard, size, version)
        self.commit(live.join(plan, "shard", "left_anti").select("shard", "rows", "bytes", "path", "version").union(merged), version, schema)
        return version

    def compacted(self, rounds: int = 16) -> int:
        """Merge until no tier has enough shards; returns the last version."""
        for _ in range(rounds):
            if self.compact() is None:
                break
        return self.versions()[-1]

    def _read(self, live: DataFrame, schema: StructType) -> DataFrame:
        """Rows of the shards given, with their number and bytes; the files are listed, as Spark lists those of any table."""
        shard, size = self._own(schema)
        whole = StructType(list(schema.fields)).add(size, "long").add(shard, "long")
        files = [r[0] for r in live.select("path").distinct().collect()]
        if not files:
            return self.spark.createDataFrame([], whole)
        # a file may hold shards that were merged since
        return self.spark.read.schema(whole).parquet(*files).join(live.select(F.col("shard").alias(shard)), shard, "left_semi")

    def rows(self, version: int | None = None) -> DataFrame:
        """Rows of a version's live shards, with their shard's number."""
        schema = self._schema(version)
        shard, size = self._own(schema)
        return self._read(self.manifest(version), schema).select(*(F.col(f"`{c}`") for c in schema.names), F.col(shard).alias(free_name("shard", schema.names)))

    def expire(self, keep: int = 1) -> int:
        """Forget all but the last versions and delete data that none of those names; for use while no one reads older ones."""
        old = self.versions()[:-keep]
        for v in old:
            manifest = self._told(v)["manifest"]
            self.fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}"), False)
            self.fs.delete(self._path(manifest), True)
        named = set()
        for v in self.versions():
            named |= {r[0].rsplit("/", 2)[1] for r in self.manifest(v).select("path").distinct().collect()}
        root = self._path(f"{self.folder}/data")
        for s in self.fs.listStatus(root) if self.fs.exists(root) else []:
            if s.getPath().getName() not in named:
                self.fs.delete(s.getPath(), True)
        return len(old)


def compacted_store(docs: DataFrame, arrivals: int = 4, **settings) -> ShardStore:
    """A store fed with the rows in several arrivals, compacted after each second one, with its last version kept."""
    store = ShardStore(docs.sparkSession, **settings)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(F.lit(17), F.col(f"`{store.key}`")), F.lit(arrivals)) == k))
        if k % 2 or k == arrivals - 1:
            store.compacted()
            store.expire()
    return store
