import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from loomglass.llm.sharding import ShardStore, compacted_store


def test_versions_are_atomic_and_compaction_keeps_rows(spark, edges):
    store = ShardStore(spark, small=500, target=4000, fan=2)
    docs = edges.select("doc_id", "text", "n").unionByName(spark.range(200).select("id", F.repeat(F.lit("abc "), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("n")).withColumnRenamed("id", "doc_id"))
    for k in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k))
    assert store.versions() == [1, 2, 3]
    before = store.manifest()
    small = before.where("bytes < 2000").count()
    last = store.compacted()
    after = store.manifest()
    assert last > 3 and after.where("bytes < 2000").count() < small and after.count() < before.count()
    total = lambda m: m.agg(F.sum("rows"), F.sum("bytes")).first()
    assert total(before) == total(after)
    key = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n) for r in df.select("doc_id", "text", "n").collect())
    assert key(store.rows()) == key(docs) == key(store.rows(3))  # an older version still reads
    with pytest.raises(RuntimeError):
        store.commit(after, last)  # taken
    store.expire(1)
    assert store.versions() == [last] and key(store.rows()) == key(docs)


def test_merged_shards_reach_the_target(spark):
    store = ShardStore(spark, small=1000, target=8000, fan=4)
    store.append(spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text")))
    store.compacted()
    sizes = [r.bytes for r in store.manifest().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 8000 and sum(s * 2 < 8000 for s in sizes) < 4


def test_edges(spark, edges, nothing):
    assert compacted_store(edges).rows().count() == len(EDGES)
    store = ShardStore(spark)
    assert store.rows().count() == 0
    assert store.append(nothing.select("doc_id", "text")) == 1 and store.manifest().count() == 0 and store.compact() is None
    assert store.rows().columns == ["doc_id", "text", "shard"] and store.rows().count() == 0
    assert compacted_store(nothing).rows().columns == [*nothing.columns, "shard"]
    with pytest.raises(ValueError):
        store.append(nothing.select("text", "doc_id"))


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "text", "output", "shard", "__shard", "__bytes", "__path", "__to", "rows", "bytes", "path", "tier", "a.b"]
    docs = spark.createDataFrame([(k, "t" * k, *range(100 + k, 110 + k), f"x{k}") for k in range(60)], ", ".join(f"`{n}` {'string' if n in ('text', 'a.b') else 'long'}" for n in names))
    store = compacted_store(docs, small=100, target=700, fan=2)
    rows = store.rows()
    assert rows.columns == [*names, "shard_"] and store.versions()[-1] > 4
    assert sorted(tuple(r)[:-1] for r in rows.collect()) == sorted(map(tuple, docs.collect()))
    again = ShardStore(spark, store.folder)  # what a reader needs stands in the folder
    assert again.rows().columns == rows.columns and again.rows().count() == 60
    numbers = {r.shard: r["rows"] for r in store.manifest().collect()}
    assert {r.shard_: r["count"] for r in rows.groupBy("shard_").count().collect()} == numbers


def test_a_pointer_without_content_is_no_version(spark, edges):
    store = ShardStore(spark)
    store.append(edges.select("doc_id", "text"))
    store.fs.create(store._path(f"{store.folder}/manifest/v00000002"), False).close()  # its writer stopped here
    assert store.versions() == [1] and store.rows().count() == len(EDGES)
    assert store.append(edges.select("doc_id", "text")) == 3 and store.rows().count() == 2 * len(EDGES)


def test_an_arrival_takes_no_shuffle_and_a_merge_as_many_tasks_as_outputs(spark):
    store = ShardStore(spark, small=1000, target=8000, fan=4)
    docs = spark.range(0, 400, 1, 40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    store.append(docs)
    assert store.manifest().count() == 40 and store.manifest().select("path").distinct().count() == 40
    store.compacted()
    live = store.manifest().collect()
    assert sum(r.bytes for r in live) == 40_000 and max(r.bytes for r in live) <= 9000 and len(live) <= 6


def test_each_output_has_a_task_of_its_own(spark):
    store = ShardStore(spark, small=100, target=2500, fan=2)
    store.append(spark.range(0, 1200, 1, 120).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text")))
    plan = store.plan(store.manifest())
    outputs = plan.agg(F.count_distinct("output")).first()[0]
    assert outputs > 20
    rows = store._placed(plan, outputs).repartition(outputs, "place").select("output", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(rows) == outputs == len({r.p for r in rows})
