"""The catalogue of built results: caches with expiry, item lists, build history, tracked sources.

Tables are DataFrames; an operation returns the table as it is afterwards.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .items import first_by


def valid_at(cache: DataFrame, now: str | Column, forever: bool = False) -> DataFrame:
    """Rows not yet expired; with forever an expiry of null or 0 never comes."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    alive = F.col("expires_at") >= now
    return cache.where(alive | F.col("expires_at").isNull() if forever else alive)


def expired(cache: DataFrame, now: str) -> DataFrame:
    """What a prune removes: rows whose expiry is past, also those without one."""
    return cache.where(~F.coalesce(F.col("expires_at") >= F.lit(now).cast("timestamp"), F.lit(False)))


def orphans(items: DataFrame, cache: DataFrame, key: str = "feed_key") -> DataFrame:
    """Items of results that are no longer in the cache."""
    return items.join(cache.select(key).distinct(), key, "left_anti")


def swept(items: DataFrame, cache: DataFrame, key: str = "feed_key") -> DataFrame:
    return items.join(cache.select(key).distinct(), key, "left_semi")


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*key, "__last.*").select(*rows.columns)


def put(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Upsert: a key's row is the new one; of several new ones the last by order."""
    new = last_by(rows, key, order) if order else rows
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def replaced(items: DataFrame, rows: DataFrame, key: str = "feed_key", inner: str = "url", position: str = "position") -> DataFrame:
    """The item lists of the results that rows holds are replaced whole; of equal urls in a list the last position stays."""
    kept = items.join(rows.select(key).distinct(), key, "left_anti")
    return kept.unionByName(first_by(rows, [key, inner], [-F.col(position)]))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def forgotten(cache: DataFrame, items: DataFrame, builds: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the results named."""
    return without(cache, keys, "feed_key"), without(items, keys, "feed_key"), without(builds, keys, "feed_key")


def recorded(builds: DataFrame, row: DataFrame) -> DataFrame:
    """The history with another attempt; ids go on rising."""
    last = builds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    numbered = row.crossJoin(F.broadcast(last)).withColumn("id", F.col("__last") + F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).drop("__last")
    return builds.unionByName(numbered.select(*builds.columns))


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are added."""
    return table.unionByName(new_rows(table, rows, key))


def new_rows(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(table.select(*key), key, "left_anti").dropDuplicates(key).select(*table.columns)


def first_seen(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(at).alias("first_seen_at"))


def merged_items(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], digest: str = "content_hash", body: str = "content_html") -> DataFrame:
    """Upsert in which only values that are not empty replace others; adds changed.

    A row whose digest is the same and whose body is there already stays as it is.
    """
    o = old.select(*key, F.struct(*fields).alias("o"))
    n = new.select(*key, F.struct(*fields).alias("n"))
    both = o.join(n, key, "full_outer")
    same = F.coalesce((F.col(f"o.{digest}") == F.col(f"n.{digest}")) & (F.coalesce(F.col(f"o.{body}"), F.lit("")) == F.coalesce(F.col(f"n.{body}"), F.lit(""))), F.lit(False))
    changed = F.col("n").isNotNull() & (F.col("o").isNull() | ~same)

    def field(c: str) -> Column:
        value = F.col(f"n.{c}")
        empty = value.isNull() | (value.cast("string") == "")
        return F.when(changed & ~empty, value).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*key, *(field(c) for c in fields), changed.alias("changed"))


def latest(builds: DataFrame, key: str = "feed_key") -> DataFrame:
    """The attempt with the highest id of each result."""
    return first_by(builds, [key], [-F.col("id")])


def latest_by_join(builds: DataFrame, key: str = "feed_key") -> DataFrame:
    """The same, as a join to the highest ids."""
    top = builds.groupBy(key).agg(F.max("id").alias("id"))
    return builds.join(top, [key, "id"], "left_semi")


def ranked(builds: DataFrame, key: str = "feed_key") -> DataFrame:
    """Adds rank, 1 for the newest attempt of each result."""
    return builds.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("built_at"), F.desc("id"))))


def pruned(builds: DataFrame, keep: int = 20, key: str = "feed_key") -> DataFrame:
    return ranked(builds, key).where(F.col("rank") <= max(1, keep)).drop("rank")


def history(builds: DataFrame, feed_key, n: int = 20) -> DataFrame:
    return builds.where(F.col("feed_key") == feed_key).orderBy(F.desc("built_at"), F.desc("id")).limit(n)


def newest_items(items: DataFrame, n: int = 50) -> DataFrame:
    return items.orderBy(F.desc(F.coalesce("published_at", "fetched_at")), F.desc("id")).limit(n)


def cache_listing(cache: DataFrame, n: int = 200) -> DataFrame:
    """Newest bodies by size, without the bodies."""
    sized = cache.withColumn("body_bytes", F.octet_length("body")).drop("body")
    return sized.orderBy(F.desc("fetched_at"), "feed_key").limit(n)
