"""Bodies of items: the join to their items and the drop of boilerplate."""

from pyspark.sql import DataFrame, functions as F

REPEATS = 3


def digests(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.withColumn("digest", F.sha2(F.col(body).cast("binary"), 256))


def with_boilerplate(bodies: DataFrame, body: str = "body", by: list[str] | None = None) -> DataFrame:
    """Adds boilerplate: the body stands REPEATS times or more in its run, or is all the run's bodies (of two or more).

    Counts are pre-aggregated and joined back, so a body that a third of the
    rows share costs one row a task.
    """
    keys = by or []
    d = digests(bodies, body)
    same = d.groupBy(*keys, "digest").agg(F.count("*").alias("__same"))
    if keys:
        total = same.groupBy(*keys).agg(F.sum("__same").alias("__all"))
        out = d.join(same, [*keys, "digest"], "left").join(total, keys, "left")
    else:
        out = d.join(same, "digest", "left").crossJoin(F.broadcast(same.agg(F.sum("__same").alias("__all"))))  # one row
    flag = F.when(F.col(body).isNull(), False).otherwise((F.col("__all") >= 2) & ((F.col("__same") >= REPEATS) | (F.col("__same") == F.col("__all"))))
    return out.withColumn("boilerplate", flag).drop("__same", "__all", "digest")


def attached(items: DataFrame, bodies: DataFrame, key: str = "norm_link") -> DataFrame:
    """Items with their bodies, null where there is none."""
    return items.join(bodies, key, "left")


def body_counts(bodies: DataFrame, body: str = "body", by: list[str] | None = None) -> DataFrame:
    """fetched, failed and dropped as boilerplate; what is dropped counts as failed."""
    flagged = with_boilerplate(bodies, body, by)
    bad = F.col("boilerplate") | F.col(body).isNull()
    return flagged.groupBy(*(by or [])).agg(F.count_if(~bad).alias("fetched"), F.count_if(bad).alias("failed"), F.count_if("boilerplate").alias("dropped"))
