"""Counters and histograms over run records."""

from pyspark.sql import DataFrame, functions as F

# Upper bounds of the usual duration buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(df: DataFrame, labels: list[str], **sums) -> DataFrame:
    """Counts, and sums of columns or conditions, by labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("total"), *(F.sum(c).alias(n) for n, c in sums.items()))


def histogram(df: DataFrame, value: str, labels: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts under each bound, the sum and the count, by labels; a row for each bound and +Inf."""
    under = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(buckets)]
    wide = df.groupBy(*labels).agg(*under, F.count(value).alias("n"), F.sum(value).alias("s"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("cumulative")) for k, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative"))]
    return wide.select(*labels, F.explode(F.array(*rows)).alias("r"), F.col("n").alias("count"), F.col("s").alias("sum")).select(*labels, "r.le", "r.cumulative", "count", "sum")
