"""When requests may start if a host is left a pause between them."""

from pyspark.sql import DataFrame, Window, functions as F


def paced(requests: DataFrame, gap: float, host: str = "host", at: str = "at", tie: str = "id") -> DataFrame:
    """Adds start: the first moment, in the order of asking, that is not before the request and gap seconds after the
    host's last start. With the k-th request asked for at t_k that is k * gap + max(t_j - j * gap) over j up to k,
    so it takes a running maximum and no loop. Times have microseconds; a gap of 0 changes nothing.
    """
    step = int(gap * 1_000_000)
    order = Window.partitionBy(host).orderBy(at, tie)
    k = F.row_number().over(order).cast("long") * step
    led = requests.withColumn("__k", k).withColumn("__free", F.unix_micros(F.col(at).cast("timestamp")) - F.col("__k"))
    start = F.max("__free").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__k")
    return led.withColumn("start", F.timestamp_micros(start)).drop("__k", "__free")
