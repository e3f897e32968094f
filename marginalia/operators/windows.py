"""Windows that stay distributed when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_in_buckets(
    df: DataFrame, key: str, order: list[str], bucket: Column, columns: list[str]
) -> DataFrame:
    """Adds ``prev_<column>``: the values of the row before, per ``key`` in ``order``.

    ``bucket`` has to grow with the order. The lag is taken inside (key, bucket) first.
    Only the first and the last row of every bucket take part in a second window over
    the key; all others pass it in a group of their bucket. So the largest group is a
    bucket, or two rows per bucket of one key, and the input is read once.
    """
    here = F.struct(*columns)
    slot = F.coalesce(bucket, F.lit(-(2**62)))
    inside = Window.partitionBy(key, "__slot").orderBy(*order)
    first = df.withColumn("__slot", slot).select(
        "*",
        F.lag(here).over(inside).alias("__before"),
        F.lead(F.lit(True), 1, False).over(inside).alias("__more"),
    )
    edge = F.col("__before").isNull() | ~F.col("__more")
    group = F.when(~edge, F.col("__slot"))  # NULL: the edges of all buckets of a key
    across = Window.partitionBy(key, "__group").orderBy(*order)
    before = F.coalesce("__before", F.lag(here).over(across))
    return (
        first.withColumn("__group", group)
        .withColumn("__before", before)
        .select(*df.columns, *[F.col("__before")[c].alias(f"prev_{c}") for c in columns])
    )
