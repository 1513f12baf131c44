"""Row order within a key, without putting a whole key into one task.

A plain ``lag`` or running total over a key sorts all its rows in one task.  Here the
rows of a key are cut by a bucket (a day, a block of positions): the window runs inside
a bucket, and what crosses buckets travels through one summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_by_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Sequence[str]
) -> DataFrame:
    """Adds ``prev``: a struct of ``values`` of the previous row of the key, or null."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bucket", bucket).withColumn("_row", F.struct(*values))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tails = rows.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.struct(*order)).alias("_tail"))
    before = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ).drop("_tail")
    near = rows.withColumn("_near", F.lag("_row").over(inside))
    same = [near[c].eqNullSafe(before[c]) for c in [*keys, "_bucket"]]
    test = same[0]
    for s in same[1:]:
        test = test & s
    joined = near.join(before, test, "left").select(
        *[near[c] for c in df.columns], F.coalesce(near["_near"], before["_carry"]).alias("prev")
    )
    return joined


def running_total_by_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows up to and including this one."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_bucket")
    )
