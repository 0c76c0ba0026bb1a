"""Exact seeded selection by quota within groups of any size, without one task per group.

Rows of a group are ordered by a seeded hash. The hash range is cut into buckets; sizes are summed per
bucket, and a row's place is the sum of the buckets before its own plus its place inside it. Only rows of
one bucket meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def places(df: DataFrame, group: Sequence[str], key: str, size: str | None = None, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """df with before: the summed size (or number) of the rows of its group that come earlier in the seeded order."""
    group = list(group)
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int")).withColumn("_s", F.col(size) if size else F.lit(1).cast("bigint"))
    sums = rows.groupBy(*group, "_b").agg(F.sum("_s").alias("_t"))
    ahead = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_c"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_b") == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(sums, same).drop("_c", *[f"_g{i}" for i in range(len(group))])
    return joined.withColumn("before", F.col("_before") + F.coalesce(F.sum("_s").over(inside), F.lit(0))).drop("_h", "_b", "_s", "_before")
