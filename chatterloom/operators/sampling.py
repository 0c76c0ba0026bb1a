"""Deterministic splits: order by md5 of key and seed in place of a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: str, seed) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), (seed if not isinstance(seed, int) else F.lit(seed)).cast("string")))


def group_split(df: DataFrame, group: str, seeds: Sequence[int], share: float = 0.2) -> DataFrame:
    """seed, group, split: the first ceil(share) of the groups in seeded order are test. Shares are of groups, not rows."""
    grid = F.broadcast(df.sparkSession.createDataFrame([(s,) for s in seeds], "seed int"))
    g = df.where(F.col(group).isNotNull()).select(group).distinct().crossJoin(grid)
    g = g.withColumn("o", order_key(group, F.col("seed")))
    w = Window.partitionBy("seed")
    g = g.withColumn("r", F.row_number().over(w.orderBy("o", group))).withColumn("n", F.count("*").over(w))
    return g.select("seed", group, F.when(F.col("r") <= F.ceil(F.col("n") * share), "test").otherwise("train").alias("split"))


def best_group_split(df: DataFrame, group: str, label: str, seeds: Sequence[int]) -> DataFrame:
    """seed, test share of rows, rates and score of each split; the best seed has the smallest gap of rates, then the smallest seed."""
    per = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    s = per.join(group_split(df.where(F.col(label).isNotNull()), group, seeds), group)
    t = F.col("split") == "test"
    s = s.groupBy("seed").agg(F.sum(F.when(t, F.col("n"))).alias("nt"), F.sum("n").alias("n"), F.sum(F.when(t, F.col("pos"))).alias("pt"), F.sum("pos").alias("p"))
    s = s.select("seed", F.round(F.col("nt") / F.col("n"), 6).alias("test_share"), F.round(F.col("pt") / F.col("nt"), 6).alias("test_rate"), F.round((F.col("p") - F.col("pt")) / (F.col("n") - F.col("nt")), 6).alias("train_rate"))
    s = s.withColumn("gap", F.round(F.abs(F.col("test_rate") - F.col("train_rate")), 6))
    return s.withColumn("is_best", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gap", "seed")) == 1).cast("int"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int, share: float = 0.125) -> DataFrame:
    """key, label, split: the seeded first round(share) of each label are val."""
    w = Window.partitionBy(label)
    r = df.where(F.col(label).isNotNull()).select(key, label).withColumn("r", F.row_number().over(w.orderBy(order_key(key, seed), key))).withColumn("n", F.count("*").over(w))
    return r.select(key, label, F.when(F.col("r") <= F.round(F.col("n") * share), "val").otherwise("train").alias("split"))


def leave_one_out(df: DataFrame, key: str, held: str, group: str, least_train: int = 1000) -> DataFrame:
    """Per held-out value: test rows, train rows whose group has no test row, and whether the fold is usable."""
    rows = df.where(F.col(held).isNotNull()).select(key, held, group)
    folds = F.broadcast(rows.select(F.col(held).alias("fold")).distinct())
    per = rows.groupBy(held, group).agg(F.count("*").alias("n"))
    x = per.crossJoin(folds)
    test = x.where(F.col(held) == F.col("fold"))
    seen = test.select(F.col("fold").alias("f"), F.col(group).alias("g")).distinct()
    train = x.where(F.col(held) != F.col("fold")).join(seen, (F.col("fold") == F.col("f")) & (F.col(group) == F.col("g")), "left_anti")
    a = test.groupBy("fold").agg(F.sum("n").alias("n_test"))
    b = train.groupBy("fold").agg(F.sum("n").alias("n_train"))
    return a.join(b, "fold", "left").select("fold", "n_test", F.coalesce("n_train", F.lit(0)).alias("n_train"), (F.coalesce("n_train", F.lit(0)) >= least_train).cast("int").alias("usable"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in seeded order (a sampling operator: the limit is its feature)."""
    return df.orderBy(order_key(key, seed), key).limit(n)
