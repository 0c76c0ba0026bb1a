"""Evaluation of binary scores. Input: group columns, y (0/1), p (score), pred (0/1)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = [float(x) for x in np.linspace(0, 1, 11)]
BUCKETS = 4096


def confusion(pred: Column) -> list[Column]:
    y = F.col("y")
    return [F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 1)).alias("fp"), F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 0) & (pred == 0)).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _n() -> Column:
    return F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")


def accuracy() -> Column:
    return (F.col("tp") + F.col("tn")) / _n()


def macro_f1() -> Column:
    """Mean F1 of the classes that occur as label or prediction; 0 where a class has no true positive."""
    seen1, seen0 = ((F.col("tp") + F.col("fp") + F.col("fn")) > 0).cast("int"), ((F.col("tn") + F.col("fp") + F.col("fn")) > 0).cast("int")
    return (_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) * seen1 + _ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")) * seen0) / (seen1 + seen0)


def macro_recall() -> Column:
    seen1, seen0 = ((F.col("tp") + F.col("fn") + F.col("fp")) > 0).cast("int"), ((F.col("tn") + F.col("fp") + F.col("fn")) > 0).cast("int")
    return (_ratio(F.col("tp"), F.col("tp") + F.col("fn")) * seen1 + _ratio(F.col("tn"), F.col("tn") + F.col("fp")) * seen0) / (seen1 + seen0)


def bundle(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """n, accuracy, macro F1, macro recall, recall of positives and Brier score per group."""
    c = df.groupBy(*group).agg(*confusion(F.col("pred")), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return c.select(*group, _n().alias("n"), *[F.round(x, 6).alias(a) for a, x in (("accuracy", accuracy()), ("macro_f1", macro_f1()), ("macro_recall", macro_recall()), ("recall_pos", _ratio(F.col("tp"), F.col("tp") + F.col("fn"))), ("brier", F.col("brier")))])


def class_report(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per group and class."""
    c = df.groupBy(*group).agg(*confusion(F.col("pred")))
    rows = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("tp").alias("t"), F.col("fp").alias("f"), F.col("fn").alias("m")), F.struct(F.lit(0).alias("label"), F.col("tn").alias("t"), F.col("fn").alias("f"), F.col("fp").alias("m"))))
    c = c.select(*group, rows.alias("r")).select(*group, "r.label", "r.t", "r.f", "r.m")
    t, f, m = (F.col(x) for x in "tfm")
    return c.select(*group, "label", F.round(_ratio(t, t + f), 6).alias("precision"), F.round(_ratio(t, t + m), 6).alias("recall"), F.round(_ratio(2 * t, 2 * t + f + m), 6).alias("f1"), (t + m).alias("support"))


def threshold_sweep(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Macro F1 and recall at 0.05, 0.10 ... 0.95. Rows are first counted per group, score step and label."""
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame([(round(0.05 * i, 2),) for i in range(1, 20)], "threshold double"))
    steps = [round(0.05 * i, 2) for i in range(1, 20)]
    passed = sum(((F.col("p") >= t).cast("int") for t in steps), F.lit(0))
    c = df.groupBy(*group, "y", passed.alias("passed")).count()
    c = c.crossJoin(grid).withColumn("pred", (F.col("passed") >= F.round(F.col("threshold") / 0.05)).cast("int"))
    y, k = F.col("y"), F.col("count")
    cell = lambda a, b: F.sum(F.when((y == a) & (F.col("pred") == b), k).otherwise(0))
    c = c.groupBy(*group, "threshold").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    return c.select(*group, "threshold", F.round(macro_f1(), 6).alias("macro_f1"), F.round(macro_recall(), 6).alias("macro_recall"))


def best_threshold(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Lowest threshold with the largest macro F1."""
    w = Window.partitionBy(*group).orderBy(F.desc("macro_f1"), "threshold")
    return threshold_sweep(df, group).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def score_bin(p: Column) -> Column:
    """Bin 0-9 between the edges of linspace(0, 1, 11), closed to the left; 1.0 is in bin 10."""
    return sum(((p >= e).cast("int") for e in EDGES[1:]), F.lit(0))


def reliability(df: DataFrame, group: Sequence[str]) -> DataFrame:
    c = df.groupBy(*group, score_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("p_mean"), F.round(F.avg("y"), 6).alias("y_mean"))
    return c.where("bin < 10")


def ece(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Expected calibration error over ten bins; scores of exactly 1 are in no bin but count in n."""
    c = df.groupBy(*group, score_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("pm"), F.avg("y").alias("ym"))
    gap = F.sum(F.when(F.col("bin") < 10, F.col("n") * F.abs(F.col("pm") - F.col("ym"))).otherwise(0.0))
    return c.groupBy(*group).agg(F.round(gap / F.sum("n"), 6).alias("ece"))


def roc_auc(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null with one class.

    Ranks come from counts per distinct score: within one of many score ranges, plus the rows of the ranges below.
    """
    b = F.least(F.floor(F.col("p") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    c = df.groupBy(*group, b.alias("b"), "p").agg(F.count_if(F.col("y") == 1).alias("a"), F.count("*").alias("k"))
    ranges = c.groupBy(*group, "b").agg(F.sum("k").alias("t"))
    ranges = ranges.withColumn("below", F.coalesce(F.sum("t").over(Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = F.coalesce(F.sum("k").over(Window.partitionBy(*group, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("inside", inside).join(ranges, [*group, "b"])
    c = c.groupBy(*group).agg(F.sum(F.col("a") * (F.col("below") + F.col("inside") + (F.col("k") + 1) / 2)).alias("ranks"), F.sum("a").alias("pos"), (F.sum("k") - F.sum("a")).alias("neg"))
    return c.select(*group, F.round((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0)), 6).alias("roc_auc"))


def quartile(df: DataFrame, value: str) -> DataFrame:
    """df with q: Q1 to Q4 by quartiles of value, closed to the right."""
    cut = F.broadcast(df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e")))
    v, e = F.col(value), F.col("_e")
    return df.crossJoin(cut).withColumn("q", F.when(v <= e[0], "Q1").when(v <= e[1], "Q2").when(v <= e[2], "Q3").otherwise("Q4")).drop("_e")


def bootstrap_std(df: DataFrame, replicates: int = 100, seed: int = 7) -> DataFrame:
    """Sample deviation of accuracy and Brier score over Poisson bootstrap replicates, in one pass of replicate weights."""
    r = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")
    u = F.abs(F.xxhash64("key", "r", F.lit(seed))) / F.lit(2.0**63)
    weight = F.lit(0)
    total = 0.0
    term = float(np.exp(-1.0))
    for k in range(8):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k + 1
    c = df.select("key", "y", "p", "pred", r).withColumn("w", weight).groupBy("r").agg(
        (F.sum(F.col("w") * (F.col("y") == F.col("pred")).cast("int")) / F.sum("w")).alias("acc"), (F.sum(F.col("w") * F.pow(F.col("p") - F.col("y"), 2)) / F.sum("w")).alias("brier")
    )
    return c.agg(F.stddev_samp("acc").alias("acc_std"), F.stddev_samp("brier").alias("brier_std"))
