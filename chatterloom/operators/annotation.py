"""Compile logs of model answers: resume, latest record wins, pivots, agreement, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.text import utrim

SIGNALS = tuple(f"signal_{i:02d}" for i in range(1, 20))
RECORD = "message_id bigint, model string, p_high_risk double, y_pred int, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, raw string, elapsed_s double, error string"


def remaining(todo: DataFrame, log: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows of todo without a record free of errors in log."""
    return todo.join(log.where("error is null").select(key).distinct(), key, "left_anti")


def remaining_pairs(todo: DataFrame, log: DataFrame, signals: Sequence[str], key: str = "message_id") -> DataFrame:
    """(key, signal_key) pairs without a record free of errors."""
    grid = F.broadcast(todo.sparkSession.createDataFrame([(s,) for s in signals], "signal_key string"))
    return todo.select(key).crossJoin(grid).join(log.where("error is null").select(key, "signal_key").distinct(), [key, "signal_key"], "left_anti")


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record per keys in order, errors aside."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return log.where("error is null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def signal_code(answer):
    return F.when(answer == "Yes", 1).when(answer == "No", 0).when(answer == "Unsure", -1)


def signal_table(answers: DataFrame, signals: Sequence[str], key: str = "message_id") -> DataFrame:
    """One column per signal (1, 0, -1), only of messages that have all."""
    wide = answers.groupBy(key).pivot("signal_key", list(signals)).agg(F.first(signal_code(F.col("answer"))))
    return wide.dropna(subset=list(signals))


def usage(log: DataFrame, group: str, price_in: float = 0.15e-6, price_out: float = 0.6e-6) -> DataFrame:
    """Records, errors, tokens, seconds and cost per group; missing usage counts as 0."""
    u = lambda f: F.sum(F.coalesce(F.col(f"usage.{f}"), F.lit(0)))
    return log.groupBy(group).agg(
        F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("err"), u("prompt_tokens").alias("prompt_tokens"), u("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("elapsed_s"), 6).alias("elapsed_s"), F.round(u("prompt_tokens") * price_in + u("completion_tokens") * price_out, 6).alias("cost"),
    )


def parsed_labels(text):
    """Map of the last value of each of the four keys in "key: value" lines; lines that start with m and digits are skipped."""
    keys = ("theme", "claim_types", "ctas", "evidence")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: ~F.lower(x).rlike(r"^m\d+"))

    def last(k: str):
        return F.try_element_at(F.filter(lines, lambda x: F.lower(x).rlike(rf"^{k}\s*:")), F.lit(-1))

    pairs = [F.struct(F.lit(k).alias("k"), F.trim(F.regexp_extract(last(k), r"^[^:]*:(.*)$", 1)).alias("v")) for k in keys]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))


def value_list(c):
    """Distinct sorted values between commas and semicolons, dashes made plain."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.translate(c, "‑–—", "---"), "[,;]"), utrim), lambda x: x != "")))
