"""Weekly tail rate and latest-answer compilation as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_tail(events: DataFrame, ts: str, score: str, threshold: float, late: str = "7 days") -> DataFrame:
    """week_start, n, tail_rate over Monday weeks; rows later than the watermark are dropped."""
    week = F.window(ts, "7 days", "7 days", "4 days")
    return (
        events.withWatermark(ts, late).groupBy(week.alias("w")).agg(F.count("*").alias("n"), F.avg((F.col(score) >= threshold).cast("int")).alias("tail_rate"))
        .select(F.col("w.start").alias("week_start"), "n", "tail_rate")
    )


def latest_answers(log: DataFrame, ts: str, key: str = "message_id") -> DataFrame:
    """The latest record free of errors of every key, all columns; of equal times the greatest record. In update mode a later record replaces an earlier one.

    The state holds a record per key for as long as the query runs, since any of them can still be replaced.
    """
    kept = F.max_by(F.struct("*"), F.struct(ts, F.to_json(F.struct("*"))))
    return log.where("error is null").groupBy(F.col(key).alias("_key")).agg(kept.alias("r")).select("r.*")
