"""Fill missing channel and date of core rows from a raw corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.functions.text import key_exact, key_fuzzy, parse_date


def unique_channel_fill(core: DataFrame, raw: DataFrame, key_of: Callable[[Column], Column]) -> DataFrame:
    """row_id, match_count, match_channels, filled_channel, filled_date of the rows with neither channel nor date.

    Rows match corpus texts by key. Channel and smallest date are filled only if all matches name one channel.
    The corpus is summed per key before the join, so an empty or very common key meets each row once.
    """
    missing = core.where("channel is null and msg_date is null").select("row_id", key_of(F.col("message")).alias("key"))
    texts = raw.select(key_of(F.col("text")).alias("key"), "channel", parse_date(F.col("msg_date")).alias("ts"))
    texts = texts.join(missing.select("key").distinct(), "key", "left_semi")
    one = F.count_distinct("channel") == 1
    per = texts.groupBy("key").agg(
        F.count("*").alias("match_count"), F.array_join(F.array_sort(F.collect_set("channel")), ";").alias("match_channels"),
        F.when(one, F.min("channel")).alias("filled_channel"), F.when(one, F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss")).alias("filled_date"),
    )
    return missing.join(per, "key", "left").select("row_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("match_channels", F.lit("")).alias("match_channels"), "filled_channel", "filled_date")


def exact_fill(core: DataFrame, raw: DataFrame) -> DataFrame:
    return unique_channel_fill(core, raw, key_exact)


def fuzzy_fill(core: DataFrame, raw: DataFrame) -> DataFrame:
    return unique_channel_fill(core, raw, key_fuzzy)


def date_fill(core: DataFrame, raw: DataFrame) -> DataFrame:
    """row_id, filled_date of rows with a channel and no date: earliest readable date of the same channel and numeric msg_id."""
    rows = core.where("channel is not null and msg_date is null").select("row_id", "channel", F.expr("try_cast(msg_id as bigint)").alias("m")).where("m is not null")
    dates = raw.select("channel", F.expr("try_cast(msg_id as bigint)").alias("m"), parse_date(F.col("msg_date")).alias("ts")).where("m is not null and ts is not null")
    first = dates.groupBy("channel", "m").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("filled_date"))
    return rows.join(first, ["channel", "m"], "left").select("row_id", "filled_date")


def merged(core: DataFrame, raw: DataFrame) -> DataFrame:
    """row_id, channel, msg_date and where each came from: the exact match first, then the fuzzy one, then the row's own; dates by message number last."""
    exact, fuzzy, dates = (f.select("row_id", *[F.col(c).alias(f"{n}_{c}") for c in f.columns if c.startswith("filled")]) for n, f in (("exact", exact_fill(core, raw)), ("fuzzy", fuzzy_fill(core, raw)), ("number", date_fill(core, raw))))
    rows = core.select("row_id", "channel", "msg_date").join(exact, "row_id", "left").join(fuzzy, "row_id", "left").join(dates, "row_id", "left")
    came = F.when(F.col("exact_filled_channel").isNotNull(), "exact").when(F.col("fuzzy_filled_channel").isNotNull(), "fuzzy").when(F.col("channel").isNotNull(), "own")
    return rows.select(
        "row_id", F.coalesce("exact_filled_channel", "fuzzy_filled_channel", "channel").alias("channel"),
        F.coalesce("exact_filled_date", "fuzzy_filled_date", "msg_date", "number_filled_date").alias("msg_date"), came.alias("channel_from"),
    )


def fill_summary(filled: DataFrame) -> DataFrame:
    matched, many = F.col("match_count") > 0, F.col("match_channels").contains(";")
    return filled.agg(
        F.count("*").alias("missing_rows"), F.count_if(matched).alias("matched"), F.count("filled_channel").alias("filled"),
        F.count_if(matched & many).alias("several_channels"), F.count_if(F.col("filled_channel").isNull()).alias("remaining"),
    )
