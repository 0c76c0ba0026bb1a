"""Mix sources to target shares of the total size, with a cap on repeats.

Capped water-filling on the table of sources: every source gets its share of the total, those that would
need more than their cap are clamped at it and their excess goes to the rest in proportion to their shares,
until all fit. Each round is one aggregate over the sources, so their number is not limited. A source is
then taken whole as often as its epochs allow, and the fraction that is left is a seeded sample of its
documents up to the missing size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.quota import places
from chatterloom.session import small, stage

MAX_BROADCAST_ROWS = 500_000


def water_level(sources: DataFrame, total: float | None = None) -> float:
    """Size per unit of share at which the sources add up to total, those above their cap clamped at it.

    sources: share, cap (largest size). total None: the largest total at which no source that has anything is
    clamped, so all shares are met. Sources without share or cap take no part; if all are clamped, the level is infinite.
    """
    live = sources.where("share > 0 and cap > 0")
    whole = live.agg(F.sum("share").alias("share"), F.min(F.col("cap") / F.col("share")).alias("lowest")).first()
    if not whole["share"]:
        return 0.0
    if total is None:
        return whole["lowest"]
    level, clamped = float(total) / whole["share"], 0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("share")
        now = live.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("share"))).alias("share")).first()
        if now["n"] == clamped:
            return level
        clamped = now["n"]
        if not now["share"]:
            return float("inf")
        level = max(level, (total - now["cap"]) / now["share"])


def filled(sources: DataFrame, total: float | None = None) -> DataFrame:
    """sources with planned, the size each contributes."""
    level = water_level(sources, total)
    live = (F.col("share") > 0) & (F.col("cap") > 0)
    return sources.withColumn("planned", F.when(live, F.least(F.col("cap"), F.lit(level) * F.col("share"))).otherwise(0.0))


def mix(sized: DataFrame, shares: DataFrame, key: str, source: str, size: str, total: float | str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents: key, source, size, copies >= 1; report per source).

    sized: key, source, size. shares: source, target_share, max_repeats, once per source; null shares and
    repeats count as 0. Documents of unlisted or null sources and of size 0 are not used. The sampled part of
    a source ends with the document that brings it closest to its size. total "all": one epoch of all listed
    sources, in their units.
    """
    sized = sized.where(F.col(size) > 0).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).alias("_size"))
    held = sized.groupBy("_source").agg(F.sum("_size").alias("available"))
    listed = shares.select(F.col("source").alias("_source"), "target_share", "max_repeats").join(held, "_source", "left")
    listed = listed.select("_source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    share, repeats = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))
    listed = stage(listed.withColumn("share", share).withColumn("cap", (F.col("available") * repeats).cast("double")), "sources")
    if total == "all":
        total = float(listed.agg(F.sum("available")).first()[0] or 0)
    epochs = F.when(F.col("available") > 0, F.floor(F.col("planned") / F.col("available"))).otherwise(0).cast("int")
    plan = stage(filled(listed, total).withColumn("whole", epochs).withColumn("rest", F.col("planned") - F.col("whole") * F.col("available")), "mix-plan")
    ranked = places(sized.join(small(plan.select("_source", "whole", "rest"), MAX_BROADCAST_ROWS), "_source"), ["_source"], "_key", "_size", seed)
    copies = F.col("whole") + (F.col("before") + F.col("_size") / 2 <= F.col("rest")).cast("int")
    documents = stage(ranked.select("_key", "_source", "_size", copies.alias("copies")).where("copies > 0"), "mixed")
    used = documents.groupBy("_source").agg(F.sum(F.col("_size") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"), F.count("*").alias("used_docs"))
    mixed = F.coalesce("mixed", F.lit(0))
    whole = documents.agg(F.sum(F.col("_size") * F.col("copies")).alias("all_mixed"))
    report = (
        plan.join(used, "_source", "left").join(F.broadcast(whole))
        .select(F.col("_source").alias(source), "target_share", "max_repeats", "available", F.round("planned", 3).alias("planned"), mixed.alias("mixed"), F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
                F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(mixed / F.nullif("all_mixed", F.lit(0)), 6).alias("real_share"))
    )
    return documents.toDF(key, source, size, "copies"), report


def _whole():
    """Window over a result of a row per source or split."""
    return Window.partitionBy(F.lit(0))
