"""Tag dynamics over time: tables are long (period, tag, n, ...) until they are shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.text import has_url, parse_date, split_multi, week_label

TAGS = ("theme", "claim_types", "ctas", "evidence")
# quantiles between two scores of six digits have up to eight; at six they would often stand on a tie
MEDIAN_DIGITS = 8


def _all():
    """Window over a whole result; only used on results with a row per tag or period."""
    return Window.partitionBy(F.lit(0))


def base_table(core: DataFrame, start: str = "2024-01-01", end: str = "2025-01-01") -> DataFrame:
    """Rows with channel and readable date in [start, end), with time grains, filled tags and prototype key."""
    ts = parse_date(F.col("msg_date"))
    rows = core.where(F.col("channel").isNotNull()).withColumn("ts", ts).where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    rows = rows.select(
        "row_id", "channel", "ts", F.col("combined_proba").alias("p"), *[F.coalesce(F.col(t), F.lit("NA")).alias(t) for t in TAGS],
        F.coalesce(F.length("message"), F.lit(0)).alias("msg_len"), F.coalesce(has_url(F.col("message")), F.lit(0)).alias("has_url"),
    )
    return rows.select(
        "row_id", "channel", F.date_format("ts", "yyyy-MM-dd").alias("day"), week_label(F.col("ts")).alias("week"), F.date_format("ts", "yyyy-MM").alias("month"), F.year("ts").alias("year"),
        "p", *TAGS, F.concat_ws(" || ", *TAGS).alias("prototype"), "msg_len", "has_url",
    )


def with_tail(base: DataFrame, q: float = 0.95) -> DataFrame:
    """base with is_high_tail: score at or above its q-quantile. The quantile is one row, broadcast."""
    cut = base.agg(F.percentile("p", F.lit(q)).alias("_cut"))
    return base.crossJoin(F.broadcast(cut)).withColumn("is_high_tail", F.coalesce((F.col("p") >= F.col("_cut")).cast("int"), F.lit(0))).drop("_cut")


def tags_of(base: DataFrame, field: str) -> DataFrame:
    """base with one row per tag; theme is a single value."""
    tag = F.col(field) if field == "theme" else F.explode(split_multi(F.col(field)))
    return base.withColumn("tag", tag)


def tag_table(base: DataFrame, field: str) -> DataFrame:
    """Per tag: n, mean, median, risk mass, tail rate, shares of instances and of risk mass, lift of the tail."""
    rate = F.broadcast(base.agg(F.avg("is_high_tail").alias("base_rate")))
    t = tags_of(base, field).groupBy("tag").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean"), F.median("p").alias("median"), F.sum("p").alias("mass"), F.avg("is_high_tail").alias("tail_rate")
    )
    t = t.withColumn("msg_share", F.col("n") / F.sum("n").over(_all())).withColumn("mass_share", F.col("mass") / F.sum("mass").over(_all())).crossJoin(rate)
    return t.select("tag", "n", *[F.round(c, MEDIAN_DIGITS if c == "median" else 6).alias(c) for c in ("mean", "median", "mass", "tail_rate", "msg_share", "mass_share")], F.round(F.col("tail_rate") / F.nullif(F.col("base_rate"), F.lit(0)), 6).alias("lift"))


def period_shares(base: DataFrame, period: str, field: str, top: int | None = None, by_mass: bool = False) -> DataFrame:
    """Share of each tag per period, of messages or of risk mass; tags beyond the top most are Other.

    The denominator is all messages (or mass) of the period, so shares of multi-valued fields may add to more than 1.
    """
    value = F.sum("p") if by_mass else F.count("*")
    counts = tags_of(base, field).groupBy(period, "tag").agg(value.alias("v"))
    if top:
        lead = counts.groupBy("tag").agg(F.sum("v").alias("t")).orderBy(F.desc("t"), "tag").limit(top).select(F.col("tag").alias("lead"))
        counts = counts.join(F.broadcast(lead), F.col("tag") == F.col("lead"), "left").groupBy(period, F.coalesce("lead", F.lit("Other")).alias("tag")).agg(F.sum("v").alias("v"))
    total = base.groupBy(period).agg(value.alias("total"))
    return counts.join(total, period).select(period, "tag", F.round("v", 6).alias("v"), F.round(F.col("v") / F.nullif(F.col("total"), F.lit(0)), 6).alias("share"))


def entropy(base: DataFrame, period: str, field: str) -> DataFrame:
    """Shannon entropy (nats) of the tags of each period."""
    c = tags_of(base, field).groupBy(period, "tag").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(period))
    return c.withColumn("q", p).groupBy(period).agg(F.round(-F.sum(F.col("q") * F.ln("q")), 6).alias("entropy"), F.sum("count").alias("n"))


def log_odds(counts: DataFrame) -> DataFrame:
    """Log-odds of a against b with an informative Dirichlet prior of a + b + 1, and z. counts: tag, a, b."""
    c = counts.withColumn("alpha", F.col("a") + F.col("b") + 1)
    for x in ("a", "b", "alpha"):
        c = c.withColumn(f"{x}0", F.sum(x).over(_all()))
    odds = [F.ln((F.col(x) + F.col("alpha")) / (F.col(f"{x}0") + F.col("alpha0") - F.col(x) - F.col("alpha"))) for x in ("a", "b")]
    c = c.withColumn("log_odds", odds[0] - odds[1]).withColumn("z", F.col("log_odds") / F.sqrt(1 / (F.col("a") + F.col("alpha")) + 1 / (F.col("b") + F.col("alpha"))))
    return c.select("tag", "a", "b", "log_odds", "z")


def tail_counts(base: DataFrame, field: str) -> DataFrame:
    return tags_of(base, field).groupBy("tag").agg(F.count_if(F.col("is_high_tail") == 1).alias("a"), F.count_if(F.col("is_high_tail") == 0).alias("b"))


def tail_sensitivity(base: DataFrame, field: str, quantiles: Sequence[float], top: int = 10, reference: float = 0.95) -> DataFrame:
    """Per tail definition: Jaccard of its leading tags with those of the reference, and rank correlation of z."""
    parts = []
    for q in quantiles:
        parts.append(log_odds(tail_counts(with_tail(base, q), field)).withColumn("q", F.lit(q)))
    z = parts[0]
    for p in parts[1:]:
        z = z.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("z", 9)), "tag")
    z = z.withColumn("rank", F.row_number().over(w))
    tie = Window.partitionBy("q", F.round("z", 9))
    z = z.withColumn("avg_rank", F.avg("rank").over(tie)).select("q", "tag", "rank", "avg_rank")
    ref = z.where(F.col("q") == reference).select("tag", F.col("rank").alias("rank0"), F.col("avg_rank").alias("avg0"))
    both = F.count_if((F.col("rank") <= top) & (F.col("rank0") <= top))
    either = F.count_if((F.col("rank") <= top) | (F.col("rank0") <= top))
    return z.join(ref, "tag").groupBy("q").agg(F.round(both / either, 6).alias("jaccard"), F.round(F.corr("avg_rank", "avg0"), 6).alias("spearman"))


def herfindahl(base: DataFrame, key: str, field: str) -> DataFrame:
    c = tags_of(base, field).groupBy(key, "tag").count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy(key))
    return c.withColumn("s", share).groupBy(key).agg(F.round(F.sum(F.col("s") * F.col("s")), 6).alias("hhi"), F.sum("count").alias("n"))


def coverage(base: DataFrame, key: str, ks: Sequence[int] = (1, 5, 10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """Share of rows held by the k most frequent values, for each k; k beyond their number holds all."""
    spark = base.sparkSession
    c = base.groupBy(key).count()
    top = c.orderBy(F.desc("count"), key).limit(max(ks)).withColumn("r", F.row_number().over(_all().orderBy(F.desc("count"), key)))
    grid = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    total = F.broadcast(c.agg(F.sum("count").alias("total")))
    return grid.join(top, F.col("r") <= F.col("k")).groupBy("k").agg(F.sum("count").alias("c")).crossJoin(total).select("k", F.round(F.col("c") / F.col("total"), 6).alias("coverage"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def prototypes(base: DataFrame) -> DataFrame:
    t = base.groupBy("theme", "prototype").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.median("p").alias("median"), F.sum("p").alias("mass"), F.avg("is_high_tail").alias("tail_rate"))
    return t.withColumn("theme_share", F.col("n") / F.sum("n").over(Window.partitionBy("theme"))).select("theme", "prototype", "n", *[F.round(c, MEDIAN_DIGITS if c == "median" else 6).alias(c) for c in ("mean", "median", "mass", "tail_rate", "theme_share")])


def burstiness(base: DataFrame, period: str, field: str) -> DataFrame:
    """Median, max, mean and sample deviation of a tag's share over the periods it occurs in, and max over median."""
    s = period_shares(base, period, field)
    s = s.groupBy("tag").agg(F.median("share").alias("med"), F.max("share").alias("top"), F.avg("share").alias("mean"), F.stddev_samp("share").alias("std"))
    return s.select("tag", *[F.round(c, 6).alias(c) for c in ("med", "top", "mean", "std")], F.round(F.col("top") / F.nullif(F.col("med"), F.lit(0)), 6).alias("burst"))


def grid(base: DataFrame, period: str, field: str) -> DataFrame:
    """Counts on the dense grid of observed periods and tags."""
    c = tags_of(base, field).groupBy(period, "tag").count()
    cells = c.select(period).distinct().crossJoin(c.select("tag").distinct())
    return cells.join(c, [period, "tag"], "left").select(period, "tag", F.coalesce("count", F.lit(0)).alias("n"))


def js_drift(base: DataFrame, period: str, field: str, eps: float = 1e-12) -> DataFrame:
    """Jensen-Shannon divergence (nats) of each observed period's tags from those of the period before."""
    per = Window.partitionBy(period)
    g = grid(base, period, field)
    g = g.withColumn("c", F.greatest(F.col("n") / F.sum("n").over(per), F.lit(eps)))
    g = g.withColumn("q", F.col("c") / F.sum("c").over(per)).withColumn("o", F.lag("q").over(Window.partitionBy("tag").orderBy(period))).where("o is not null")
    m = (F.col("q") + F.col("o")) / 2
    return g.groupBy(period).agg(F.round(0.5 * F.sum(F.col("q") * F.ln(F.col("q") / m)) + 0.5 * F.sum(F.col("o") * F.ln(F.col("o") / m)), 6).alias("js"))


def event_vs_baseline(base: DataFrame, period: str, field: str, back: int = 8) -> DataFrame:
    """Share of each tag per period against the median of up to `back` periods before, zeros where it is absent."""
    g = grid(base, period, field)
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))
    w = Window.partitionBy("tag").orderBy(period).rowsBetween(-back, -1)
    g = g.withColumn("baseline", F.percentile("share", F.lit(0.5)).over(w)).where("baseline is not null")
    return g.select(period, "tag", F.round("share", 6).alias("share"), F.round("baseline", 6).alias("baseline"), F.round(F.col("share") - F.col("baseline"), 6).alias("delta"))


def conditional_lift(base: DataFrame, field: str, least: int = 20, limit: float = 2.0) -> DataFrame:
    """Clipped log2 of P(tail | tag, theme) over P(tail | theme); cells with little support are null."""
    theme = base.groupBy("theme").agg(F.avg("is_high_tail").alias("base_rate"))
    c = tags_of(base, field).groupBy("theme", "tag").agg(F.count("*").alias("n"), F.avg("is_high_tail").alias("rate")).join(F.broadcast(theme), "theme")
    lift = F.when((F.col("n") >= least) & (F.col("rate") > 0) & (F.col("base_rate") > 0), F.log2(F.col("rate") / F.col("base_rate")))
    return c.select("theme", "tag", "n", F.round(F.when(lift.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), lift))), 6).alias("log2_lift"))
