"""Queries on the dynamics of tags in the core table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.operators import dynamics as D
from chatterloom.plans.training import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def base(spark, sf_dir):
    return D.base_table(table(spark, sf_dir, "full_risk_v2_core"))


def tail(spark, sf_dir, q=0.95):
    return D.with_tail(base(spark, sf_dir), q)


BASE = """
parsed AS (SELECT *, try_strptime(msg_date, ['%Y-%m-%d %H:%M:%S+00:00', '%Y-%m-%dT%H:%M:%SZ', '%d.%m.%Y %H:%M', '%Y-%m-%d', '%b %d, %Y %H:%M:%S']) AS ts FROM full_risk_v2_core),
base AS (
  SELECT row_id, channel, strftime(ts, '%Y-%m-%d') AS day,
         strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
         strftime(ts, '%Y-%m') AS month, cast(year(ts) AS int) AS year, combined_proba AS p,
         coalesce(theme, 'NA') AS theme, coalesce(claim_types, 'NA') AS claim_types, coalesce(ctas, 'NA') AS ctas, coalesce(evidence, 'NA') AS evidence,
         coalesce(theme, 'NA') || ' || ' || coalesce(claim_types, 'NA') || ' || ' || coalesce(ctas, 'NA') || ' || ' || coalesce(evidence, 'NA') AS prototype,
         cast(coalesce(length(message), 0) AS int) AS msg_len,
         cast(coalesce(regexp_matches(message, '(http://|https://|www\\.|t\\.me/)', 'i'), false) AS int) AS has_url
  FROM parsed WHERE channel IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01'),
tail AS (SELECT *, coalesce(cast(p >= (SELECT quantile_cont(p, 0.95) FROM base) AS int), 0) AS is_high_tail FROM base)"""


def split_sql(field: str) -> str:
    t = f"regexp_replace({field}, '^\\s+|\\s+$', '', 'g')"
    part = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN lower({t}) IN ('', 'nan', 'na') THEN [] ELSE list_filter(list_transform(string_split({t}, ','), lambda x: {part}), lambda x: x <> '' AND upper(x) <> 'NA') END"


CLAIMS = f"claims AS (SELECT * FROM (SELECT *, unnest({split_sql('claim_types')}) AS tag FROM tail))"
THEMES = "themes AS (SELECT *, theme AS tag FROM tail)"


@query(f"WITH {BASE} SELECT * FROM base")
def base_table(spark, sf_dir):
    return base(spark, sf_dir)


@query(f"WITH {BASE} SELECT round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.9), 6) AS q90, round(quantile_cont(p, 0.95), 6) AS q95, round(quantile_cont(p, 0.99), 6) AS q99, round(max(p), 6) AS top, count(p) AS n, count(DISTINCT channel) AS n_channels FROM base")
def score_quantiles(spark, sf_dir):
    q = F.percentile("p", F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    r = base(spark, sf_dir).agg(q.alias("q"), F.max("p").alias("m"), F.count("p").alias("n"), F.count_distinct("channel").alias("n_channels"))
    return r.select(*[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q50", "q90", "q95", "q99"))], F.round("m", 6).alias("top"), "n", "n_channels")


@query(f"WITH {BASE} SELECT row_id, is_high_tail FROM tail")
def high_tail_flag(spark, sf_dir):
    return tail(spark, sf_dir).select("row_id", "is_high_tail")


def _tag_table_sql(source):
    return f"""SELECT tag, count(*) AS n, round(avg(p), 6) AS mean, round(median(p), 8) AS median, round(sum(p), 6) AS mass, round(avg(is_high_tail), 6) AS tail_rate,
        round(count(*) / sum(count(*)) OVER (), 6) AS msg_share, round(sum(p) / sum(sum(p)) OVER (), 6) AS mass_share,
        round(avg(is_high_tail) / nullif((SELECT avg(is_high_tail) FROM tail), 0), 6) AS lift FROM {source} GROUP BY tag"""


@query(f"WITH {BASE}, {THEMES} " + _tag_table_sql("themes"))
def tag_table_theme(spark, sf_dir):
    return D.tag_table(tail(spark, sf_dir), "theme")


@query(f"WITH {BASE}, {CLAIMS} " + _tag_table_sql("claims"))
def tag_table_claims(spark, sf_dir):
    return D.tag_table(tail(spark, sf_dir), "claim_types")


def _share_sql(period, source, value="count(*)"):
    return f"""SELECT a.{period}, tag, round(v, 6) AS v, round(v / nullif(total, 0), 6) AS share FROM
        (SELECT {period}, tag, cast({value} AS double) AS v FROM {source} GROUP BY ALL) a JOIN (SELECT {period}, cast({value} AS double) AS total FROM tail GROUP BY ALL) b ON a.{period} = b.{period}"""


@query(f"WITH {BASE}, {THEMES} " + _share_sql("week", "themes"))
def weekly_theme_share(spark, sf_dir):
    return D.period_shares(base(spark, sf_dir), "week", "theme")


@query(f"WITH {BASE}, {CLAIMS} " + _share_sql("week", "claims"))
def weekly_claim_share(spark, sf_dir):
    return D.period_shares(base(spark, sf_dir), "week", "claim_types")


@query(f"WITH {BASE}, {THEMES} " + _share_sql("week", "themes", "sum(p)"))
def weekly_theme_risk_share(spark, sf_dir):
    return D.period_shares(base(spark, sf_dir), "week", "theme", by_mass=True)


@query(f"""WITH {BASE}, {CLAIMS}, lead AS (SELECT tag AS lead FROM claims GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 8),
    merged AS (SELECT month, coalesce(lead, 'Other') AS tag, p FROM claims LEFT JOIN lead ON tag = lead) """ + _share_sql("month", "merged"))
def monthly_claim_share_top8(spark, sf_dir):
    return D.period_shares(base(spark, sf_dir), "month", "claim_types", top=8)


@query(f"""WITH {BASE}, c AS (SELECT week, theme, count(*) AS k FROM base GROUP BY ALL), s AS (SELECT week, k, k / sum(k) OVER (PARTITION BY week) AS q FROM c)
    SELECT week, round(-sum(q * ln(q)), 6) AS entropy, cast(sum(k) AS bigint) AS n FROM s GROUP BY week""")
def theme_entropy_week(spark, sf_dir):
    return D.entropy(base(spark, sf_dir), "week", "theme")


@query(f"WITH {BASE} SELECT week, count(*) AS n, round(avg(is_high_tail), 6) AS tail_rate FROM tail GROUP BY week")
def weekly_tail_rate(spark, sf_dir):
    return tail(spark, sf_dir).groupBy("week").agg(F.count("*").alias("n"), F.round(F.avg("is_high_tail"), 6).alias("tail_rate"))


def _odds_sql(source, flag="is_high_tail"):
    return f"""c AS (SELECT tag, count(*) FILTER ({flag} = 1) AS a, count(*) FILTER ({flag} = 0) AS b FROM {source} GROUP BY tag), d AS (SELECT *, a + b + 1 AS al FROM c),
    e AS (SELECT *, sum(a) OVER () AS a0, sum(b) OVER () AS b0, sum(al) OVER () AS al0 FROM d),
    o AS (SELECT tag, a, b, ln((a + al) / (a0 + al0 - a - al)) - ln((b + al) / (b0 + al0 - b - al)) AS lo, 1 / (a + al) + 1 / (b + al) AS var FROM e)"""


@query(f"WITH {BASE}, {CLAIMS}, {_odds_sql('claims')} SELECT tag, a, b, round(lo, 6) AS log_odds, round(lo / sqrt(var), 6) AS z FROM o")
def log_odds_claims(spark, sf_dir):
    return D.log_odds(D.tail_counts(tail(spark, sf_dir), "claim_types")).select("tag", "a", "b", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))


@query(f"""WITH {BASE}, cut AS (SELECT unnest([0.9, 0.95, 0.97, 0.99])::double AS q, unnest(quantile_cont(p, [0.9, 0.95, 0.97, 0.99])) AS cut FROM base),
    x AS (SELECT q, theme AS tag, coalesce(cast(p >= cut AS int), 0) AS f FROM base, cut), c AS (SELECT q, tag, sum(f) AS a, count(*) - sum(f) AS b FROM x GROUP BY ALL),
    e AS (SELECT *, a + b + 1 AS al, sum(a) OVER w AS a0, sum(b) OVER w AS b0, sum(a + b + 1) OVER w AS al0 FROM c WINDOW w AS (PARTITION BY q)),
    z AS (SELECT q, tag, round((ln((a + al) / (a0 + al0 - a - al)) - ln((b + al) / (b0 + al0 - b - al))) / sqrt(1 / (a + al) + 1 / (b + al)), 9) AS z FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY z DESC, tag) AS rank FROM z), t AS (SELECT *, avg(rank) OVER (PARTITION BY q, z) AS ar FROM r)
    SELECT a.q, round(count(*) FILTER (a.rank <= 10 AND b.rank <= 10) / count(*) FILTER (a.rank <= 10 OR b.rank <= 10), 6) AS jaccard, round(corr(a.ar, b.ar), 6) AS spearman
    FROM t a JOIN t b ON a.tag = b.tag AND b.q = 0.95 GROUP BY a.q""")
def tail_sensitivity(spark, sf_dir):
    return D.tail_sensitivity(base(spark, sf_dir), "theme", (0.9, 0.95, 0.97, 0.99))


@query(f"""WITH {BASE}, c AS (SELECT channel, theme, count(*) AS k FROM base GROUP BY ALL), s AS (SELECT channel, k, k / sum(k) OVER (PARTITION BY channel) AS q FROM c)
    SELECT channel, round(sum(q * q), 6) AS hhi, cast(sum(k) AS bigint) AS n FROM s GROUP BY channel""")
def channel_hhi(spark, sf_dir):
    return D.herfindahl(base(spark, sf_dir), "channel", "theme")


@query(f"""WITH {BASE}, c AS (SELECT prototype, count(*) AS k FROM base GROUP BY prototype), r AS (SELECT k AS c, row_number() OVER (ORDER BY k DESC, prototype) AS r FROM c)
    SELECT cast(g.k AS int) AS k, round(sum(c) / (SELECT sum(c) FROM r), 6) AS coverage FROM r JOIN (SELECT unnest([1, 5, 10, 20, 50, 100, 200, 500, 1000]) AS k) g ON r.r <= g.k GROUP BY g.k""")
def prototype_coverage(spark, sf_dir):
    return D.coverage(base(spark, sf_dir), "prototype")


PROTO = """proto AS (SELECT theme, prototype, count(*) AS n, round(avg(p), 6) AS mean, round(median(p), 8) AS median, round(sum(p), 6) AS mass, round(avg(is_high_tail), 6) AS tail_rate,
    round(count(*) / sum(count(*)) OVER (PARTITION BY theme), 6) AS theme_share FROM tail GROUP BY theme, prototype)"""


@query(f"WITH {BASE}, {PROTO} SELECT * FROM proto")
def prototype_table(spark, sf_dir):
    return D.prototypes(tail(spark, sf_dir))


@query(f"WITH {BASE}, {PROTO} SELECT theme, prototype, n, theme_share, cast(row_number() OVER (PARTITION BY theme ORDER BY n DESC, prototype) AS int) AS rank FROM proto QUALIFY rank <= 30")
def top_prototypes_per_theme(spark, sf_dir):
    return D.top_per_group(D.prototypes(tail(spark, sf_dir)), ["theme"], [F.desc("n"), F.col("prototype")], 30).select("theme", "prototype", "n", "theme_share", "rank")


@query(f"""WITH {BASE}, {THEMES}, s AS ({_share_sql("week", "themes")})
    SELECT tag, round(median(share), 6) AS med, round(max(share), 6) AS top, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS std, round(max(share) / nullif(median(share), 0), 6) AS burst FROM s GROUP BY tag""")
def burstiness(spark, sf_dir):
    return D.burstiness(base(spark, sf_dir), "week", "theme")


GRID = """g AS (SELECT a.week, b.tag, coalesce(c.k, 0) AS n FROM (SELECT DISTINCT week FROM base) a CROSS JOIN (SELECT DISTINCT theme AS tag FROM base) b
    LEFT JOIN (SELECT week, theme AS tag, count(*) AS k FROM base GROUP BY ALL) c ON a.week = c.week AND b.tag = c.tag)"""


@query(f"""WITH {BASE}, {GRID}, x AS (SELECT *, greatest(n / sum(n) OVER (PARTITION BY week), 1e-12) AS c FROM g), y AS (SELECT *, c / sum(c) OVER (PARTITION BY week) AS q FROM x),
    z AS (SELECT *, lag(q) OVER (PARTITION BY tag ORDER BY week) AS o FROM y)
    SELECT week, round(0.5 * sum(q * ln(q / ((q + o) / 2))) + 0.5 * sum(o * ln(o / ((q + o) / 2))), 6) AS js FROM z WHERE o IS NOT NULL GROUP BY week""")
def js_drift_theme(spark, sf_dir):
    return D.js_drift(base(spark, sf_dir), "week", "theme")


@query(f"""WITH {BASE}, {GRID}, x AS (SELECT *, n / sum(n) OVER (PARTITION BY week) AS s FROM g),
    y AS (SELECT week, tag, s, quantile_cont(s, 0.5) OVER (PARTITION BY tag ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b FROM x)
    SELECT week, tag, round(s, 6) AS share, round(b, 6) AS baseline, round(s - b, 6) AS delta FROM y WHERE b IS NOT NULL""")
def event_vs_baseline(spark, sf_dir):
    return D.event_vs_baseline(base(spark, sf_dir), "week", "theme")


@query(f"""WITH {BASE}, {CLAIMS}, t AS (SELECT theme, avg(is_high_tail) AS r FROM tail GROUP BY theme), c AS (SELECT theme, tag, count(*) AS n, avg(is_high_tail) AS x FROM claims GROUP BY ALL)
    SELECT theme, tag, n, round(CASE WHEN n >= 20 AND x > 0 AND r > 0 THEN greatest(-2, least(2, log2(x / r))) END, 6) AS log2_lift FROM c JOIN t USING (theme)""")
def conditional_lift(spark, sf_dir):
    return D.conditional_lift(tail(spark, sf_dir), "claim_types")


@query(f"""WITH {BASE}, {THEMES}, s AS ({_share_sql("week", "themes")}) SELECT tag, week, share FROM s QUALIFY row_number() OVER (PARTITION BY tag ORDER BY share DESC, week) = 1""")
def peak_week(spark, sf_dir):
    return D.top_per_group(D.period_shares(base(spark, sf_dir), "week", "theme"), ["tag"], [F.desc("share"), F.col("week")], 1).select("tag", "week", "share")


@query(f"""WITH {BASE}, {THEMES}, s AS ({_share_sql("week", "themes")}), peak AS (SELECT tag AS theme, week FROM s QUALIFY row_number() OVER (PARTITION BY tag ORDER BY share DESC, week) = 1),
    c AS (SELECT theme, week, prototype, count(*) AS n FROM base SEMI JOIN peak USING (theme, week) GROUP BY ALL)
    SELECT theme, week, prototype, n, cast(row_number() OVER (PARTITION BY theme, week ORDER BY n DESC, prototype) AS int) AS rank FROM c QUALIFY rank <= 10""")
def peak_prototypes(spark, sf_dir):
    rows = base(spark, sf_dir).join(F.broadcast(peak_week(spark, sf_dir).select(F.col("tag").alias("theme"), "week")), ["theme", "week"], "left_semi")
    return D.top_per_group(rows.groupBy("theme", "week", "prototype").agg(F.count("*").alias("n")), ["theme", "week"], [F.desc("n"), F.col("prototype")], 10)


@query(f"WITH {BASE} SELECT channel, count(*) AS n, round(avg(p), 6) AS mean_risk, round(avg(has_url), 6) AS url_rate FROM base GROUP BY channel ORDER BY n DESC, channel LIMIT 80")
def top_channels(spark, sf_dir):
    return base(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_risk"), F.round(F.avg("has_url"), 6).alias("url_rate")).orderBy(F.desc("n"), "channel").limit(80)


@query(f"""WITH {BASE}, top AS (SELECT channel FROM base GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 20)
    SELECT channel, theme, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY channel), 6) AS share FROM base SEMI JOIN top USING (channel) GROUP BY channel, theme""")
def channel_profile(spark, sf_dir):
    b = base(spark, sf_dir)
    top = b.groupBy("channel").count().orderBy(F.desc("count"), "channel").limit(20).select("channel")
    c = b.join(F.broadcast(top), "channel", "left_semi").groupBy("channel", "theme").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(D.Window.partitionBy("channel")), 6))


@query(f"""WITH {BASE} SELECT coalesce(week, month) AS period, theme, count(*) AS n, round(sum(p), 6) AS mass FROM base GROUP BY GROUPING SETS ((week, theme), (month, theme))""")
def multi_grain_counts(spark, sf_dir):
    b = base(spark, sf_dir)
    sets = b.groupingSets([["week", "theme"], ["month", "theme"]], "week", "month", "theme").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"))
    return sets.select(F.coalesce("week", "month").alias("period"), "theme", "n", "mass")


@query(f"""WITH {BASE}, c AS (SELECT channel, avg(p) AS r, count(*) AS n FROM base GROUP BY channel), k AS (SELECT channel, theme FROM base GROUP BY channel, theme QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, theme) = 1)
    SELECT theme AS community, count(*) AS n_channels, round(quantile_cont(r, 0.25), 8) AS q1, round(quantile_cont(r, 0.5), 8) AS q2, round(quantile_cont(r, 0.75), 8) AS q3 FROM c JOIN k USING (channel) GROUP BY theme""")
def community_risk(spark, sf_dir):
    """Channels grouped by their leading theme; quartiles of mean risk."""
    b = base(spark, sf_dir)
    r = b.groupBy("channel").agg(F.avg("p").alias("r"))
    k = D.top_per_group(b.groupBy("channel", "theme").count(), ["channel"], [F.desc("count"), F.col("theme")], 1).select("channel", F.col("theme").alias("community"))
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return r.join(k, "channel").groupBy("community").agg(F.count("*").alias("n_channels"), q.alias("q")).select("community", "n_channels", *[F.round(F.col("q")[i], D.MEDIAN_DIGITS).alias(f"q{i + 1}") for i in range(3)])
