"""Queries on the scores of the baseline run and on repeated metric runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.operators import metrics as M
from chatterloom.operators.dense_groups import frequency_bin
from chatterloom.plans.training import MEGA, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scores(spark, sf_dir):
    s = table(spark, sf_dir, "baseline_scores").where("y_true is not null and p_hat_raw is not null").distinct()
    return s.select("message_id", "normalized_domain", "split", F.col("y_true").alias("y"), F.col("p_hat_raw").alias("p"), F.col("p_hat_calibrated").alias("pc"), F.col("y_pred").alias("pred"))


S = "s AS (SELECT DISTINCT message_id, normalized_domain, split, y_true AS y, p_hat_raw AS p, p_hat_calibrated AS pc, y_pred AS pred FROM baseline_scores WHERE y_true IS NOT NULL AND p_hat_raw IS NOT NULL)"
CELLS = "count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn"
F1 = "(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / (cast(tp+fp+fn > 0 AS int) + cast(tn+fp+fn > 0 AS int))"
REC = "(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END + CASE WHEN tn+fp > 0 THEN tn/(tn+fp) ELSE 0 END) / (cast(tp+fp+fn > 0 AS int) + cast(tn+fp+fn > 0 AS int))"


def _bundle_sql(group, source="s"):
    return f"""SELECT {group}, tp+fp+fn+tn AS n, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy, round({F1}, 6) AS macro_f1, round({REC}, 6) AS macro_recall,
        round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall_pos, round(brier, 6) AS brier
        FROM (SELECT {group}, {CELLS}, avg((p - y) * (p - y)) AS brier FROM {source} GROUP BY {group})"""


@query(f"WITH {S} SELECT split, count(*) AS n, cast(sum(y) AS bigint) AS pos, cast(sum(1 - y) AS bigint) AS neg, round(avg(y), 6) AS rate, count(DISTINCT normalized_domain) AS n_domains FROM s GROUP BY split")
def class_balance(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.round(F.avg("y"), 6).alias("rate"), F.count_distinct("normalized_domain").alias("n_domains"))


@query(f"WITH {S} " + _bundle_sql("split"))
def metrics_bundle(spark, sf_dir):
    return M.bundle(scores(spark, sf_dir), ["split"])


REPORT = f"""WITH {S}, c AS (SELECT split, {CELLS} FROM s GROUP BY split), r AS (SELECT split, 1 AS label, tp AS t, fp AS f, fn AS m FROM c UNION ALL SELECT split, 0, tn, fn, fp FROM c)
    SELECT split, label, round(CASE WHEN t+f > 0 THEN t/(t+f) ELSE 0 END, 6) AS precision, round(CASE WHEN t+m > 0 THEN t/(t+m) ELSE 0 END, 6) AS recall, round(CASE WHEN 2*t+f+m > 0 THEN 2*t/(2*t+f+m) ELSE 0 END, 6) AS f1, t+m AS support FROM r"""


@query(REPORT)
def class_report(spark, sf_dir):
    return M.class_report(scores(spark, sf_dir), ["split"])


SWEEP = f"""sweep AS (SELECT split, threshold, round({F1}, 6) AS macro_f1, round({REC}, 6) AS macro_recall FROM
    (SELECT split, threshold, {CELLS.replace('pred', 'cast(p >= threshold AS int)')} FROM s CROSS JOIN (SELECT round(i * 0.05, 2)::double AS threshold FROM range(1, 20) r(i)) GROUP BY ALL))"""


@query(f"WITH {S}, {SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(scores(spark, sf_dir), ["split"])


@query(f"WITH {S}, {SWEEP} SELECT * FROM sweep QUALIFY row_number() OVER (PARTITION BY split ORDER BY macro_f1 DESC, threshold) = 1")
def best_threshold(spark, sf_dir):
    return M.best_threshold(scores(spark, sf_dir), ["split"])


BIN = " + ".join(f"cast(p >= {e!r}::double AS int)" for e in M.EDGES[1:])


@query(f"WITH {S} SELECT split, bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(y), 6) AS y_mean FROM (SELECT *, {BIN} AS bin FROM s) WHERE bin < 10 GROUP BY split, bin")
def reliability(spark, sf_dir):
    return M.reliability(scores(spark, sf_dir), ["split"])


@query(f"WITH {S}, b AS (SELECT split, bin, count(*) AS k, avg(p) AS pm, avg(y) AS ym FROM (SELECT *, {BIN} AS bin FROM s) GROUP BY split, bin) SELECT split, round(sum(CASE WHEN bin < 10 THEN k * abs(pm - ym) ELSE 0 END) / sum(k), 6) AS ece FROM b GROUP BY split")
def calibration_error(spark, sf_dir):
    return M.ece(scores(spark, sf_dir), ["split"])


@query(f"""WITH {S}, r AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2 AS k FROM s)
    SELECT split, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS roc_auc FROM r GROUP BY split""")
def roc_auc(spark, sf_dir):
    return M.roc_auc(scores(spark, sf_dir), ["split"])


FREQ = f"f AS (SELECT normalized_domain, count(*) AS k FROM {MEGA} GROUP BY normalized_domain), sl AS (SELECT s.*, CASE WHEN k >= 50 THEN 'head (>=50)' WHEN k >= 5 THEN 'torso (5-49)' ELSE 'tail (<=4)' END AS domain_bin FROM s JOIN f USING (normalized_domain) WHERE split = 'test')"


@query(f"WITH {S}, {FREQ} " + _bundle_sql("domain_bin", "sl"))
def domain_slice_metrics(spark, sf_dir):
    freq = table(spark, sf_dir, MEGA).groupBy("normalized_domain").agg(F.count("*").alias("k"))
    return M.bundle(scores(spark, sf_dir).where("split = 'test'").join(freq, "normalized_domain").withColumn("domain_bin", frequency_bin(F.col("k"))), ["domain_bin"])


@query(f"WITH {S}, t AS (SELECT s.*, theme FROM s JOIN {MEGA} USING (message_id) WHERE split = 'test' AND theme IS NOT NULL), o AS (SELECT theme FROM t GROUP BY theme HAVING count(*) >= 50), u AS (SELECT * FROM t SEMI JOIN o USING (theme)) " + _bundle_sql("theme", "u"))
def theme_slice_metrics(spark, sf_dir):
    t = scores(spark, sf_dir).where("split = 'test'").join(table(spark, sf_dir, MEGA).select("message_id", "theme"), "message_id").where("theme is not null")
    return M.bundle(t, ["theme"]).where("n >= 50")


@query(f"""WITH {S}, t AS (SELECT s.*, len(regexp_extract_all(message, '\\S+')) AS w FROM s JOIN {MEGA} USING (message_id) WHERE message IS NOT NULL),
    e AS (SELECT quantile_cont(w, 0.25) AS a, quantile_cont(w, 0.5) AS b, quantile_cont(w, 0.75) AS c FROM t),
    u AS (SELECT t.*, CASE WHEN w <= a THEN 'Q1' WHEN w <= b THEN 'Q2' WHEN w <= c THEN 'Q3' ELSE 'Q4' END AS q FROM t, e) """ + _bundle_sql("q", "u"))
def length_quartile_metrics(spark, sf_dir):
    words = F.size(F.regexp_extract_all("message", F.lit(r"\S+"), F.lit(0)))
    t = scores(spark, sf_dir).join(table(spark, sf_dir, MEGA).where("message is not null").select("message_id", words.alias("w")), "message_id")
    return M.bundle(M.quartile(t, "w"), ["q"])


@query(f"WITH {S} SELECT message_id, split, y, pred, round(p, 6) AS p, kind, rank FROM (SELECT *, CASE WHEN y = 0 AND pred = 1 THEN 'FP' ELSE 'FN' END AS kind, cast(row_number() OVER (PARTITION BY kind ORDER BY abs(p - y) DESC, message_id) AS int) AS rank FROM s WHERE y <> pred AND split = 'test') WHERE rank <= 5")
def top_errors(spark, sf_dir):
    e = scores(spark, sf_dir).where("y <> pred and split = 'test'").withColumn("kind", F.when(F.col("y") == 0, "FP").otherwise("FN"))
    w = M.Window.partitionBy("kind").orderBy(F.desc(F.abs(F.col("p") - F.col("y"))), "message_id")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("message_id", "split", "y", "pred", F.round("p", 6).alias("p"), "kind", "rank")


@query(f"WITH {S} SELECT split, count(pc) AS n, round(avg(abs(p - pc)), 6) AS mad, round(avg(power(pc - y, 2)), 6) AS brier_calibrated FROM s GROUP BY split")
def calibration_shift(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("split").agg(F.count("pc").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("pc"))), 6).alias("mad"), F.round(F.avg(F.pow(F.col("pc") - F.col("y"), 2)), 6).alias("brier_calibrated"))


@query()
def bootstrap_std(spark, sf_dir):
    return M.bootstrap_std(scores(spark, sf_dir).where("split = 'test'").withColumnRenamed("message_id", "key"))


RUNS = "domain_head_torso_tail_metrics"
METRICS = ("macro_f1", "macro_recall", "roc_auc", "brier", "ece")


@query("SELECT model, count(*) AS n_runs, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS) + f" FROM {RUNS} GROUP BY model")
def model_summary(spark, sf_dir):
    spec = {m: (F.avg, F.stddev_samp) for m in METRICS}
    return table(spark, sf_dir, RUNS).groupBy("model").agg(F.count("*").alias("n_runs"), *[F.round(f(m), 6).alias(f"{m}_{'mean' if f is F.avg else 'std'}") for m, fs in spec.items() for f in fs])


@query(f"SELECT theme, round(avg(macro_f1) FILTER (model = 'tfidf'), 8) AS tfidf, round(avg(macro_f1) FILTER (model = 'style'), 8) AS style, round(avg(macro_f1) FILTER (model = 'combined'), 8) AS combined FROM {RUNS} GROUP BY theme")
def theme_by_model(spark, sf_dir):
    """Means keep eight digits: those of a few values of six digits would often stand on a tie at six."""
    return table(spark, sf_dir, RUNS).groupBy("theme").pivot("model", ["tfidf", "style", "combined"]).agg(F.round(F.avg("macro_f1"), 8))


@query("SELECT model, metric, round(avg(value), 6) AS value FROM (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM {RUNS}" for m in METRICS) + ") GROUP BY ALL")
def long_metrics(spark, sf_dir):
    return table(spark, sf_dir, RUNS).unpivot(["model"], list(METRICS), "metric", "value").groupBy("model", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"SELECT model, theme, cast(row_number() OVER (PARTITION BY model ORDER BY avg(macro_f1) DESC, theme) AS int) AS rank, round(avg(macro_f1), 6) AS macro_f1 FROM {RUNS} GROUP BY model, theme QUALIFY rank <= 3")
def best_themes(spark, sf_dir):
    t = table(spark, sf_dir, RUNS).groupBy("model", "theme").agg(F.avg("macro_f1").alias("m"))
    w = M.Window.partitionBy("model").orderBy(F.desc("m"), "theme")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("model", "theme", "rank", F.round("m", 6).alias("macro_f1"))
