"""Queries on features and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from chatterloom.functions import labels as L
from chatterloom.operators import metrics as M
from chatterloom.operators import models
from chatterloom.operators.annotation import SIGNALS
from chatterloom.plans import corpus
from chatterloom.plans.training import MEGA, table
from chatterloom.session import stage

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT label_id, lower(label) AS t FROM codebook_labels), w AS (SELECT label_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}')) AS term FROM d), tf AS (SELECT label_id, term, count(*) AS tf FROM w GROUP BY ALL),
    v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), x AS (SELECT label_id, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term))
    SELECT label_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY label_id)), 6) AS weight FROM x""")
def label_tfidf(spark, sf_dir):
    return models.tfidf(table(spark, sf_dir, "codebook_labels").select("label_id", "label"), "label_id", "label")


STYLE = [f"cta={n}" for n, _ in L.rules(L.CTA_RULES)] + [f"evid={n}" for n, _ in L.rules(L.EVIDENCE_RULES)] + [f"claim={n}" for n, _ in L.rules(L.CLAIM_RULES)]


def styled(spark, sf_dir):
    m = table(spark, sf_dir, MEGA)
    tokens = L.style_tokens(None, L.norm_labels(F.col("claim_types"), L.CLAIM_RULES), L.norm_labels(F.col("ctas"), L.CTA_RULES), L.norm_labels(F.col("evidence"), L.EVIDENCE_RULES, "link|url"))
    s = table(spark, sf_dir, "baseline_scores").select("message_id", "split", F.col("y_true").alias("y")).distinct()
    return m.select("message_id", tokens.alias("tokens")).join(s, "message_id")


@query()
def style_logistic(spark, sf_dir):
    """Train on train, evaluate per split at 0.5."""
    rows = styled(spark, sf_dir)
    beta, b = models.logistic_gd(rows.where("split = 'train'"), "tokens", "y", STYLE)
    return M.bundle(models.score_gd(rows, "tokens", STYLE, beta, b).withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["split"])


@query()
def noise_robustness(spark, sf_dir):
    """Metrics on test under flipped style bits."""
    rows = styled(spark, sf_dir)
    beta, b = models.logistic_gd(rows.where("split = 'train'"), "tokens", "y", STYLE)
    noisy = models.flip_noise(rows.where("split = 'test'"), "message_id", "tokens", STYLE, (0.0, 0.05, 0.1, 0.2), 5)
    return M.bundle(models.score_gd(noisy, "tokens", STYLE, beta, b).withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["rate", "rep"])


@query()
def embedding_clusters(spark, sf_dir):
    """Ten clusters of the embeddings with their size and mean place on two principal components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out, _, _ = models.cluster(e, "features", 10, (1, 2, 3))
    out, _ = models.principal(out, "features")
    xy = vector_to_array("pca")
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.abs(xy[0])).alias("pc1"), F.avg(F.abs(xy[1])).alias("pc2"))


@query()
def signal_accuracies(spark, sf_dir):
    acc = models.label_model(corpus.signal_table(spark, sf_dir), SIGNALS)
    return spark.createDataFrame(sorted(acc.items()), "signal_key string, accuracy double")


FIELDS = {"full": ("theme", "claim", "cta", "evid"), "theme only": ("theme",), "claim only": ("claim",), "cta only": ("cta",), "evidence only": ("evid",), "without theme": ("claim", "cta", "evid")} | {
    "drop claim": ("theme", "cta", "evid"), "drop cta": ("theme", "claim", "evid"), "drop evidence": ("theme", "claim", "cta"),
}


@query()
def ablation_grid(spark, sf_dir):
    """Style model on nine subsets of the tag fields and ten seeded splits by domain, rate and threshold chosen on val, metrics on test."""
    m = table(spark, sf_dir, MEGA)
    tokens = L.style_tokens(L.norm_theme(F.col("theme")), L.norm_labels(F.col("claim_types"), L.CLAIM_RULES), L.norm_labels(F.col("ctas"), L.CTA_RULES), L.norm_labels(F.col("evidence"), L.EVIDENCE_RULES, "link|url"))
    y = (F.col("risk_label") > 0).cast("int")
    rows = m.where("risk_label is not null and normalized_domain is not null").select("message_id", "normalized_domain", y.alias("y"), tokens.alias("tokens"))
    return models.tuned_grid(stage(rows, "style-rows"), "tokens", "y", "normalized_domain", "message_id", FIELDS, range(10))


@query()
def ablation_summary(spark, sf_dir):
    """Mean and sample deviation over the seeds of every subset."""
    metrics = ("accuracy", "macro_f1", "macro_recall", "recall_pos", "roc_auc", "brier", "ece")
    return ablation_grid(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_seeds"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@query()
def stacked_ensemble(spark, sf_dir):
    """Converged logistic regression on the base score, the style score and their product, fitted on val, metrics on test."""
    rows = styled(spark, sf_dir)
    beta, b = models.logistic_gd(rows.where("split = 'train'"), "tokens", "y", STYLE)
    base = table(spark, sf_dir, "baseline_scores").select("message_id", F.col("p_hat_raw").alias("p_text")).distinct()
    x = models.score_gd(rows, "tokens", STYLE, beta, b).withColumnRenamed("p", "p_style").join(base, "message_id")
    out = models.stack(x, ["p_text", "p_style"], "y", x["split"] == "val").where("split = 'test'")
    return M.bundle(out.withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["split"])
