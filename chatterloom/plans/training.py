"""Queries of the training-data operators of the core: dense per-key sums (p2) and packed fields (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators.dense_groups import dense_group_sums, frequency_bin
from chatterloom.operators.packed import unpack

TAG_FIELDS = ("claim_types", "ctas", "evidence")
MEGA = "mega_samples_dedup_qwen_mbfc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _domains(spark, sf_dir):
    return table(spark, sf_dir, MEGA).where(F.coalesce(F.col("normalized_domain"), F.lit("")) != "")


def p2_found(spark, sf_dir):
    """Each domain with its bin by number of rows."""
    return dense_group_sums(_domains(spark, sf_dir), "normalized_domain").select("normalized_domain", frequency_bin(F.col("n")).alias("domain_bin"))


def p2_domain_stats(spark, sf_dir):
    """Rows, labelled rows, risky rows and their share, per domain."""
    risk = F.col("risk_label")
    s = dense_group_sums(_domains(spark, sf_dir), "normalized_domain", {"y": risk, "len": F.length("message")})
    return s.select(
        "normalized_domain", "n", F.col("cnt_y").alias("n_labelled"), F.col("sum_y").cast("bigint").alias("n_risky"),
        F.round(F.col("sum_y") / F.nullif(F.col("cnt_y"), F.lit(0)), 6).alias("risk_share"), F.col("sum_len").cast("bigint").alias("n_chars"),
    )


def p2_bin_stats(spark, sf_dir):
    """Rows and mean metrics per domain_bin of the metric runs."""
    metrics = ["pos_rate", "macro_f1", "macro_recall", "roc_auc", "brier", "ece"]
    s = dense_group_sums(table(spark, sf_dir, "domain_head_torso_tail_metrics"), "domain_bin", {"rows": F.col("n")} | {m: F.col(m) for m in metrics})
    return s.select("domain_bin", "n", F.col("sum_rows").cast("bigint").alias("sum_rows"), *[F.round(F.col(f"sum_{m}") / F.nullif(F.col(f"cnt_{m}"), F.lit(0)), 6).alias(f"mean_{m}") for m in metrics])


def p6_found(spark, sf_dir):
    """Every value of the fields with two or more, with its position."""
    return unpack(table(spark, sf_dir, MEGA), ["message_id"], TAG_FIELDS).where("n_values > 1").select("message_id", "tag_field", "pos", "tag_value")


def p6_value_counts(spark, sf_dir):
    """Rows, messages' first places and packed rows per field and value, single values too."""
    v = unpack(table(spark, sf_dir, MEGA), ["message_id"], TAG_FIELDS)
    return v.groupBy("tag_field", "tag_value").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 1).alias("n_first"), F.count_if(F.col("n_values") > 1).alias("n_packed"))


QUERIES = {f.__name__: f for f in (p2_found, p2_domain_stats, p2_bin_stats, p6_found, p6_value_counts)}

ORACLE = {
    "p2_found": f"""
        SELECT normalized_domain, CASE WHEN count(*) >= 50 THEN 'head (>=50)' WHEN count(*) >= 5 THEN 'torso (5-49)' ELSE 'tail (<=4)' END AS domain_bin
        FROM {MEGA} WHERE coalesce(normalized_domain, '') <> '' GROUP BY normalized_domain""",
    "p2_domain_stats": f"""
        SELECT normalized_domain, count(*) AS n, count(risk_label) AS n_labelled, cast(coalesce(sum(risk_label), 0) AS bigint) AS n_risky,
               round(avg(risk_label), 6) AS risk_share, cast(coalesce(sum(length(message)), 0) AS bigint) AS n_chars
        FROM {MEGA} WHERE coalesce(normalized_domain, '') <> '' GROUP BY normalized_domain""",
    "p2_bin_stats": """
        SELECT domain_bin, count(*) AS n, cast(sum(n) AS bigint) AS sum_rows, round(avg(pos_rate), 6) AS mean_pos_rate, round(avg(macro_f1), 6) AS mean_macro_f1,
               round(avg(macro_recall), 6) AS mean_macro_recall, round(avg(roc_auc), 6) AS mean_roc_auc, round(avg(brier), 6) AS mean_brier, round(avg(ece), 6) AS mean_ece
        FROM domain_head_torso_tail_metrics GROUP BY domain_bin""",
}
