import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.operators import backfill, clusters, models
from chatterloom.plans import clusters as plans


def rows_of(spark, n=200):
    rows = [(i, f"ch{i % 7}", f"2024-0{1 + i % 3}", ("A", "B", "C")[i % 3], f"x{i % 3}, y", None, "e", (i % 10) / 10, i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, channel string, week string, theme string, claim_types string, ctas string, evidence string, p double, is_high_tail int")
    return df.withColumn("prototype", F.concat_ws(" || ", "theme", "claim_types"))


def test_prototype_clusters(spark):
    df = rows_of(spark)
    out, tokens = clusters.prototype_clusters(df, 3)
    assert out.count() == 200 and out.select("prototype", "cluster").distinct().groupBy("prototype").count().where("count > 1").count() == 0
    sizes = [r["count"] for r in out.groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and {t for _, _, t, _ in tokens} == {"theme=a", "theme=b", "theme=c", "claim=x0", "claim=x1", "claim=x2", "claim=y", "evid=e"}
    assert clusters.prototype_clusters(df.where("theme = 'A'"), 3)[0].select("cluster").distinct().count() == 1


def test_communities(spark):
    out, _ = clusters.prototype_clusters(rows_of(spark), 3)
    found, _ = clusters.communities(out, 3)
    shares = [c for c in found.columns if c.startswith("c") and c[1:].isdigit()]
    assert all(abs(sum(r[c] for c in shares) - 1) < 1e-9 for r in found.collect()) and found.count() == 7
    assert plans._mean_shares(found).groupBy("community").agg(F.sum("mean_share").alias("s")).where("abs(s - 1) > 1e-4").count() == 0


@pytest.mark.parametrize("name", ["cluster_summary", "cluster_weeks", "community_themes"])
def test_cluster_sums(spark, data, name):
    assert plans.QUERIES[name](spark, data).agg(F.sum("n")).first()[0] == plans.base(spark, data).count()


def test_val_tuned_separates():
    split = np.array(["train"] * 4 + ["val"] * 2 + ["test"] * 2)
    out = models.val_tuned(split, [["a"], ["b"], ["a"], ["b"], ["a"], ["b"], ["a"], ["b", "new"]], np.array([1, 0, 1, 0, 1, 0, 1, 0]), np.full(8, 5), (0.1, 0.5), 200)
    assert out[2] == 2 and out[3] == 10 and out[4:9] == (1.0, 1.0, 1.0, 1.0, 1.0) and out[9] < 0.25
    assert models._auc(np.array([1, 0, 1]), np.array([0.5, 0.5, 0.9]), np.array([1, 1, 2])) == pytest.approx(2.5 / 3)


def test_merged_backfill(spark):
    core = spark.createDataFrame([(1, "1", None, None, "Hello there"), (2, "2", "own", "2024-01-02", "x"), (3, "3", None, None, "HELLO  there!"), (4, "4", None, None, "none")], "row_id long, msg_id string, channel string, msg_date string, message string")
    raw = spark.createDataFrame([("c1", "7", "2024-03-01", "Hello there")], "channel string, msg_id string, msg_date string, text string")
    got = {r.row_id: (r.channel, r.msg_date, r.channel_from) for r in backfill.merged(core, raw).collect()}
    assert got[1] == ("c1", "2024-03-01 00:00:00", "exact") and got[2] == ("own", "2024-01-02", "own") and got[4] == (None, None, None)
