"""Queries on clusters of tag prototypes and communities of channels. K-means has no SQL; what follows from it is tested by its sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.operators import clusters as C
from chatterloom.operators import dynamics as D
from chatterloom.plans.dynamics import BASE, base, split_sql, tail

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(translate(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '‐‑‒–—', '-----'), '\s+', '_', 'g'), '[^\p{{L}}\p{{N}}_\-/]', '_', 'g')"


def _tokens(name: str, field: str) -> str:
    return f"list_transform({split_sql(field)}, lambda y: '{name}=' || {_clean('y')})"


@query(f"""WITH {BASE} SELECT DISTINCT prototype, array_to_string(list_concat(list_concat(CASE WHEN {_clean('theme')} <> '' THEN ['THEME=' || {_clean('theme')}] ELSE [] END,
    {_tokens('CLAIM', 'claim_types')}), list_concat({_tokens('CTA', 'ctas')}, {_tokens('EVID', 'evidence')})), ' ') AS tag_document FROM base""")
def tag_documents(spark, sf_dir):
    """Tag document of every prototype."""
    doc = C.tag_document(*[F.col(c) for c in ("theme", "claim_types", "ctas", "evidence")])
    return base(spark, sf_dir).select("prototype", doc.alias("tag_document")).distinct()


@query()
def prototype_cluster_grid(spark, sf_dir):
    """Inertia and cosine silhouette of k-means over prototypes for k from 10 to 40."""
    vectors, _ = C.tag_vectors(base(spark, sf_dir))
    return spark.createDataFrame(C.grid(vectors, range(10, 41, 5)), "k int, inertia double, silhouette double")


def _clustered(spark, sf_dir):
    """Base rows with the tail, and the cluster as theme."""
    rows, tokens = C.prototype_clusters(tail(spark, sf_dir))
    return rows.withColumn("theme", F.col("cluster").cast("string")), tokens


@query()
def cluster_summary(spark, sf_dir):
    """Per cluster of prototypes: messages, risk, lift of the tail and shares of messages and risk mass."""
    return D.tag_table(_clustered(spark, sf_dir)[0], "theme").withColumnRenamed("tag", "cluster")


@query()
def cluster_signatures(spark, sf_dir):
    """The fifteen heaviest centre tokens of every cluster."""
    return spark.createDataFrame(_clustered(spark, sf_dir)[1], "cluster int, rank int, token string, weight double")


@query()
def cluster_weeks(spark, sf_dir):
    """Messages and risk mass of every cluster and week, with their share of the week."""
    rows = _clustered(spark, sf_dir)[0]
    counts = D.period_shares(rows, "week", "theme").select("week", F.col("tag").alias("cluster"), F.col("v").alias("n"), "share")
    mass = D.period_shares(rows, "week", "theme", by_mass=True).select("week", F.col("tag").alias("cluster"), F.col("v").alias("mass"), F.col("share").alias("mass_share"))
    return counts.join(mass, ["week", "cluster"])


@query()
def cluster_drift(spark, sf_dir):
    """Jensen-Shannon divergence of each week's clusters from the week before."""
    return D.js_drift(_clustered(spark, sf_dir)[0], "week", "theme")


@query()
def cluster_bursts(spark, sf_dir):
    """Burstiness of the weekly share of every cluster."""
    return D.burstiness(_clustered(spark, sf_dir)[0], "week", "theme").withColumnRenamed("tag", "cluster")


def _communities(spark, sf_dir):
    rows, _ = C.prototype_clusters(tail(spark, sf_dir))
    return rows, C.communities(rows)[0]


@query()
def community_grid(spark, sf_dir):
    """Inertia and cosine silhouette of k-means over channel profiles for k from 5 to 20."""
    rows, _ = C.prototype_clusters(base(spark, sf_dir))
    return spark.createDataFrame(C.grid(C.communities(rows)[1], range(5, 21)), "k int, inertia double, silhouette double")


@query()
def channel_communities(spark, sf_dir):
    """Every channel with its community, messages and mean risk."""
    rows, found = _communities(spark, sf_dir)
    risk = rows.groupBy("channel").agg(F.round(F.avg("p"), 6).alias("mean_risk"))
    return found.select("channel", "community", "n").join(risk, "channel")


@query()
def community_sizes(spark, sf_dir):
    """Channels, messages and quartiles of channels' mean risk of every community."""
    found = channel_communities(spark, sf_dir)
    q = F.percentile("mean_risk", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = found.groupBy("community").agg(F.count("*").alias("n_channels"), F.sum("n").alias("n_messages"), q.alias("q"))
    return out.select("community", "n_channels", "n_messages", *[F.round(F.col("q")[i], D.MEDIAN_DIGITS).alias(f"q{i + 1}") for i in range(3)])


def _mean_shares(found):
    names = [c for c in found.columns if c not in ("channel", "n", "community")]
    long = found.select("community", F.explode(F.create_map(*[x for c in names for x in (F.lit(int(c[1:])), F.col(c))])).alias("cluster", "share"))
    return long.groupBy("community", "cluster").agg(F.round(F.avg("share"), 6).alias("mean_share"))


@query()
def community_cluster_shares(spark, sf_dir):
    """Mean share of every cluster over the channels of every community."""
    return _mean_shares(_communities(spark, sf_dir)[1])


@query()
def community_top_clusters(spark, sf_dir):
    """The two clusters with the largest mean share of every community."""
    return C.top_two(community_cluster_shares(spark, sf_dir), "community", "cluster", "mean_share")


@query()
def community_themes(spark, sf_dir):
    """Messages of every community and theme."""
    rows, found = _communities(spark, sf_dir)
    return rows.join(found.select("channel", "community"), "channel").groupBy("community", "theme").agg(F.count("*").alias("n"))
