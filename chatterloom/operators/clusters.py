"""Clusters of tag prototypes and communities of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.text import sanitize_token, split_multi
from chatterloom.session import small, stage

MAX_BROADCAST_ROWS = 500_000


def _named(name: str):
    return lambda x: F.concat(F.lit(f"{name}="), sanitize_token(x))


def tag_document(theme: Column, claims: Column, ctas: Column, evidence: Column) -> Column:
    """THEME=... CLAIM=... CTA=... EVID=... tokens of one row, blank between; fields without a tag give none."""
    whole = sanitize_token(theme)
    parts = [F.when(F.coalesce(whole, F.lit("")) != "", F.array(F.concat(F.lit("THEME="), whole))).otherwise(F.array().cast("array<string>"))]
    for name, field in (("CLAIM", claims), ("CTA", ctas), ("EVID", evidence)):
        parts.append(F.transform(split_multi(field), _named(name)))
    return F.array_join(F.concat(*parts), " ")


def tag_vectors(base: DataFrame, max_features: int = 1 << 16) -> tuple[DataFrame, list[str]]:
    """(prototype, n, features: TF-IDF of its tag document, of norm one; vocabulary), one row per prototype of base."""
    one = base.groupBy("prototype", "theme", "claim_types", "ctas", "evidence").agg(F.count("*").alias("n"))
    tokens = F.filter(F.split(F.lower(tag_document(*[F.col(c) for c in ("theme", "claim_types", "ctas", "evidence")])), " "), lambda t: t != "")
    rows = stage(one.select("prototype", "n", tokens.alias("tokens")), "prototypes")
    counted: CountVectorizerModel = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_features).fit(rows)
    rows = counted.transform(rows)
    idf = IDF(inputCol="tf", outputCol="_").fit(rows).idf.toArray() + 1  # smooth idf plus one: ln((1 + n) / (1 + df)) + 1
    rows = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="weighted").transform(rows)
    rows = Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(rows)
    return stage(rows.select("prototype", "n", "features"), "tag-vectors"), counted.vocabulary


def best_of(df: DataFrame, k: int, seeds: Sequence[int]):
    """Cheapest of several starts of k-means with at most as many clusters as rows."""
    models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="_c").fit(df) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost)


def grid(df: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (1,)) -> list[tuple[int, float, float]]:
    """k, inertia and cosine silhouette for every k below the number of rows."""
    n, out = df.count(), []
    for k in (k for k in ks if 2 <= k < n):
        model = best_of(df, k, seeds)
        score = ClusteringEvaluator(predictionCol="_c", featuresCol="features", distanceMeasure="cosine").evaluate(model.transform(df))
        out.append((k, float(model.summary.trainingCost), float(score)))
    return out


def assigned(df: DataFrame, k: int, size: Column, seeds: Sequence[int] = (1, 2, 3)) -> tuple[DataFrame, list]:
    """df with cluster (0 is the largest by size) instead of features, and the centres in this order."""
    n = df.count()
    if n < 2:
        return df.drop("features").withColumn("cluster", F.lit(0)), []
    model = best_of(df, max(2, min(k, n - 1)) if n > 2 else 2, seeds)
    out = model.transform(df).drop("features")
    order = [r["_c"] for r in out.groupBy("_c").agg(F.sum(size).alias("s")).orderBy(F.desc("s"), "_c").collect()]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("_c")) - 1
    centres = model.clusterCenters()
    return stage(out.withColumn("cluster", rank.cast("int")).drop("_c"), "clusters"), [centres[c] for c in order]


def prototype_clusters(base: DataFrame, k: int = 25, seeds: Sequence[int] = (1, 2, 3), top: int = 15) -> tuple[DataFrame, list[tuple[int, int, str, float]]]:
    """(base with cluster by prototype; cluster, rank, token, weight of the heaviest centre tokens)."""
    vectors, vocabulary = tag_vectors(base)
    clusters, centres = assigned(vectors, k, F.col("n"), seeds)
    tokens = []
    for c, centre in enumerate(centres):
        for rank, i in enumerate(sorted(range(len(vocabulary)), key=lambda i: (-centre[i], vocabulary[i]))[:top]):
            if centre[i] > 0:
                tokens.append((c, rank + 1, vocabulary[i], round(float(centre[i]), 6)))
    return base.join(small(clusters.select("prototype", "cluster"), MAX_BROADCAST_ROWS), "prototype"), tokens


def channel_profiles(rows: DataFrame) -> DataFrame:
    """channel, n and c0, c1, ...: shares of its messages by cluster."""
    names = sorted(r[0] for r in rows.select("cluster").distinct().collect())
    wide = rows.groupBy("channel").agg(F.count("*").alias("n"), *[F.count_if(F.col("cluster") == c).alias(f"c{c}") for c in names])
    return wide.select("channel", "n", *[(F.col(f"c{c}") / F.col("n")).alias(f"c{c}") for c in names])


def communities(rows: DataFrame, k: int = 12, seeds: Sequence[int] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """(channel, n, shares by cluster, community: the largest by channels is 0; vectors for a grid)."""
    profiles = channel_profiles(rows)
    shares = [c for c in profiles.columns if c not in ("channel", "n")]
    if not shares:
        return profiles.withColumn("community", F.lit(0)), profiles
    vectors = stage(VectorAssembler(inputCols=shares, outputCol="features").transform(profiles), "profiles")
    return assigned(vectors, k, F.lit(1), seeds)[0].withColumnRenamed("cluster", "community"), vectors


def top_two(shares: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """The two largest values of each group, rank 1 and 2; ties by name."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), name))
    return shares.withColumn("rank", r).where("rank <= 2")
