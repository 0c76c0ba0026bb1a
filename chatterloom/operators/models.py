"""Features and models: TF-IDF, multi-hot, gradient-descent logistic regression, clusters, label model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.operators.sampling import group_split


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 2, max_features: int = 20_000) -> DataFrame:
    """key, term, weight: words of two or more characters, smooth idf, each text of norm one.

    The vocabulary is the max_features most frequent terms of the corpus; ties go by term.
    """
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = F.broadcast(df.select(F.count("*").alias("n")))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    w = tf.join(F.broadcast(vocabulary.select("term", "df")), "term").crossJoin(n).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", F.round(F.col("w") / norm, 6).alias("weight"))


def multi_hot(df: DataFrame, tokens: str, vocabulary: Sequence[str], out: str = "features") -> DataFrame:
    """df with a 0/1 vector over the sorted vocabulary; unknown tokens are ignored."""
    model = CountVectorizerModel.from_vocabulary(sorted(vocabulary), inputCol=tokens, outputCol=out)
    return model.setBinary(True).transform(df)


def logistic_gd(patterns: DataFrame, tokens: str, label: str, vocabulary: Sequence[str], rate: float = 0.5, steps: int = 300, c: float = 1.0, max_patterns: int = 200_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of full-batch gradient descent from zero with balanced weights and L2 on the coefficients.

    Rows are first collapsed to distinct (token set, label) patterns with counts; these are checked to be few.
    """
    names = sorted(vocabulary)
    rows = patterns.groupBy(F.array_sort(F.array_distinct(tokens)).alias("t"), F.col(label).alias("y")).count().limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} distinct patterns")
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[t] for t in r["t"] if t in at]] = 1
    return descend(x, np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float), rate, steps, c)


def descend(x: np.ndarray, y: np.ndarray, k: np.ndarray, rate: float, steps: int, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by full-batch gradient descent on rows that count k times, with balanced classes."""
    n = max(k.sum(), 1)
    of = {v: k[y == v].sum() for v in (0.0, 1.0)}
    w = k * np.where(y == 1, n / (2 * max(of[1.0], 1)), n / (2 * max(of[0.0], 1)))
    beta, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-(x @ beta + b))) - y)
        beta -= rate * (x.T @ g / n + beta / (c * n))
        b -= rate * g.sum() / n
    return beta, b


def _macro(y: np.ndarray, pred: np.ndarray, k: np.ndarray) -> tuple[float, float, float]:
    """Macro F1, macro recall and recall of the positives of rows that count k times; classes in neither do not count."""
    f1, recall = [], []
    for v in (0, 1):
        tp, ours, theirs = k[(y == v) & (pred == v)].sum(), k[pred == v].sum(), k[y == v].sum()
        if ours or theirs:
            f1.append(2 * tp / (ours + theirs))
        if theirs:
            recall.append(tp / theirs)
    positives = k[y == 1].sum()
    return float(np.mean(f1 or [0])), float(np.mean(recall or [0])), float(k[(y == 1) & (pred == 1)].sum() / positives) if positives else 0.0


def _auc(y: np.ndarray, p: np.ndarray, k: np.ndarray) -> float:
    _, group = np.unique(p, return_inverse=True)
    pos, neg = (np.bincount(group, k * (y == v)) for v in (1, 0))
    below = np.cumsum(neg) - neg
    total = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / total) if total else float("nan")


THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
TUNED = "best_rate double, threshold double, n_features int, n_test bigint, accuracy double, macro_f1 double, macro_recall double, recall_pos double, roc_auc double, brier double, ece double"


def val_tuned(split: np.ndarray, tokens: Sequence[Sequence[str]], y: np.ndarray, k: np.ndarray, rates: Sequence[float], steps: int) -> tuple:
    """Values of TUNED: the rate and threshold with the best macro F1 on val (the first of equals), fitted again on train and val, judged on test.

    The vocabulary is that of train and val. Rows are patterns that count k times.
    """
    seen = split != "test"
    names = sorted({t for ts, s in zip(tokens, seen) if s for t in ts})
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(y), len(names)))
    for i, ts in enumerate(tokens):
        x[i, [at[t] for t in ts if t in at]] = 1
    y, k = y.astype(float), k.astype(float)
    train, val, test = (split == s for s in ("train", "val", "test"))
    best = (-1.0, rates[0], THRESHOLDS[0])
    for rate in rates:
        beta, b = descend(x[train], y[train], k[train], rate, steps)
        p = 1 / (1 + np.exp(-(x[val] @ beta + b)))
        for t in THRESHOLDS:
            score = _macro(y[val], (p >= t).astype(int), k[val])[0]
            if score > best[0]:
                best = (score, rate, t)
    beta, b = descend(x[seen], y[seen], k[seen], best[1], steps)
    p, y, k = 1 / (1 + np.exp(-(x[test] @ beta + b))), y[test], k[test]
    pred, n = (p >= best[2]).astype(int), max(k.sum(), 1)
    bins = np.floor(p * 10)
    ece = sum(abs((k * (p - y))[bins == i].sum()) for i in range(10)) / n
    return best[1], best[2], len(names), int(k.sum()), float(k[y == pred].sum() / n), *_macro(y, pred, k), _auc(y, p, k), float((k * (p - y) ** 2).sum() / n), float(ece)


def tuned_grid(rows: DataFrame, tokens: str, label: str, group: str, key: str, sets: dict[str, Sequence[str]], seeds: Sequence[int], rates: Sequence[float] = (0.001, 0.003, 0.01), steps: int = 1000) -> DataFrame:
    """model, seed and TUNED for every set of token prefixes and every seeded split.

    A fifth of the groups is test; of the other rows the eighth with the smallest seeded hashes is val. Rows are
    collapsed to token sets with counts, so a task gets the patterns of one model and seed, not its rows.
    """
    spark = rows.sparkSession
    split = group_split(rows, group, seeds)
    x = rows.join(split, group).withColumn("val", F.pmod(F.xxhash64(F.col(key), F.col("seed")), F.lit(1000)) < 125)
    x = x.withColumn("split", F.when(F.col("split") == "test", "test").when(F.col("val"), "val").otherwise("train"))
    x = x.groupBy("seed", "split", F.array_sort(F.array_distinct(tokens)).alias("t"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("k"))
    models = F.broadcast(spark.createDataFrame([(m, list(p)) for m, p in sets.items()], "model string, prefixes array<string>"))
    held = F.filter("t", lambda t: F.array_contains(F.col("prefixes"), F.element_at(F.split(t, "="), 1)))
    x = x.crossJoin(models).groupBy("model", "seed", "split", held.alias("t"), "y").agg(F.sum("k").alias("k"))

    def fit(key, part):
        part = part.sort_values(["split", "y", "k"], kind="stable")
        return pd.DataFrame([(*key, *val_tuned(part["split"].to_numpy(), part["t"].tolist(), part["y"].to_numpy(), part["k"].to_numpy(), rates, steps))], columns=["model", "seed", *[c.split()[0] for c in TUNED.split(", ")]])

    return x.groupBy("model", "seed").applyInPandas(fit, "model string, seed int, " + TUNED)


def score_gd(df: DataFrame, tokens: str, vocabulary: Sequence[str], beta: np.ndarray, b: float) -> DataFrame:
    """df with p, the probability under the model, as one expression."""
    weights = F.create_map(*[x for t, v in zip(sorted(vocabulary), beta) for x in (F.lit(t), F.lit(float(v)))])
    z = F.aggregate(F.array_distinct(tokens), F.lit(float(b)), lambda acc, t: acc + F.coalesce(F.try_element_at(weights, t), F.lit(0.0)))
    return df.withColumn("p", 1 / (1 + F.exp(-z)))


def flip_noise(df: DataFrame, key: str, tokens: str, vocabulary: Sequence[str], rates: Sequence[float], reps: int) -> DataFrame:
    """rate, rep, key and tokens with every vocabulary bit flipped with probability rate, by hash of (key, bit, rep)."""
    grid = F.broadcast(df.sparkSession.createDataFrame([(float(r), i) for r in rates for i in range(reps)], "rate double, rep int"))
    names = F.array(*map(F.lit, sorted(vocabulary)))
    x = df.crossJoin(grid)
    keep = F.filter(names, lambda t: F.array_contains(F.col(tokens), t) != ((F.pmod(F.xxhash64(F.col(key), t, F.col("rep")), F.lit(1_000_000)) / 1_000_000) < F.col("rate")))
    return x.withColumn(tokens, keep)


def cluster(df: DataFrame, features: str, k: int, seeds: Sequence[int]) -> tuple[DataFrame, float, float]:
    """df with cluster (largest first), cost and cosine silhouette of the cheapest of several starts."""
    models = [KMeans(k=k, seed=s, featuresCol=features, predictionCol="_c").fit(df) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(df)
    score = ClusteringEvaluator(predictionCol="_c", featuresCol=features, distanceMeasure="cosine").evaluate(out) if out.select("_c").distinct().count() > 1 else float("nan")
    order = out.groupBy("_c").count().select("_c", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "_c")) - 1).alias("cluster"))
    return out.join(F.broadcast(order), "_c").drop("_c"), float(best.summary.trainingCost), float(score)


def principal(df: DataFrame, features: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with pca, the scores on the centred features, and the explained variance ratios."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="pca").fit(centred)
    return model.transform(centred).drop("_centred"), [float(x) for x in model.explainedVariance]


def label_model(votes: DataFrame, signals: Sequence[str], rounds: int = 50) -> dict[str, float]:
    """Accuracy of each signal (1, 0, abstaining -1) by expectation maximisation with independent signals.

    Works on the distinct vote patterns and their counts.
    """
    rows = votes.groupBy(*signals).count().limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("more than 200000 distinct vote patterns")
    x = np.array([[r[s] for s in signals] for r in rows], float).reshape(len(rows), len(signals))
    k = np.array([r["count"] for r in rows], float)
    acc, prior = np.full(len(signals), 0.7), 0.5
    for _ in range(rounds):
        on1 = np.where(x == 1, np.log(acc), np.where(x == 0, np.log(1 - acc), 0)).sum(1) + np.log(prior)
        on0 = np.where(x == 0, np.log(acc), np.where(x == 1, np.log(1 - acc), 0)).sum(1) + np.log(1 - prior)
        p = 1 / (1 + np.exp(np.clip(on0 - on1, -500, 500)))
        right = ((x == 1) * p[:, None] + (x == 0) * (1 - p)[:, None]) * k[:, None]
        cast = (x >= 0) * k[:, None]
        acc = np.clip((right.sum(0) + 1) / (cast.sum(0) + 2), 0.05, 0.95)
        prior = float(np.clip((p * k).sum() / max(k.sum(), 1), 0.05, 0.95))
    return dict(zip(signals, acc.tolist()))


def stack(df: DataFrame, scores: Sequence[str], label: str, fit_on, c: float = 1.0) -> DataFrame:
    """df with p: converged logistic regression (L2, C = c) on the scores and the products of their pairs, fitted on the rows where fit_on holds."""
    names = list(scores)
    products = [(f"_x{i}_{j}", F.col(names[i]) * F.col(names[j])) for i in range(len(names)) for j in range(i)]
    x = VectorAssembler(inputCols=[*names, *[n for n, _ in products]], outputCol="_stack").transform(df.withColumns(dict(products)))
    train = x.where(fit_on)
    n = max(train.count(), 1)
    model = LogisticRegression(featuresCol="_stack", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, predictionCol="_pred", rawPredictionCol="_raw", probabilityCol="_prob").fit(train)
    return model.transform(x).withColumn("p", vector_to_array("_prob")[1]).drop("_stack", "_pred", "_raw", "_prob", *[n for n, _ in products])
