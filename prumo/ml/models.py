"""Price models: linear and ridge regression, boosted trees, tuning by folds, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.ml.metrics import metrics
from prumo.ml.prep import NormalQuantiles, fold_of, impute_median
from prumo.operators.order import quantile_values
from prumo.session import cut


class LinearModel:
    """Fitted coefficients and intercept; transform() adds y_pred and leaves out rows that lack a feature."""

    def __init__(self, features: list[str], coefficients: list[float], intercept: float):
        self.features, self.coefficients, self.intercept = features, coefficients, intercept

    def transform(self, df: DataFrame) -> DataFrame:
        y = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            y = y + F.col(c).cast("double") * F.lit(b)
        return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in self.features) or "true").withColumn("y_pred", y)


class LeastSquares:
    """Least squares by the normal equations; alpha is a penalty on the sum of squared coefficients, the intercept is free.

    One aggregate gives all covariances; the driver solves a system of as many equations as there are features. Features
    that don't vary, or follow from others, get the coefficients of least size.
    """

    def __init__(self, features: list[str], target: str, alpha: float = 0.0):
        self.features, self.target, self.alpha = features, target, alpha

    def fit(self, df: DataFrame) -> LinearModel:
        x = [F.col(c).cast("double") for c in self.features]
        y, k = F.col(self.target).cast("double"), len(x)
        told = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*self.features, self.target]))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        means = [*(F.avg(c) for c in x), F.avg(y)]
        m = told.agg(F.count("*"), *(F.covar_pop(x[i], x[j]) for i, j in pairs), *(F.covar_pop(c, y) for c in x), *means).first()
        n = m[0]
        if not n:
            raise ValueError("no rows to fit")
        a = np.zeros((k, k))
        for (i, j), v in zip(pairs, m[1 : 1 + len(pairs)]):
            a[i, j] = a[j, i] = v
        a += np.eye(k) * (self.alpha / n)
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        right = np.array(m[1 + len(pairs) : 1 + len(pairs) + k])
        b = np.linalg.lstsq(a / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale if k else np.zeros(0)
        at = m[1 + len(pairs) + k :]
        return LinearModel(self.features, [float(v) for v in b], float(at[k] - sum(v * c for v, c in zip(b, at))))


def linear(features: list[str], target: str, alpha: float = 0.0) -> LeastSquares:
    """Least squares, or ridge with the penalty alpha."""
    return LeastSquares(features, target, alpha)


def boosted(features: list[str], target: str, **params: Any) -> Pipeline:
    """Gradient-boosted regression trees (maxIter, maxDepth, stepSize, subsamplingRate, minInstancesPerNode, ...)."""
    put = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    return Pipeline(stages=[put, GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="y_pred", seed=1667, **params)])


def fit_transformed(df: DataFrame, features: list[str], target: str, make: Callable[[list[str], str], Any] = linear) -> Callable[[DataFrame], DataFrame]:
    """Fit on the target's normal quantile scores; the result predicts in the target's own units (y_pred)."""
    q = NormalQuantiles(df, target)
    model = make(features, "__z").fit(df.withColumn("__z", q.forward(F.col(target).cast("double"))))
    return lambda new: model.transform(new).withColumn("y_pred", q.inverse(F.col("y_pred"))).drop("__x")


def folded(df: DataFrame, key: str, folds: int) -> DataFrame:
    """df with __fold by a hash of the key, written once for all fits."""
    return cut(df.withColumn("__fold", fold_of(F.col(key), folds)))


def _folds(rows: DataFrame, features: list[str], target: str, make: Callable, folds: int, median: bool) -> DataFrame:
    seen = None
    for f in range(folds):
        one = make(features, target).fit(rows.where(F.col("__fold") != f)).transform(rows.where(F.col("__fold") == f)).select(F.lit(f).alias("fold"), F.col(target).alias("y_true"), "y_pred")
        seen = one if seen is None else seen.unionByName(one)
    return metrics(seen, by="fold", median=median)


def cross_validate(df: DataFrame, key: str, features: list[str], target: str, make: Callable[[list[str], str], Any], folds: int = 5) -> DataFrame:
    """Metrics per fold, folds by a hash of the key; a fold without rows has no row."""
    return _folds(folded(df, key, folds), features, target, make, folds, True)


def tune(df: DataFrame, key: str, features: list[str], target: str, make: Callable[..., Any], grid: list[dict], folds: int = 5, metric: str = "mae", rising: bool = False) -> tuple[dict, list[tuple[dict, float]]]:
    """The best parameters of a grid by the mean metric over folds, and all scores in the order of the grid."""
    rows = folded(df, key, folds)
    scores = [(g, _folds(rows, features, target, lambda x, y, g=g: make(x, y, **g), folds, metric == "medae").agg(F.avg(metric)).first()[0]) for g in grid]
    best = (max if rising else min)(scores, key=lambda s: s[1])
    return best[0], scores


def random_grid(space: dict[str, tuple[float, float]], trials: int, seed: int = 1667, log: bool = False) -> list[dict]:
    """trials random parameter sets from ranges, on a logarithmic scale if log."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: float(math.exp(rng.uniform(math.log(a), math.log(b)))) if log else float(rng.uniform(a, b))
    return [{k: draw(*v) for k, v in space.items()} for _ in range(trials)]


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    """An isolation tree as nested lists: [size], or [column, value, left, right]."""
    if depth == 0 or len(x) <= 1:
        return [len(x)]
    spread = np.flatnonzero(x.max(0) > x.min(0))
    if not len(spread):
        return [len(x)]
    k = int(rng.choice(spread))
    v = float(rng.uniform(x[:, k].min(), x[:, k].max()))
    left = x[:, k] < v
    return [k, v, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)]


def _usual(n: float) -> float:
    """Mean path length in a tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _paths(tree: list, x: np.ndarray, depth: int, out: np.ndarray, rows: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _usual(tree[0])
        return
    left = x[rows, tree[0]] < tree[1]
    _paths(tree[2], x, depth + 1, out, rows[left])
    _paths(tree[3], x, depth + 1, out, rows[~left])


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 200, sample_rows: int = 256, contamination: float = 0.01, seed: int = 1667) -> DataFrame:
    """Rows (key, escore, outlier): isolation scores, and whether a row is among the contamination share of the highest.

    Trees are grown in the tasks, each from its own bounded sample of sample_rows rows (a documented parameter), and
    broadcast together: their size is bounded by trees * sample_rows. Every row is scored. Nulls count as the median.
    """
    full = impute_median(df.select(key, *columns), columns).transform(df.select(key, *columns))
    n = full.count()
    if not n:
        return df.select(key, F.lit(None).cast("double").alias("escore"), F.lit(None).cast("boolean").alias("outlier")).limit(0)
    # every tree draws its rows by a hash: about 1.5 times sample_rows, cut to sample_rows within the tree
    per = min(1.0, 1.5 * sample_rows * trees / n)
    drawn = full.withColumn("__u", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000).where(F.col("__u") < per)
    copies = max(1, math.ceil(1.5 * sample_rows * trees / n)) if per == 1.0 else 1
    drawn = drawn.withColumn("__t", F.explode(F.transform(F.sequence(F.lit(1), F.lit(copies)), lambda c: F.pmod(F.xxhash64(F.col(key), c, F.lit(seed + 1)), F.lit(trees)).cast("int"))))
    depth = math.ceil(math.log2(max(2, sample_rows)))

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        rng = np.random.default_rng(seed + int(k[0]))
        x = pdf.sort_values(key)[columns].to_numpy(float)
        x = x[rng.permutation(len(x))[:sample_rows]]
        return pd.DataFrame({"arvore": [pickle.dumps((_tree(x, rng, depth), len(x)))]})

    grown = [r.arvore for r in drawn.groupBy("__t").applyInPandas(grow, "arvore binary").collect()]
    shared = df.sparkSession.sparkContext.broadcast(grown)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        forest = [pickle.loads(t) for t in shared.value]
        usual = float(np.mean([max(_usual(size), 1e-9) for _, size in forest]))
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            total = np.zeros(len(x))
            for t, _ in forest:
                _paths(t, x, 0, total, np.arange(len(x)))
            yield pd.DataFrame({key: pdf[key], "escore": 2 ** (-(total / len(forest)) / usual)})

    scored = full.mapInPandas(score, f"`{key}` {dict(full.dtypes)[key]}, escore double")
    scored = cut(scored)
    edge = quantile_values(scored, ["escore"], [1 - contamination])["escore"][0]
    return scored.select(key, "escore", (F.col("escore") > F.lit(edge)).alias("outlier"))
