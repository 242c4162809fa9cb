"""Preprocessing estimators with exact statistics: imputing, scaling, capping, power transforms, encoding.

Each fit is one aggregate over the data (a few for the power transforms); the fitted object holds numbers only and its
transform is a projection.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.operators.order import positions, quantile_values, ranked_values

#: More levels than this are too many for a column each.
MOST_LEVELS = 10_000


#: How a fitted step of each kind makes its column from column c and its numbers or value p.
_KINDS: dict[str, Callable[[Column, list], Column]] = {
    "fill": lambda c, p: F.coalesce(c.cast("double"), F.lit(p[0]).cast("double")),
    "fill_same": lambda c, p: F.coalesce(c, F.lit(p[0])),
    "scale": lambda c, p: (c - F.lit(p[0]).cast("double")) / F.lit(p[1]),
    "cap": lambda c, p: F.when(c.isNotNull(), F.least(c.cast("double"), F.lit(p[0]).cast("double"))),
    "yeo_johnson": lambda c, p: yeo_johnson(c.cast("double"), p[0]),
    "box_cox": lambda c, p: F.when(c > 0, box_cox(c.cast("double"), p[0])),
    "level": lambda c, p: F.coalesce((c == p[0]).cast("int"), F.lit(0)),
}


class Step(NamedTuple):
    """One fitted column: its kind, the column it reads, the column it makes, its numbers or value."""

    kind: str
    of: str
    name: str
    params: list


class Fitted:
    """Fitted steps in stages; the steps of a stage are applied together. Holds numbers and names only.

    keep: with it, transform() gives these columns and the made ones alone; else all columns of the input stay.
    """

    def __init__(self, stages: Iterable[Iterable[Step]], keep: list[str] | None = None):
        self.stages = [[Step(*s) for s in stage] for stage in stages]
        self.keep = keep

    @property
    def columns(self) -> list[str]:
        """The columns made, in order."""
        return list(dict.fromkeys(s.name for stage in self.stages for s in stage))

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = df.withColumns({s.name: _KINDS[s.kind](F.col(s.of), s.params) for s in stage})
        return df.select(*self.keep, *(c for c in self.columns if c not in self.keep)) if self.keep is not None else df

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a folder, replacing what is there."""
        text = json.dumps({"stages": self.stages, "keep": self.keep})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        """Read what save() wrote."""
        return Fitted(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


class Chain:
    """Estimators of this module by name, each with its columns, fitted one after the other."""

    def __init__(self, steps: list[tuple[str, list[str]]]):
        self.steps = steps

    def fit(self, df: DataFrame) -> Fitted:
        stages: list[list[Step]] = []
        for name, columns in self.steps:
            made = ESTIMATORS[name](df, columns)
            df = made.transform(df)
            stages += made.stages
        return Fitted(stages)


class ColumnTransformer:
    """Chains over columns of their own, fitted on the same rows; what no chain makes and keep doesn't name is dropped."""

    def __init__(self, parts: list[Chain], keep: list[str] | None = None):
        self.parts, self.keep = parts, keep or []

    def fit(self, df: DataFrame) -> Fitted:
        made = [p.fit(df).stages for p in self.parts]
        return Fitted([[s for stages in made if i < len(stages) for s in stages[i]] for i in range(max(map(len, made), default=0))], self.keep)


def _one(df: DataFrame, **aggs: Column) -> dict:
    return df.agg(*(a.alias(k) for k, a in aggs.items())).first().asDict()


def _stage(kind: str, params: dict[str, list]) -> Fitted:
    return Fitted([[Step(kind, c, c, p) for c, p in params.items()]])


def impute_median(df: DataFrame, columns: list[str]) -> Fitted:
    """Nulls as the exact median."""
    return _stage("fill", quantile_values(df, columns, [0.5]))


def impute_mode(df: DataFrame, columns: list[str]) -> Fitted:
    """Nulls as the most frequent value, the smallest of equals."""
    m = _one(df, **{c: F.mode(c, True) for c in columns})
    return _stage("fill_same", {c: [m[c]] for c in columns})


def standard_scale(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    m = _one(df, **{f"a_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns})
    return _stage("scale", {c: [m[f"a_{c}"], m[f"s_{c}"] or 1.0] for c in columns})


def robust_scale(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - median) / (p75 - p25), exact; a range of 0 counts as 1."""
    m = quantile_values(df, columns, [0.25, 0.5, 0.75])
    return _stage("scale", {c: [m[c][1], ((m[c][2] or 0.0) - (m[c][0] or 0.0)) or 1.0] for c in columns})


def winsorize(df: DataFrame, columns: list[str], fold: float = 0.01) -> Fitted:
    """Values above the quantile 1 - fold as that quantile."""
    return _stage("cap", quantile_values(df, columns, [1 - fold]))


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transform."""
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float) -> Column:
    """The Box-Cox transform of positive values."""
    return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def _best_lambda(df: DataFrame, column: str, transform, jacobian: Column, steps: int = 3, low: float = -2.0, high: float = 3.0, points: int = 21) -> float:
    """The likeliest lambda: a grid refined steps times, each grid evaluated in one aggregate."""
    x = F.col(column).cast("double")
    for _ in range(steps):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        m = _one(df.where(x.isNotNull()), n=F.count(x), j=F.sum(jacobian), **{f"v{i}": F.var_pop(transform(x, g)) for i, g in enumerate(grid)})
        if not m["n"]:
            return 1.0
        score = [-m["n"] / 2 * math.log(m[f"v{i}"]) + (g - 1) * m["j"] if m[f"v{i}"] else -math.inf for i, g in enumerate(grid)]
        best = max(range(points), key=lambda i: score[i])
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (low + high) / 2


def fit_yeo_johnson(df: DataFrame, columns: list[str]) -> tuple[Fitted, dict[str, float]]:
    """Yeo-Johnson with the likeliest lambda of each column, and the lambdas."""
    lams = {c: _best_lambda(df, c, yeo_johnson, F.signum(F.col(c)) * F.log1p(F.abs(F.col(c)))) for c in columns}
    return _stage("yeo_johnson", {c: [lam] for c, lam in lams.items()}), lams


def fit_box_cox(df: DataFrame, columns: list[str]) -> tuple[Fitted, dict[str, float]]:
    """Box-Cox over the positive values, others null, with the likeliest lambda of each column."""
    lams = {c: _best_lambda(df.where(F.col(c) > 0), c, box_cox, F.ln(F.col(c))) for c in columns}
    return _stage("box_cox", {c: [lam] for c, lam in lams.items()}), lams


class NormalQuantiles:
    """A target's quantiles mapped to those of the normal distribution, and back, by interpolation between knots.

    A target of fewer rows than knots has a knot per row. The fitted knots are 2 * knots numbers.
    """

    def __init__(self, df: DataFrame, column: str, knots: int = 1000):
        self.values = ranked_values(df, column, knots)
        n, last = NormalDist(), max(len(self.values) - 1, 1)
        self.scores = [n.inv_cdf(min(max(i / last, 1e-7), 1 - 1e-7)) for i in range(len(self.values))]

    @staticmethod
    def _interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
        if not xs:
            return F.lit(None).cast("double")
        a, b = np.array(xs), np.array(ys)

        @F.pandas_udf("double")
        def put(v: pd.Series) -> pd.Series:
            # where a value fills several knots, the middle between the first and the last of them stands for it
            return pd.Series((np.interp(v, a, b) - np.interp(-v, -a[::-1], -b[::-1])) / 2)

        return F.when(x.isNotNull(), put(x.cast("double")))

    def forward(self, x: Column) -> Column:
        return self._interpolate(x, self.values, self.scores)

    def inverse(self, z: Column) -> Column:
        return self._interpolate(z, self.scores, self.values)


def one_hot(df: DataFrame, column: str, drop_first: bool = True) -> Fitted:
    """A 0/1 column per level of a category, in alphabetical order; unknown levels give all zeros. More than MOST_LEVELS levels raise ValueError."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return Fitted([[Step("level", column, f"{column}_{v}", [v]) for v in levels[1 if drop_first else 0 :]]])


def ordinal(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """df with the place of a category among its different values in alphabetical order, from 0; null stays null."""
    return df.join(positions(df, column, name or f"{column}_ord"), column, "left")


#: Estimators that a Chain may name.
ESTIMATORS: dict[str, Callable[[DataFrame, list[str]], Fitted]] = {
    "impute_median": impute_median, "impute_mode": impute_mode, "standard_scale": standard_scale, "robust_scale": robust_scale, "winsorize": winsorize,
    "yeo_johnson": lambda df, columns: fit_yeo_johnson(df, columns)[0], "box_cox": lambda df, columns: fit_box_cox(df, columns)[0],
    "one_hot": lambda df, columns: Fitted([[s for c in columns for s in one_hot(df, c).stages[0]]]),
}


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and products of pairs as columns, without constant."""
    pairs = {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(columns) for b in columns[i:]}
    return df.withColumns(pairs)


def log1p(df: DataFrame, *columns: str) -> DataFrame:
    """log(1 + x) of columns."""
    return df.withColumns({c: F.log1p(c) for c in columns})


def _bits(key: Column, seed: int, at: int = 1) -> Column:
    """32 bits of a key's hash; any engine can compute them, so the same rows fall into the same parts anywhere. Null counts as empty."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")


def fold_of(key: Column, folds: int, seed: int = 1667) -> Column:
    """A row's fold by a hash of its key."""
    return (_bits(key, seed) % folds).cast("int")


def split(df: DataFrame, key: str, share: float, seed: int = 1667) -> tuple[DataFrame, DataFrame]:
    """Two parts of df by a hash of the key, the first with about the given share."""
    u = _bits(F.col(key), seed, 9) / F.lit(float(1 << 32))
    return df.where(u < share), df.where(u >= share)
