"""Regression errors and metrics as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.operators.order import exact_quantiles


def error_frame(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """df with residual, abs_error, sq_error, relative_error and absolute_relative_error; relative ones null for a true 0."""
    r = F.col(y) - F.col(p)
    true = F.nullif(F.col(y), F.lit(0.0))
    return df.withColumns({"residual": r, "abs_error": F.abs(r), "sq_error": r * r, "relative_error": r / true, "absolute_relative_error": F.abs(r) / true})


def metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: str | None = None, median: bool = True) -> DataFrame:
    """r2, rmse, mae, medae (with median), mape of predictions, overall or per fold; r2 is null where the true values don't vary."""
    told = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*([F.col(by)] if by else []), F.col(y).cast("double").alias("y"), (F.col(y) - F.col(p)).cast("double").alias("r"))
    keys = [by] if by else []
    total = F.var_pop("y") * F.count("y")
    more = {
        "r2": 1 - F.sum(F.col("r") * F.col("r")) / F.nullif(total, F.lit(0.0)), "rmse": F.sqrt(F.avg(F.col("r") * F.col("r"))),
        "mae": F.avg(F.abs("r")), "mape": F.avg(F.abs("r") / F.nullif(F.abs("y"), F.lit(0.0))),
    }
    if not median:
        return told.groupBy(*keys).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in more.items()))
    made = exact_quantiles(told.withColumn("x", F.abs("r")), keys, [0.5], **more)
    return made.select(*keys, "n", "r2", "rmse", "mae", F.col("q")[0].alias("medae"), "mape")


def worst(df: DataFrame, k: int = 20, y: str = "y_true", p: str = "y_pred", *ties: str) -> DataFrame:
    """The k rows with the largest absolute error."""
    return error_frame(df, y, p).orderBy(F.desc("abs_error"), *(F.asc(t) for t in ties)).limit(k)
