"""Exploratory statistics: describes, quantiles, correlations, null profiles, histograms, errors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.functions.cast import clip
from prumo.operators.order import average_ranks, column_quantiles, exact_quantiles, quantile_values
from prumo.session import cut


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (valor, n, pct) of a column's values, null among them."""
    counts = df.groupBy(F.col(column).cast("string").alias("valor")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("valor", "n", (100.0 * F.col("n") / F.col("__all")).alias("pct"))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows (coluna, nulos, pct): nulls of every column, in one pass."""
    flat = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return flat.select("__n", F.explode(F.array(*(F.struct(F.lit(c).alias("coluna"), F.col(c).alias("nulos")) for c in df.columns))).alias("x")).select("x.coluna", "x.nulos", F.round(100.0 * F.col("x.nulos") / F.nullif("__n", F.lit(0)), 2).alias("pct"))


_MORE = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _described(cells: DataFrame, keys: list[str]) -> DataFrame:
    made = exact_quantiles(cells, keys, (0.25, 0.5, 0.75), **{k: f("x") for k, f in _MORE.items()})
    return made.select(*keys, F.col("n").alias("count"), "mean", "std", "min", *(F.col("q")[i].alias(k) for i, k in enumerate(("p25", "p50", "p75"))), "max")


def describe_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum of a column per value of each key; null keys left out.

    All keys are described in one pass over the rows; a value of a key without any value of the column counts 0.
    """
    cells = df.select(F.col(column).cast("double").alias("x"), F.explode(F.array(*(F.struct(F.lit(k).alias("chave"), F.col(k).cast("string").alias("valor")) for k in keys))).alias("c")).where("c.valor IS NOT NULL").select("x", "c.*")
    return _described(cells, ["chave", "valor"])


def describe(df: DataFrame, column: str) -> DataFrame:
    """describe_by without a key."""
    return _described(df.select(F.col(column).cast("double").alias("x")), [])


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Rows (coluna, q, valor): exact quantiles, linear between neighbours."""
    at = F.array(*map(F.lit, map(float, shares)))
    return column_quantiles(df, columns, shares).select("coluna", F.explode(F.arrays_zip(at.alias("q"), F.coalesce("q", F.array().cast("array<double>")).alias("valor"))).alias("r")).select("coluna", "r.q", "r.valor")


def clip_to_quantiles(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 0.999) -> DataFrame:
    """Columns clipped to their own quantiles."""
    q = quantile_values(df, columns, [low, high])
    return df.withColumns({c: clip(F.col(c).cast("double"), *(F.lit(v).cast("double") for v in q[c])) for c in columns}).select(*df.columns)


def with_average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a column's value, ties with the mean of their ranks; rows without value are left out."""
    ranks = average_ranks(df.select(column), [], column).select(F.col(column).alias("__v"), F.col("posto").alias(name))
    return df.join(ranks, F.col(column).cast("double") == F.col("__v")).drop("__v")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, rho) for each pair of columns, over the rows that have both, ties with average ranks.

    All pairs are read in one pass; equal pairs of values are counted once.
    """
    pairs = list(combinations(columns, 2))
    both = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(i).alias("par"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))) for i, (a, b) in enumerate(pairs)))
    cells = cut(df.select(F.explode(F.filter(both, lambda p: p.isNotNull())).alias("p")).groupBy("p.par", "p.x", "p.y").agg(F.count("*").alias("k")))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("lado"), F.col(s).alias("v")) for s in ("x", "y")))).alias("s")
    ranks = average_ranks(cells.select("par", "k", sides).select("par", "s.*", "k"), ["par", "lado"], "v", weight="k")
    side = {s: ranks.where(F.col("lado") == s).select("par", F.col("v").alias(s), F.col("posto").alias(f"r{s}")) for s in ("x", "y")}
    met = cells.join(side["x"], ["par", "x"]).join(side["y"], ["par", "y"])
    k, rx, ry = F.col("k").cast("double"), F.col("rx"), F.col("ry")
    n, sx, sy, sxx, syy, sxy = (F.sum(e) for e in (k, k * rx, k * ry, k * rx * rx, k * ry * ry, k * rx * ry))
    rho = (sxy - sx * sy / n) / F.nullif(F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), F.lit(0.0))
    names = [F.element_at(F.array(*(F.lit(p[j]) for p in pairs)), F.col("par") + 1).alias("ab"[j]) for j in (0, 1)]
    return met.groupBy("par").agg(rho.alias("rho")).select(*names, "rho")


def null_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, r): Pearson correlation of the columns' null flags; null where one never or always is."""
    flag = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = list(combinations(columns, 2))
    flat = df.agg(*(F.corr(flag[a], flag[b]).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)))
    return flat.select(F.explode(rows).alias("x")).select("x.a", "x.b", F.when(~F.isnan("x.r"), F.col("x.r")).alias("r"))


def null_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (padrao, n): combinations of null (0) and told (1) over the columns."""
    return df.groupBy(F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns)).alias("padrao")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Rows ([grupo,] bin, n): equal-width bins between minimum and maximum, the maximum in the last bin."""
    keys = ["grupo"] if by else []
    x = df.select(*([F.col(by).cast("string").alias("grupo")] if by else []), F.col(column).cast("double").alias("x")).where("x IS NOT NULL" + (" AND grupo IS NOT NULL" if by else ""))
    ends = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    both = x.join(ends, keys) if by else x.crossJoin(F.broadcast(ends))
    k = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return both.groupBy(*keys, k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Rows (x, densidade): a Gaussian kernel estimate with Scott's bandwidth at evenly spaced points.

    Each row meets the fixed number of points, summed per point before the shuffle.
    """
    x = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    s = x.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = s.where("h > 0").select("n", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select("n", "h", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return x.crossJoin(F.broadcast(grid)).groupBy("x", "n", "h").agg(F.sum(F.exp(-z * z / 2)).alias("s")).select("x", (F.col("s") / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("densidade"))


def coverage(local: DataFrame, official: DataFrame, key: str, category: str) -> DataFrame:
    """Rows (categoria, locais, oficiais, pct): different local ids against the official totals (categoria, total)."""
    have = local.groupBy(F.col(category).alias("categoria")).agg(F.countDistinct(key).alias("locais"))
    pct = F.when(F.col("total") > 0, 100.0 * F.coalesce("locais", F.lit(0)) / F.col("total"))
    return official.join(have, "categoria", "left").select("categoria", F.coalesce("locais", F.lit(0)).alias("locais"), F.col("total").alias("oficiais"), pct.alias("pct"))
