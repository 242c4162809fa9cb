"""Exact order statistics that no single task has to hold: quantiles and average ranks.

Quantiles: approximate quantiles bound each wanted rank from both sides; the rows below the bound are counted, and only
the few values between the bounds are sorted. Ranks: the different values with their counts are cut into buckets at
approximate quantiles; each bucket is ranked by its own window, and the rows of the buckets before are added. Neither
needs a window without partition, nor a map of all different values in one aggregate.

Defined results: null and NaN values are left out; of ties each has the mean of their ranks; quantiles are linear between
neighbours, and null without values; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.session import cut

#: Relative error 1 / ACCURACY of the ranks of approximate quantiles.
ACCURACY = 10_000
#: Buckets of a ranked column, a square: a window ranks one bucket of its different values.
BUCKETS = 1024


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def exact_quantiles(cells: DataFrame, keys: list[str], shares: Sequence[float], value: str = "x", **more: Column) -> DataFrame:
    """Rows (keys, n, more..., q): the exact quantiles of value per group, as an array in the order of shares.

    n: the group's values; without any it is 0 and q is null. more: further aggregates of the group, computed in the same
    pass. Keys must not be null. The bounds, one row per group, are written, and joined as the planner finds best for
    their size; without keys that is one row.
    """
    x = F.col(value)
    rows = cells.withColumn(value, F.when(_known(x.cast("double")), x.cast("double")))
    points = [min(max(s + d / ACCURACY, 0.0), 1.0) for s in shares for d in (-4, 4)]
    # among fewer than ACCURACY rows the bounds may lie beside the wanted ranks, so all of these few are sorted
    ends = F.array(*([F.min(x), F.max(x)] * len(shares)))
    near = F.when(F.count(x) < ACCURACY, ends).otherwise(F.percentile_approx(x, F.array(*map(F.lit, points)), F.lit(ACCURACY))).alias("__near")
    bounds = cut(rows.groupBy(*keys).agg(F.count(x).alias("n"), near, *(c.alias(k) for k, c in more.items())))
    slim = bounds.select(*keys, "n", "__near")
    told = rows.select(*keys, value).where(x.isNotNull())
    met = told.join(slim, keys) if keys else told.crossJoin(F.broadcast(slim))
    # per wanted quantile: a value between its bounds, or null for one below them
    place = [F.when(x < F.col("__near")[2 * i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))).when(x <= F.col("__near")[2 * i + 1], F.struct(F.lit(i).alias("i"), x.alias("v"))) for i in range(len(shares))]
    some = met.select(*keys, "n", F.explode(F.filter(F.array(*place), lambda p: p.isNotNull())).alias("p")).groupBy(*keys, "n", "p.i", "p.v").agg(F.count("*").alias("__k"))
    by = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v"))
    some = some.withColumn("__to", F.sum("__k").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("v IS NOT NULL")
    at = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("i") + 1) * (F.col("n") - 1)
    pair = [F.max(F.when(_holds(F.col("__to") - F.col("__k"), F.col("__to"), r), F.col("v"))) for r in (F.floor(at), F.ceil(at))]
    found = some.groupBy(*keys, "i").agg(F.max(at).alias("at"), pair[0].alias("a"), pair[1].alias("b"))
    made = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", _between("at", "a", "b").alias("v")))), lambda s: s["v"]).alias("q"))
    whole = bounds.drop("__near")
    return whole.join(made, keys, "left") if keys else whole.crossJoin(F.broadcast(made)).withColumn("q", F.when(F.col("n") > 0, F.col("q")))


def _holds(first: Column, after: Column, rank: Column) -> Column:
    """Whether a value that has the ranks from first until before after has this one."""
    return (first <= rank) & (rank < after)


def _between(at: str, a: str, b: str) -> Column:
    """The value at the rank at between the values a and b at the whole ranks beside it."""
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise((F.ceil(at) - F.col(at)) * F.col(a) + (F.col(at) - F.floor(at)) * F.col(b))


def column_quantiles(df: DataFrame, columns: list[str], shares: Sequence[float]) -> DataFrame:
    """Rows (coluna, q): exact quantiles of columns, null for a column without values."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("coluna"), F.col(c).cast("double").alias("x")) for c in columns))).alias("c")).select("c.*")
    return exact_quantiles(cells, ["coluna"], shares).select("coluna", "q")


def quantile_values(df: DataFrame, columns: list[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """column_quantiles() on the driver: len(shares) numbers per column, nulls for a column without values."""
    got = {r.coluna: r.q and list(r.q) for r in column_quantiles(df, columns, shares).collect()}
    return {c: got.get(c) or [None] * len(shares) for c in columns}


def bucketed(counts: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """counts with __b, the bucket of each value within its group; buckets hold about as many different values each.

    The cut points, BUCKETS - 1 numbers a group, are searched in two steps.
    """
    step = int(BUCKETS**0.5)
    points = F.percentile_approx(value, F.array(*(F.lit(i / BUCKETS) for i in range(1, BUCKETS))), F.lit(2 * BUCKETS))
    cuts = counts.groupBy(*keys).agg(points.alias("__cuts")).withColumn("__top", F.expr(f"transform(sequence(1, {step} - 1), i -> __cuts[i * {step} - 1])"))
    met = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))
    under = lambda a: F.size(F.filter(a, lambda c: c <= F.col(value)))
    met = met.withColumn("__t", under(F.col("__top")) * step)
    return met.withColumn("__b", F.col("__t") + under(F.slice("__cuts", F.col("__t") + 1, F.lit(step - 1)))).drop("__cuts", "__top", "__t")


def average_ranks(cells: DataFrame, keys: list[str], value: str = "x", weight: str | None = None) -> DataFrame:
    """Rows (keys, value, vezes, posto): each different value of a group, its count and the mean rank of its rows, from 1.

    weight: a column with the number of rows that a row stands for.
    """
    counts = cells.where(_known(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias(value)).agg((F.sum(weight) if weight else F.count("*")).alias("vezes"))
    counts = cut(bucketed(counts, keys, value))
    sizes = counts.groupBy(*keys, "__b").agg(F.sum("vezes").alias("__s")).groupBy(*keys).agg(F.collect_list(F.struct("__b", "__s")).alias("__sizes"))
    per = counts.select(*keys, "__b").distinct()
    per = per.join(sizes, keys) if keys else per.crossJoin(F.broadcast(sizes))
    ahead = per.select(*keys, "__b", F.aggregate(F.filter("__sizes", lambda s: s["__b"] < F.col("__b")), F.lit(0).cast("long"), lambda t, s: t + s["__s"]).alias("__ahead"))
    within = F.sum("vezes").over(Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(ahead, [*keys, "__b"]).withColumn("__in", within)
    return ranked.select(*keys, value, "vezes", (F.col("__ahead") + F.col("__in") - (F.col("vezes") - 1) / 2.0).alias("posto"))


def ranked_values(df: DataFrame, column: str, knots: int) -> list[float]:
    """The values at knots evenly spaced ranks of a column, exact and on the driver; at every rank where there are fewer rows."""
    ranks = average_ranks(df.select(column), [], column)
    n = ranks.agg(F.sum("vezes")).first()[0] or 0
    if not n:
        return []
    k = min(knots, n)
    first = F.col("posto") - (F.col("vezes") + 1) / 2.0  # rows before the value
    step = (n - 1) / max(k - 1, 1)
    # the knots whose lower or upper neighbouring rank the value holds
    low = F.greatest(F.floor((first - 1) / step) if step else F.lit(0), F.lit(0))
    high = F.least(F.ceil((first + F.col("vezes")) / step) if step else F.lit(0), F.lit(k - 1))
    held = ranks.select(F.col(column).alias("v"), first.alias("a"), (first + F.col("vezes")).alias("z"), F.explode(F.sequence(low.cast("int"), F.greatest(high, low).cast("int"))).alias("i"))
    at = F.col("i") * F.lit(float(step))
    pair = [F.max(F.when(_holds(F.col("a"), F.col("z"), r), F.col("v"))) for r in (F.floor(at), F.ceil(at))]
    ends = held.groupBy("i").agg(F.max(at).alias("at"), pair[0].alias("a"), F.coalesce(*pair[::-1]).alias("b")).where("a IS NOT NULL")
    return [r.v for r in ends.orderBy("i").select(_between("at", "a", "b").alias("v")).collect()]


def positions(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows (column, name): the place of each different value in ascending order, from 0; for values of any type.

    The values are sorted in ranges, one per task; the sizes of the ranges before are added.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = cut(values.repartitionByRange(ranges, column).withColumn("__p", F.spark_partition_id()))
    sizes = values.groupBy("__p").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("__p", "n")).alias("__sizes"))
    ahead = F.aggregate(F.filter("__sizes", lambda s: s["__p"] < F.col("__p")), F.lit(0).cast("long"), lambda t, s: t + s["n"])
    within = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return values.withColumn("__in", within).crossJoin(F.broadcast(sizes)).select(column, (ahead + F.col("__in")).cast("int").alias(name))
