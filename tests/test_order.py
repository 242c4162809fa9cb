import re

import numpy as np
import pytest

from prumo.operators import order
from prumo.operators.order import average_ranks, column_quantiles, exact_quantiles, positions, quantile_values, ranked_values
from prumo.plans.reference_queries import QUERIES

SHARES = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact_in_small_and_large_groups(spark, monkeypatch, accuracy):
    # with little accuracy, groups of 50 rows and more go through the bounds
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    groups = {"a": rng.normal(size=3000), "b": rng.integers(0, 5, 700).astype(float), "c": np.array([7.0]), "d": np.array([1.0, 2.0]), "e": np.full(400, 3.0), "f": rng.exponential(size=51) * 1e9}
    data = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("a", None, 1), ("b", float("nan"), 1), ("z", None, 1)]
    df = spark.createDataFrame(data, "g string, x double, n int").repartition(7)
    got = {r.g: r for r in exact_quantiles(df, ["g"], SHARES).collect()}
    for g, x in groups.items():
        assert got[g].n == len(x)
        assert np.allclose(got[g].q, np.quantile(x, SHARES), rtol=1e-12, atol=1e-12)
    assert got["z"].n == 0 and got["z"].q is None
    every = exact_quantiles(df, [], SHARES).first()
    assert np.allclose(every.q, np.quantile(np.concatenate(list(groups.values())), SHARES), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "x double, y int")
    assert quantile_values(none, ["x", "y"], [0.5]) == {"x": [None], "y": [None]}
    assert exact_quantiles(none, [], [0.5]).first().q is None
    assert column_quantiles(spark.createDataFrame([(None, 3)], "x double, y int"), ["x", "y"], [0.5]).orderBy("coluna").collect()[1].q == [3.0]
    assert ranked_values(none, "x", 10) == []


def test_average_ranks_and_positions(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(v), str(v)) for v in x] + [(None, None), (float("nan"), "nan")], "x double, s string").repartition(5)
    order_ = np.argsort(x, kind="stable")
    low = {v: i for i, v in reversed(list(enumerate(x[order_], 1)))}
    high = {v: i for i, v in enumerate(x[order_], 1)}
    ranks = {r.x: (r.posto, r.vezes) for r in average_ranks(df, []).collect()}
    assert ranks == {v: ((low[v] + high[v]) / 2, high[v] - low[v] + 1) for v in low}
    at = {r.s: r.p for r in positions(df, "s", "p").collect()}
    assert at == {v: i for i, v in enumerate(sorted({str(v) for v in x} | {"nan"}))}
    knots = ranked_values(df, "x", 101)
    assert np.allclose(knots, np.quantile(x, np.linspace(0, 1, 101)))
    assert ranked_values(spark.createDataFrame([(3.0,), (1.0,), (1.0,)], "x double"), "x", 101) == [1.0, 1.0, 3.0]


NAMES = ["a4_describe_by", "a5_describe", "a6_quantiles", "a10_spearman", "w4_average_rank", "m5_clip_to_quantiles", "e1_impute_median", "e4_robust_scale", "e5_winsorize", "e8_normal_quantiles", "e10_ordinal", "l2_isolation_forest", "l8_holdout_metrics"]


@pytest.mark.parametrize("name", NAMES)
def test_no_window_without_partition_and_no_map_of_all_values(spark, name):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    made = []
    jvm_plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = order.cut
    order.cut = lambda df: made.append(jvm_plan(df)) or real(df)
    try:
        made.append(jvm_plan(QUERIES[name](spark, "/root/testdata/sf0.001")))
    finally:
        order.cut = real
    for p in made:
        assert not re.search(r"\bpercentile\(", p)
        for w in re.findall(r"windowspecdefinition\(([^)]*)", p):
            assert not re.match(r"[^,]* (ASC|DESC) NULLS", w), w
