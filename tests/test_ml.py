import numpy as np
import pytest
from pyspark.sql import functions as F

from prumo.ml import models, prep
from prumo.ml.features import BINS, BinsDiscretizer, ClusterTransformer, GeodesicDistance, RatioTransformer, binned, distance_km
from prumo.ml.metrics import metrics, worst


def test_bins_ratios_distances(spark):
    name, edges, labels = BINS["area_m2"]
    df = spark.createDataFrame([(v,) for v in (0.0, 30.0, 30.1, 250.0, 250.1, None)], "area_m2 double")
    assert [r[0] for r in df.select(binned(F.col("area_m2"), edges, labels)).collect()] == [None, "muito_pequeno", "pequeno", "grande", "muito_grande", None]
    r = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 2.0)], "a double, b double")
    assert [x.a_por_b for x in RatioTransformer([("a", "b")]).transform(r).collect()] == [None, 2.5, None]
    d = spark.createDataFrame([(-16.7103239, -49.2372795), (-16.7, -49.25), (None, 1.0)], "latitude double, longitude double")
    got = [x[0] for x in d.select(distance_km(F.col("latitude"), F.col("longitude"), (-16.7079145, -49.2722946))).collect()]
    assert got[0] == pytest.approx(3.738721893, abs=1e-8) and got[2] is None
    assert len(GeodesicDistance().transform(d).columns) == 10


def test_transformers_check_their_input(spark):
    df = spark.createDataFrame([(1.0,)], "z double")
    for t in (BinsDiscretizer(), RatioTransformer([("a", "b")]), GeodesicDistance()):
        with pytest.raises(ValueError):
            t.transform(df)
        with pytest.raises(TypeError):
            t.transform([1])
    with pytest.raises(ValueError):
        ClusterTransformer().fit(df)
    with pytest.raises(TypeError):
        ClusterTransformer().fit(3)


def test_clusters_are_nearest_centres(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(200, 2))], "latitude double, longitude double")
    m = ClusterTransformer(k=4).fit(df)
    c = np.array(m.centres)
    for r in m.transform(df).collect():
        assert int(r.cluster) == int(np.argmin(((c - [r.latitude, r.longitude]) ** 2).sum(1)))


def test_prep_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lam = prep.fit_box_cox(df, ["v"])[1]["v"]
    assert abs(lam) < 0.15  # the logarithm of a log-normal is normal
    assert abs(prep.fit_yeo_johnson(spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "v double"), ["v"])[1]["v"] - 1) < 0.2
    s = np.array([r.v for r in prep.robust_scale(df, ["v"]).transform(df).collect()])
    q = np.percentile(x, [25, 50, 75])
    assert np.allclose(s, (x - q[1]) / (q[2] - q[0]))
    n = prep.NormalQuantiles(df, "v", 50)
    back = df.select("v", n.inverse(n.forward(F.col("v"))).alias("b")).collect()
    assert max(abs(r.v - r.b) for r in back) < 1e-6 * max(x)
    folds = df.select(prep.fold_of(F.col("v"), 5).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 400
    a, b = prep.split(df, "v", 0.8)
    assert a.count() + b.count() == 400 and 280 < a.count() < 360


def test_models(spark):
    rng = np.random.default_rng(5)
    data = [(f"k{i}", float(a), float(b), float(3 * a - 2 * b + 5)) for i, (a, b) in enumerate(rng.uniform(0, 1, (300, 2)))]
    df = spark.createDataFrame(data, "k string, a double, b double, y double")
    m = models.linear(["a", "b"], "y").fit(df)
    assert np.allclose(list(m.coefficients), [3, -2], atol=1e-4)
    got = metrics(m.transform(df), "y", "y_pred").first()
    assert got.r2 > 0.9999 and got.rmse < 1e-3 and got.n == 300
    cv = models.cross_validate(df, "k", ["a", "b"], "y", models.linear, folds=3)
    assert cv.count() == 3 and cv.agg(F.sum("n")).first()[0] == 300
    best, scores = models.tune(df, "k", ["a", "b"], "y", models.linear, [{"alpha": 0.0}, {"alpha": 1.0}], folds=2)
    assert best == {"alpha": 0.0} and len(scores) == 2
    assert worst(m.transform(df), 3, "y", "y_pred", "k").count() == 3
    assert models.fit_transformed(df, ["a", "b"], "y")(df).count() == 300


def test_isolation_forest_finds_the_odd_ones(spark):
    rng = np.random.default_rng(6)
    data = [(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))] + [("odd1", 9.0, 9.0), ("odd2", -9.0, 8.0), ("null", None, 0.0)]
    df = spark.createDataFrame(data, "k string, a double, b double")
    out = models.isolation_forest(df, "k", ["a", "b"], trees=50, contamination=0.01)
    assert out.count() == 503
    assert {"odd1", "odd2"} <= {r.k for r in out.where("outlier").collect()}
    assert models.isolation_forest(df.limit(0), "k", ["a", "b"]).count() == 0


def test_isolation_forest_query_scores_extreme_and_missing_prices(spark, tmp_path):
    from prumo.plans.reference_queries import QUERIES
    from prumo.schema import LISTING_SCHEMA

    names = LISTING_SCHEMA.fieldNames()
    prices = [(f"k{i:02}", 300000.0 + 1000 * i) for i in range(40)] + [("one", 1.0), ("huge", 9e9), ("none", None)]
    data = [tuple({"id": i, "scraped_at": "2025-01-01T00:00:00", "preco": p, "area_m2": 60.0, "quartos": 2, "banheiros": 1}.get(c) for c in names) for i, p in prices]
    spark.createDataFrame(data, LISTING_SCHEMA).write.parquet(str(tmp_path / "zap_dataset.parquet"))
    got = {r.chave.split("|")[0]: r.escore for r in QUERIES["l2_isolation_forest"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in prices}
    assert got["huge"] == max(got.values()) and got["none"] < got["huge"]


def test_one_hot_refuses_too_many_levels(spark):
    with pytest.raises(ValueError):
        prep.one_hot(spark.range(10_001).selectExpr("cast(id as string) AS t"), "t")
    assert (prep.one_hot(spark.createDataFrame([("b",), ("a",), (None,)], "t string"), "t").columns) == ["t_b"]


def test_tuning_query_runs_all_trials_over_all_folds(spark, monkeypatch):
    from prumo.plans import reference_queries as q

    seen = {}
    monkeypatch.setattr(q, "_priced", lambda s, d: None)
    monkeypatch.setattr(q.ml_models, "tune", lambda df, key, x, y, make, grid, folds=5: seen.update(grid=grid, folds=folds) or (grid[0], [(g, 1.0) for g in grid]))
    assert q.QUERIES["l6_tuning"](spark, "").count() == 10
    assert len(seen["grid"]) == 10 and seen["folds"] == 5


def test_fitted_steps_can_be_saved(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0, None), ("y", None, 2.0), ("x", 5.0, 4.0), (None, 9.0, 8.0)], "t string, a double, b double")
    parts = [prep.Chain([("impute_median", ["a", "b"]), ("standard_scale", ["a", "b"])]), prep.Chain([("impute_mode", ["t"]), ("one_hot", ["t"])])]
    made = prep.ColumnTransformer(parts, keep=["b"]).fit(df)
    made.save(spark, str(tmp_path / "f"))
    again = prep.Fitted.load(spark, str(tmp_path / "f"))
    want = [tuple(r) for r in made.transform(df).collect()]
    assert [tuple(r) for r in again.transform(df).collect()] == want and again.transform(df).columns == ["b", "a", "t", "t_y"]
    assert sorted(r[3] for r in want) == [0, 0, 0, 1] and abs(sum(r[1] for r in want)) < 1e-9
    points = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (9.0, 9.0)], "latitude double, longitude double")
    model = ClusterTransformer(2).fit(points)
    model.save(spark, str(tmp_path / "c"))
    same = type(model).load(spark, str(tmp_path / "c"))
    assert same.transform(points).collect() == model.transform(points).collect()
    with pytest.raises(Exception):
        model.transform(spark.createDataFrame([(None, 1.0)], "latitude double, longitude double")).collect()


def test_ridge_against_the_closed_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)) * [1.0, 50.0]
    y = x @ [4.0, -0.3] + 10 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    for alpha in (0.0, 0.1, 30.0):
        m = models.linear(["a", "b"], "y", alpha).fit(df)
        c = x - x.mean(0)
        want = np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (y - y.mean()))
        assert np.allclose(m.coefficients, want) and np.isclose(m.intercept, y.mean() - x.mean(0) @ want)
    assert m.transform(df).count() == 200
    # features that follow from others do no harm
    twice = df.withColumn("a2", F.col("a") * 2)
    assert np.allclose([r.y_pred for r in models.linear(["a", "a2", "b"], "y").fit(twice).transform(twice).collect()], [r.y_pred for r in models.linear(["a", "b"], "y").fit(df).transform(df).collect()])
