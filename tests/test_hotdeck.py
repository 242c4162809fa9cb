import random

from conftest import rows
from pyspark.sql import functions as F

from prumo.operators.hotdeck import Target, hot_deck

SCHEMA = "id string, g string, area double, v double, w string, v_status string, __extra string"


def run(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    t = [Target("v", F.col("v") > 0, F.coalesce(F.col("g"), F.lit("")) != "x"), Target("w", F.col("w").isNotNull() & (F.trim("w") != ""))]
    return hot_deck(df, ["id"], t, [[F.col("g")], [F.lit(0)]], F.col("area"), **kw)


def test_blocks_change_nothing_and_donors_are_nearest(spark):
    rng = random.Random(5)
    data = [(f"i{k}", rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), round(rng.uniform(10, 60), 1)]), rng.choice([None, -1.0, float(k), float(k)]), rng.choice([None, " ", f"t{k}"]), "old", "e") for k in range(300)]
    whole = run(spark, data)
    cut = run(spark, data, block_rows=10)
    assert list(map(repr, rows(whole))) == list(map(repr, rows(cut)))
    pos = {d[0]: None if d[2] is None or d[2] != d[2] else d[2] for d in data}
    by = {}
    for d in data:
        if d[3] is not None and d[3] > 0 and pos[d[0]] is not None:
            by.setdefault(d[1], []).append(d)
    for r in whole.collect():
        if r.v_status == "filled":
            donors = by.get(r.g) or [d for x in by.values() for d in x]
            assert abs(r.v_distancia - min(abs(pos[d[0]] - pos[r.id]) for d in donors)) < 1e-9
            assert r.v_preenchido in [d[3] for d in donors]
        elif r.v_status == "filled_unsorted":
            donors = by.get(r.g) or [d for x in by.values() for d in x]
            assert pos[r.id] is None and r.v_distancia is None and r.v_preenchido in [d[3] for d in donors]
        else:
            assert r.v_status == "observed" and r.v_preenchido == r.v and r.v_distancia is None


def test_defined_results(spark):
    got = {r.id: r for r in run(spark, [("a", "x", 1.0, None, "t", "", ""), ("b", "y", 1.0, None, None, "", ""), ("c", "y", 2.0, None, None, "", ""), ("c", "y", 2.0, None, None, "", "")]).collect()}
    assert got["a"].v_status == "not_applicable" and got["a"].v_preenchido is None
    assert got["b"].v_status == "no_donor"
    assert got["b"].w_status == "filled" and got["b"].w_preenchido == "t"
    assert run(spark, []).count() == 0
    assert "__extra" in run(spark, []).columns and run(spark, []).columns.count("v_status") == 1


def test_the_one_before_wins_a_tie(spark):
    data = [("p", "a", 10.0, 1.0, "x", "", ""), ("q", "a", 20.0, None, "x", "", ""), ("r", "a", 30.0, 3.0, "x", "", "")]
    assert {r.id: r.v_preenchido for r in run(spark, data).collect()}["q"] == 1.0


def test_a_hot_group_is_cut_into_as_many_ranges_as_its_rows_need(spark, monkeypatch):
    from prumo.operators import hotdeck

    seen = []
    made = hotdeck._carried
    monkeypatch.setattr(hotdeck, "_carried", lambda ranged, *a: seen.append([r["count"] for r in ranged.groupBy(a[1]).count().collect()]) or made(ranged, *a))
    df = spark.range(4000).selectExpr("CAST(id AS STRING) AS id", "'a' AS g", "CAST(id % 7 AS DOUBLE) AS area", "IF(id % 10 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    out = hot_deck(df, ["id"], [Target("v", F.col("v").isNotNull())], [[F.col("g")]], F.col("area"), block_rows=40)
    assert out.where("v_status = 'filled' AND v_distancia = 0").count() == 400
    assert len(seen[0]) > 64 and max(seen[0]) < 400


def test_masked_cells_are_filled_with_values_of_like_records(spark):
    rng = random.Random(9)
    data = [(f"i{k}", "a" if k % 2 else "b", a := round(rng.uniform(20, 200), 1), a * (10.0 if k % 2 else 3.0), "t", "", "") for k in range(400)]
    masked = [(*d[:3], None, *d[4:]) if k % 20 == 0 else d for k, d in enumerate(data)]
    true = {d[0]: d[3] for d in data}
    got = [r for r in run(spark, masked).collect() if r.v_status == "filled"]
    assert len(got) == 20
    assert sorted(abs(r.v_preenchido / true[r.id] - 1) for r in got)[10] < 0.02


def test_records_without_sort_key_take_a_donor_but_give_none(spark):
    data = [("n", "a", None, None, "x", "", ""), ("m", "a", float("nan"), 5.0, "x", "", ""), ("p", "a", 10.0, 1.0, "x", "", ""), ("q", "b", None, None, "x", "", ""), ("r", "b", None, 9.0, "x", "", "")]
    got = {r.id: (r.v_preenchido, r.v_distancia, r.v_status) for r in run(spark, data).collect()}
    assert got["n"] == got["q"] == (1.0, None, "filled_unsorted")
    none = {r.id: r.v_status for r in run(spark, data[:2]).collect()}
    assert none == {"n": "no_donor", "m": "observed"}
