import math
import random

import numpy as np
import pytest
from conftest import rows

from prumo.operators.spatial import EARTH_M, ear_clip, nearby

REGION = "regiao_id string, nome string, anel int, ordem int, latitude double, longitude double"
POINT = "ponto_id string, nome string, latitude double, longitude double, raio_m double"
CACHE = "place_id string, latitude double, longitude double, alvo_id string, x double"


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def star(rng, n, cx, cy, r):
    return [(cx + r * (0.4 + rng.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.4 + rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("n", [3, 4, 7, 30])
@pytest.mark.parametrize("turn", [1, -1])
def test_ear_clip_keeps_the_area(n, turn):
    ring = star(random.Random(n), n, 0, 0, 1)[::turn]
    tri = ear_clip(ring)
    assert sum(map(area, map(list, tri))) == pytest.approx(area(ring))


def test_ear_clip_of_degenerate_outlines():
    assert ear_clip([]) == []
    assert ear_clip([(0, 0), (1, 1)]) == []
    assert ear_clip([(0, 0), (0, 0), (1, 1)]) == []
    assert sum(map(area, map(list, ear_clip([(0, 0), (1, 0), (2, 0), (2, 0), (2, 2), (0, 2)])))) == pytest.approx(4)


def brute(cache, regions, points):
    out = set()
    rings = {}
    for r in regions:
        rings.setdefault((r[0], r[2]), []).append((r[3], r[5], r[4]))
    for pid, lat, lon, *_ in cache:
        if lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)):
            continue
        odd = {}
        for (rid, _), ring in rings.items():
            ring = [c[1:] for c in sorted(ring)]
            inside = False
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    inside = not inside
            odd[rid] = odd.get(rid, False) ^ inside
        out |= {(pid, r) for r, o in odd.items() if o}
        for q, _, la, lo, rad in points:
            if None in (la, lo, rad) or rad < 0:
                continue
            a, b = math.radians(lat), math.radians(la)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lo - lon) / 2) ** 2
            if 2 * EARTH_M * math.asin(min(1, math.sqrt(h))) <= rad:
                out.add((pid, q))
    return sorted(out, key=repr)


def test_matches_brute_force_with_holes_ties_and_bad_coordinates(spark):
    rng = random.Random(3)
    regions = []
    for k in range(12):
        cx, cy = rng.uniform(0, 1), rng.uniform(0, 1)
        for anel, (n, r) in enumerate([(9, 0.25), (5, 0.08)][: 1 + k % 2], 1):
            regions += [(f"R{k}", "n", anel, i, y, x) for i, (x, y) in enumerate(star(rng, n, cx, cy, r))]
    points = [(f"P{k}", "n", rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(1000, 20000)) for k in range(40)] + [("PN", "n", None, 0.5, 100.0), ("PM", "n", 0.5, 0.5, -1.0), ("PZ", "n", 0.5, 0.5, None)]
    cache = [(f"c{k}", rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1), "own", 1.0) for k in range(400)]
    cache += [("n1", None, 0.5, None, None), ("n2", float("nan"), 0.5, None, None), ("n3", float("inf"), 0.5, None, None), (None, 0.4, 0.4, None, None), cache[0], ("twin", *cache[1][1:])]
    df = spark.createDataFrame(cache, CACHE)
    got = rows(nearby(df, "place_id", spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION)))
    assert got == brute(dict.fromkeys(cache), regions, points)


def test_empty_tables(spark):
    none = spark.createDataFrame([], CACHE)
    square = spark.createDataFrame([("R", "n", 1, i, float(y), float(x)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], REGION)
    assert nearby(none, "place_id", regions=square).count() == 0
    one = spark.createDataFrame([("a", 1.0, 1.0, None, None), ("b", 1.0, 5.0, None, None)], CACHE)
    assert rows(nearby(one, "place_id", regions=square)) == [("a", "R")]
    assert nearby(one, "place_id", regions=square.limit(0)).count() == 0
    # a shared edge inside a region counts once
    mid = spark.createDataFrame([("m", 0.5, 0.5, None, None)], CACHE)
    assert rows(nearby(mid, "place_id", regions=square)) == [("m", "R")]


def test_hierarchy_is_bounded_and_complete():
    from prumo.operators.spatial import Hierarchy

    rng = np.random.default_rng(1)
    c = rng.random((500, 2))
    t = Hierarchy(c, 64)
    leaf = t.leaf_of(c)
    boxes = [(int(k), *np.r_[c[leaf == k][:, 0].min(), c[leaf == k][:, 0].max(), c[leaf == k][:, 1].min(), c[leaf == k][:, 1].max()]) for k in set(leaf)]
    t.fit(boxes)
    row, at = t.reach(c[:, 0], c[:, 1])
    assert set(zip(range(500), leaf)) <= set(zip(row.tolist(), at.tolist()))


def test_discs_reach_across_the_date_line(spark):
    rng = random.Random(8)
    lon = lambda: rng.choice([-1, 1]) * rng.uniform(179.9, 180.0)
    points = [(f"P{k}", "n", rng.uniform(-1, 1), lon(), rng.uniform(500, 20000)) for k in range(30)] + [("pole", "n", 89.999, 0.0, 5000.0)]
    cache = [(f"c{k}", rng.uniform(-1, 1), lon(), "own", 1.0) for k in range(200)] + [("c", 0.0, -179.999, None, None), ("far", 89.99, 179.0, None, None)]
    got = rows(nearby(spark.createDataFrame(cache, CACHE), "place_id", spark.createDataFrame([*points, ("Q", "n", 0.0, 179.999, 1000.0)], POINT)))
    assert got == brute(dict.fromkeys(cache), [], [*points, ("Q", "n", 0.0, 179.999, 1000.0)])
    assert ("c", "Q") in got


def test_a_border_of_two_regions_belongs_to_the_first(spark):
    box = lambda name, a, b: [(name, "n", 1, i, float(y), float(x)) for i, (x, y) in enumerate([(a, 0), (b, 0), (b, 1), (b, 2), (a, 2)])]
    regions = spark.createDataFrame(box("B", 0, 2) + box("A", 2, 4) + box("C", 0, 4), REGION)
    at = [("edge", 1.5, 2.0, None, None), ("corner", 1.0, 2.0, None, None), ("left", 1.0, 1.0, None, None), ("out", 1.0, 0.0, None, None)]
    assert rows(nearby(spark.createDataFrame(at, CACHE), "place_id", regions=regions)) == [("corner", "A"), ("corner", "C"), ("edge", "A"), ("edge", "C"), ("left", "B"), ("left", "C"), ("out", "B")]


def test_hot_leaves_are_dealt_to_several_tasks(spark, monkeypatch):
    from prumo.operators import spatial

    rng = random.Random(4)
    points = [(f"P{k}", "n", rng.uniform(0, 0.01), rng.uniform(0, 0.01), rng.uniform(10, 300)) for k in range(300)] + [(f"S{k}", "n", 0.005, 0.005, 200.0) for k in range(100)]
    cache = [(f"c{k}", rng.uniform(0, 0.01), rng.uniform(0, 0.01), "own", 1.0) for k in range(500)]
    for name, v in (("TASK_TARGETS", 40), ("TASK_POINTS", 60), ("UPPER_ITEMS", 100)):
        monkeypatch.setattr(spatial, name, v)
    assert rows(nearby(spark.createDataFrame(cache, CACHE), "place_id", spark.createDataFrame(points, POINT))) == brute(dict.fromkeys(cache), [], points)
