"""Points in regions and near other points.

Method: every outline is cut into triangles by ear clipping; triangles and discs become boxes of a bounding-volume
hierarchy; points descend the hierarchy to the leaves whose box holds them, meet the leaf's triangles and discs there, and
are tested exactly. A point on an edge shared by two triangles counts once for their outline, and a region holds a point
that is inside an odd number of its outlines.

The hierarchy has two storeys. The upper one is broadcast and has at most MAX_LEAVES leaves, however many targets there
are. Each of its leaves is a task of its own: the leaf's targets come first and become a hierarchy below, then the points
stream through it. A leaf with more than TASK_TARGETS targets or TASK_POINTS points is dealt to several tasks, so a hot
place costs more tasks and not a longer one.

Defined results: rows without two finite coordinates match nothing; an outline of fewer than three different corners
holds nothing; repeated corners are dropped; a null or negative reach matches nothing; a disc reaches across the date
line; regions are as their corners' numbers say; a point on the border of several regions belongs to the one of them whose
id comes first; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.session import cut

EARTH_M = 6_371_000.0
#: Bound of the broadcast upper storey.
MAX_LEAVES = 4096
#: Targets of a leaf of the lower storey, and of an upper leaf while there are fewer than MAX_LEAVES.
LEAF_ITEMS, UPPER_ITEMS = 12, 500
#: Targets and points of one upper leaf that one task takes.
TASK_TARGETS, TASK_POINTS = 100_000, 200_000
#: Centres of targets from which the hierarchy's planes are chosen, at most. They only set the shape of the tree.
PLANE_SAMPLE = 200_000


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Haversine distance; null without all four coordinates."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def _area2(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


Corner = tuple[float, float]


def ear_clip(corners: list[Corner]) -> list[tuple[Corner, Corner, Corner]]:
    """Triangles of a simple closed outline (either direction, last corner joined to the first)."""
    return [t[:3] for t in clipped(corners)]


def clipped(corners: list[Corner]) -> list[tuple[Corner, Corner, Corner, int]]:
    """ear_clip(), each triangle with the bits 1, 2 and 4 for those of its edges ab, bc and ca that are the outline's own."""
    ring = [p for i, p in enumerate(corners) if p != corners[i - 1]] or []
    if len(ring) < 3:
        return []
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) < 0:
        ring.reverse()
    outer = set(zip(ring, ring[1:] + ring[:1]))
    bits = lambda a, b, c: ((a, b) in outer) + 2 * ((b, c) in outer) + 4 * ((c, a) in outer)
    out = []
    while len(ring) > 3:
        pts = np.array(ring)
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            turn = _area2(a, b, c)
            if turn < 0:
                continue
            if turn > 0:
                # an ear holds no other corner; corners equal to its own don't count
                s1 = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
                s2 = (c[0] - b[0]) * (pts[:, 1] - b[1]) - (c[1] - b[1]) * (pts[:, 0] - b[0])
                s3 = (a[0] - c[0]) * (pts[:, 1] - c[1]) - (a[1] - c[1]) * (pts[:, 0] - c[0])
                inside = (s1 >= 0) & (s2 >= 0) & (s3 >= 0)
                if any(ring[k] not in (a, b, c) for k in np.flatnonzero(inside)):
                    continue
                out.append((a, b, c, bits(a, b, c)))
            elif (a, b) in outer and (b, c) in outer:
                outer.add((a, c))
            del ring[i]  # an ear, or a corner on a straight line
            break
        else:
            raise ValueError("not a simple outline")
    if _area2(*ring) > 0:
        out.append((*ring, bits(*ring)))
    return out


def triangulate(regions: DataFrame) -> DataFrame:
    """Triangles (alvo_id, anel, bordas, ax..cy, box) of regions given as one row per corner (regiao_id, anel, ordem, latitude, longitude).

    One outline is one task's work at most; outlines are spread over the tasks.
    """

    def clip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["latitude", "longitude"]).sort_values("ordem")
        tri = clipped(list(zip(pdf.longitude, pdf.latitude)))
        return pd.DataFrame([(key[0], int(key[1]), *(v for p in t[:3] for v in p), t[3]) for t in tri], columns=["alvo_id", "anel", "ax", "ay", "bx", "by", "cx", "cy", "bordas"])

    tri = regions.select("regiao_id", "anel", "ordem", "latitude", "longitude").groupBy("regiao_id", "anel").applyInPandas(clip, "alvo_id string, anel int, ax double, ay double, bx double, by double, cx double, cy double, bordas int")
    return tri.select(
        "alvo_id", "anel", "bordas", "ax", "ay", "bx", "by", "cx", "cy", F.lit(None).cast("double").alias("raio_m"),
        *(f("ax", "bx", "cx").alias(f"{n}_x") for f, n in ((F.least, "lo"), (F.greatest, "hi"))), *(f("ay", "by", "cy").alias(f"{n}_y") for f, n in ((F.least, "lo"), (F.greatest, "hi"))),
    )


def discs(points: DataFrame) -> DataFrame:
    """Discs (ponto_id, latitude, longitude, raio_m) in the columns of triangulate(): the centre is (ax, ay).

    A disc that crosses the date line has a second box on the other side of it.
    """
    p = points.where("raio_m >= 0 AND abs(latitude) <= 90 AND abs(longitude) < double('inf')")
    dy = F.degrees(F.col("raio_m") / EARTH_M) * 1.000001 + 1e-9
    far = F.least(F.lit(90.0), F.abs("latitude") + dy)
    dx = F.when(far >= 89.9, F.lit(360.0)).otherwise(dy / F.cos(F.radians(far)))
    nil = F.lit(None).cast("double")
    lat, lon = F.col("latitude"), F.col("longitude")
    turns = F.array_compact(F.array(F.lit(0.0), F.when(lon - dx < -180, F.lit(360.0)), F.when(lon + dx > 180, F.lit(-360.0))))
    one = p.select("*", dx.alias("__dx"), dy.alias("__dy"), F.explode(turns).alias("__turn"))
    x, dx, dy = lon + F.col("__turn"), F.col("__dx"), F.col("__dy")
    return one.select(
        F.col("ponto_id").alias("alvo_id"), F.lit(0).alias("anel"), F.lit(0).alias("bordas"), x.alias("ax"), lat.alias("ay"), *(nil.alias(c) for c in ("bx", "by", "cx", "cy")), "raio_m",
        (x - dx).alias("lo_x"), (x + dx).alias("hi_x"), (lat - dy).alias("lo_y"), (lat + dy).alias("hi_y"),
    )


class Hierarchy:
    """A binary tree over boxes. planes: per inner node the axis and value that part the targets' centres; boxes: per node."""

    def __init__(self, centres: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.axis = np.zeros(2**self.depth, int)
        self.value = np.full(2**self.depth, np.inf)
        self._part(centres, 1)
        self.boxes = np.full((2 ** (self.depth + 1), 4), np.nan)

    def _part(self, c: np.ndarray, node: int) -> None:
        if node >= 2**self.depth or len(c) < 2:
            return
        k = int(np.ptp(c[:, 1]) > np.ptp(c[:, 0]))
        v = float(np.median(c[:, k]))
        self.axis[node], self.value[node] = k, v
        left = c[:, k] < v
        self._part(c[left], 2 * node)
        self._part(c[~left], 2 * node + 1)

    def leaf_of(self, centres: np.ndarray) -> np.ndarray:
        """The leaf that a target belongs to."""
        node = np.ones(len(centres), int)
        for _ in range(self.depth):
            k = self.axis[node]
            node = 2 * node + (centres[np.arange(len(centres)), k] >= self.value[node])
        return node

    def fit(self, leaf_boxes: list[tuple[int, float, float, float, float]]) -> None:
        """Set the leaves' boxes and, upwards, those of the inner nodes."""
        for leaf, *box in leaf_boxes:
            self.boxes[leaf] = box
        for n in range(2**self.depth - 1, 0, -1):
            a, b = self.boxes[2 * n], self.boxes[2 * n + 1]
            self.boxes[n] = [np.fmin(a[0], b[0]), np.fmax(a[1], b[1]), np.fmin(a[2], b[2]), np.fmax(a[3], b[3])]

    def reach(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) of the points and the leaves whose box holds them, level by level."""
        row, node = np.arange(len(x)), np.ones(len(x), int)
        for level in range(self.depth + 1):
            b = self.boxes[node]
            keep = (b[:, 0] <= x[row]) & (x[row] <= b[:, 1]) & (b[:, 2] <= y[row]) & (y[row] <= b[:, 3])
            row, node = row[keep], node[keep]
            if level < self.depth:
                row, node = np.concatenate([row, row]), np.concatenate([2 * node, 2 * node + 1])
        return row, node


class Leaf:
    """The targets of one task as a hierarchy of their own. Columns as in triangulate()."""

    def __init__(self, t: pd.DataFrame):
        self.t = {c: t[c].to_numpy() for c in ("ax", "ay", "bx", "by", "cx", "cy", "raio_m", "lo_x", "hi_x", "lo_y", "hi_y", "anel", "bordas")}
        for c in ("anel", "bordas"):
            self.t[c] = self.t[c].astype(int)
        self.ids = t["alvo_id"].to_numpy()
        lo_x, hi_x, lo_y, hi_y = (self.t[c] for c in ("lo_x", "hi_x", "lo_y", "hi_y"))
        centres = np.column_stack([(lo_x + hi_x) / 2, (lo_y + hi_y) / 2])
        self.tree = Hierarchy(centres, max(1, len(t) // LEAF_ITEMS))
        leaf = self.tree.leaf_of(centres)
        self.order = np.argsort(leaf, kind="stable")
        at, self.first, self.size = np.unique(leaf[self.order], return_index=True, return_counts=True)
        self.slot = np.full(2 ** (self.tree.depth + 1), -1)
        self.slot[at] = np.arange(len(at))
        bounds = [f.reduceat(v[self.order], self.first) for v, f in ((lo_x, np.minimum), (hi_x, np.maximum), (lo_y, np.minimum), (hi_y, np.maximum))]
        self.tree.fit(list(zip(at.tolist(), *bounds)))

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, targets and whether the row lies on the outline, of all pairs that pass the exact test."""
        row, leaf = self.tree.reach(x, y)
        slot = self.slot[leaf]
        size = self.size[slot]
        item = self.order[np.repeat(self.first[slot], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        row = np.repeat(row, size)
        px, py = x[row], y[row]
        t = {c: v[item] for c, v in self.t.items()}
        keep = (t["lo_x"] <= px) & (px <= t["hi_x"]) & (t["lo_y"] <= py) & (py <= t["hi_y"])
        row, item, px, py = row[keep], item[keep], px[keep], py[keep]
        t = {c: v[keep] for c, v in t.items()}

        def side(a: str, b: str) -> np.ndarray:
            return (t[f"{b}x"] - t[f"{a}x"]) * (py - t[f"{a}y"]) - (t[f"{b}y"] - t[f"{a}y"]) * (px - t[f"{a}x"])

        disc = ~np.isnan(t["raio_m"])
        sides = [side("a", "b"), side("b", "c"), side("c", "a")]
        la, lb = np.radians(t["ay"]), np.radians(py)
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(px - t["ax"]) / 2) ** 2
        near = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= t["raio_m"]
        good = np.where(disc, near, (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0))
        edge = ~disc & np.any([(s == 0) & (t["bordas"] & bit > 0) for s, bit in zip(sides, (1, 2, 4))], axis=0)
        return row[good], item[good], edge[good]


def locate(points: DataFrame, key: str, targets: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows (key, alvo_id): the targets (of triangulate() and discs(), unioned) that hold each point.

    Equal coordinates are tested once and joined back to their rows.
    """
    spark = points.sparkSession
    n = targets.count()
    if not n:
        return points.select(key, F.lit(None).cast("string").alias("alvo_id")).limit(0)
    share = min(1.0, PLANE_SAMPLE / n)
    seen = targets if share == 1 else targets.sample(share, seed=7)
    centres = seen.selectExpr("(lo_x + hi_x) / 2 AS x", "(lo_y + hi_y) / 2 AS y").limit(2 * PLANE_SAMPLE).toPandas().to_numpy()
    tree = Hierarchy(centres, min(MAX_LEAVES, max(1, n // UPPER_ITEMS)))
    shape = [f.name for f in targets.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [shape.index(c) for c in ("lo_x", "hi_x", "lo_y", "hi_y")]
        for b in batches:
            v = [b.column(i).to_numpy(zero_copy_only=False) for i in at]
            yield b.append_column("folha", pa.array(tree.leaf_of(np.column_stack([(v[0] + v[1]) / 2, (v[2] + v[3]) / 2])), pa.int32()))

    placed = targets.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in targets.schema) + ", folha int")
    # one row per upper leaf: at most MAX_LEAVES
    leaves = placed.groupBy("folha").agg(F.min("lo_x"), F.max("hi_x"), F.min("lo_y"), F.max("hi_y"), F.count("*")).collect()
    tree.fit([tuple(r)[:5] for r in leaves])
    shared = spark.sparkContext.broadcast(tree)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, leaf = shared.value.reach(x, y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(leaf, pa.int32())], names=["x", "y", "folha"])

    finite = points.where(f"abs(`{lat}`) < double('inf') AND abs(`{lon}`) < double('inf')").select(F.col(key).alias("__chave"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    at = cut(finite.select("x", "y").distinct().mapInArrow(descend, "x double, y double, folha int"))
    # how many tasks each upper leaf's points and targets need: again a row per leaf
    loads = dict(at.groupBy("folha").count().collect())
    shares = spark.createDataFrame([(r.folha, -(-r[5] // TASK_TARGETS), -(-loads[r.folha] // TASK_POINTS)) for r in leaves if r.folha in loads], "folha int, partes long, turmas long")
    split = F.broadcast(shares)
    dealt = placed.join(split, "folha").withColumn("parte", F.pmod(F.xxhash64("alvo_id", "anel", "ax", "ay", "bx", "by"), "partes")).withColumn("turma", F.explode(F.expr("sequence(0L, turmas - 1)")))
    asked = at.join(split, "folha").withColumn("turma", F.pmod(F.xxhash64("x", "y"), "turmas")).withColumn("parte", F.explode(F.expr("sequence(0L, partes - 1)")))
    both = dealt.select("folha", "parte", "turma", F.lit(0).alias("ordem"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), *shape)
    both = both.unionByName(asked.select("folha", "parte", "turma", F.lit(1).alias("ordem"), "x", "y"), allowMissingColumns=True)
    task = ["folha", "parte", "turma"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Targets come before the points of their task; a task's targets are TASK_TARGETS or so, its points stream."""
        held: list[pd.DataFrame] = []
        leaf, now = None, None
        for b in batches:
            pdf = b.to_pandas()
            for k, part in pdf.groupby([*task, "ordem"], sort=False):
                if k[:3] != now:
                    now, held, leaf = k[:3], [], None
                if k[3] == 0:
                    held.append(part)
                    continue
                leaf = leaf or Leaf(pd.concat(held))
                x, y = part["x"].to_numpy(), part["y"].to_numpy()
                for i in range(0, len(x), 20_000):
                    row, item, edge = leaf.hits(x[i : i + 20_000], y[i : i + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[i + row]), pa.array(y[i + row]), pa.array(leaf.ids[item], pa.string()), pa.array(leaf.t["anel"][item], pa.int32()), pa.array(np.isnan(leaf.t["raio_m"][item])), pa.array(edge)],
                        names=["x", "y", "alvo_id", "anel", "area", "borda"],
                    )

    hits = both.repartition(*task).sortWithinPartitions(*task, "ordem").mapInArrow(meet, "x double, y double, alvo_id string, anel int, area boolean, borda boolean")
    # one exchange by point serves the counts, the borders and the join
    found = hits.repartition("x", "y").groupBy("x", "y", "alvo_id", "area").agg(F.size(F.collect_set("anel")).alias("n"), F.max("borda").alias("borda")).where("NOT area OR n % 2 = 1")
    # a point on borders belongs to the first of their regions
    first = F.min(F.when(F.col("borda"), F.col("alvo_id"))).over(Window.partitionBy("x", "y"))
    found = found.withColumn("dono", first).where("NOT borda OR alvo_id = dono").select("x", "y", "alvo_id")
    return finite.join(found, ["x", "y"]).select(F.col("__chave").alias(key), "alvo_id").distinct()


def nearby(points: DataFrame, key: str, references: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Rows (key, alvo_id): reference points whose reach covers the row's point, and regions that contain it."""
    parts = [discs(references)] if references is not None else []
    parts += [triangulate(regions)] if regions is not None else []
    targets = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return locate(points, key, cut(targets))
