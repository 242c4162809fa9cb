"""Feature transformers: bins, ratios, distances, clusters."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.functions.cast import ratio
from prumo.operators.spatial import great_circle_m

EARTH_KM = 6371.0088
#: Points of interest (fixed values).
POINTS = {
    "flamboyant_shopping": (-16.7103239, -49.2372795),
    "goiania_shopping": (-16.7079145, -49.2722946),
    "passeio_das_aguas": (-16.6301889, -49.276212),
    "setor_central": (-16.6717385, -49.2678839),
    "setor_bueno": (-16.7002167, -49.2845502),
    "setor_marista": (-16.7012624, -49.2821738),
    "jardim_goias": (-16.6983463, -49.2481699),
    "aeroporto": (-16.6288656, -49.2569422),
}
#: Parks, malls, hospitals, universities, districts and stations of the smoke run (fixed values).
SMOKE_POINTS = {
    "lago_das_rosas": (-16.6800351, -49.2739961),
    "vaca_brava": (-16.7096266, -49.2731507),
    "parque_areiao": (-16.7072239, -49.2591976),
    "parque_flamboyant": (-16.7071325, -49.2978223),
    "bosque_dos_buritis": (-16.6820805, -49.2800136),
    "flamboyant_shopping": (-16.7103239, -49.2372795),
    "goiania_shopping": (-16.7079145, -49.2722946),
    "passeio_das_aguas": (-16.6301889, -49.276212),
    "shopping_cerrado": (-16.6659975, -49.3045483),
    "buriti_shopping": (-16.7414558, -49.2772061),
    "hospital_albert_einstein": (-16.6964791, -49.2696419),
    "hospital_mater_dei": (-16.7194404, -49.2664608),
    "hospital_anis_rassi": (-16.6787898, -49.2691866),
    "hospital_jacob_facuri": (-16.6732056, -49.259802),
    "hugol": (-16.6494872, -49.3465465),
    "crer": (-16.6549245, -49.2471117),
    "hgg": (-16.6792106, -49.2709921),
    "ufg_samambaia": (-16.6062069, -49.2614624),
    "ufg_universitario": (-16.6752787, -49.2460934),
    "puc": (-16.6777968, -49.2467693),
    "ifg": (-16.666101, -49.2558974),
    "setor_central": (-16.6717385, -49.2678839),
    "setor_bueno": (-16.7002167, -49.2845502),
    "setor_marista": (-16.7012624, -49.2821738),
    "jardim_goias": (-16.6983463, -49.2481699),
    "aeroporto": (-16.6288656, -49.2569422),
    "rodoviaria": (-16.6597328, -49.2608247),
}
#: Bins of size and fee: edges, and labels of the intervals between, open to the left and closed to the right (fixed values).
BINS = {
    "area_m2": ("faixa_area", (0, 30, 70, 140, 250, float("inf")), ("muito_pequeno", "pequeno", "medio", "grande", "muito_grande")),
    "condominio": ("faixa_condominio", (0, 200, 400, 800, 1500, float("inf")), ("muito_baixo", "baixo", "medio", "alto", "muito_alto")),
}
#: Ratios: name, numerator, denominator (fixed values).
RATIOS = (
    ("m2_por_banheiro", "area_m2", "banheiros"),
    ("m2_por_quarto", "area_m2", "quartos"),
    ("banheiros_por_m2", "banheiros", "area_m2"),
    ("quartos_por_m2", "quartos", "area_m2"),
    ("banheiro_por_quarto", "banheiros", "quartos"),
    ("quarto_por_vaga", "quartos", "vagas"),
)


def binned(c: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the interval (a, b] that holds c; null outside of all and for null."""
    steps = zip(edges, edges[1:], labels)
    inside = lambda a, b: (c > a) & (F.lit(True) if b == float("inf") else c <= b)
    return reduce(lambda w, s: w.when(inside(s[0], s[1]), s[2]), steps, F.when(F.lit(False), F.lit(None).cast("string")))


def distance_km(lat: Column, lon: Column, point: tuple[float, float]) -> Column:
    """Great-circle kilometres to a point; null without coordinates."""
    return great_circle_m(lat, lon, F.lit(point[0]), F.lit(point[1]), EARTH_KM)


class _Checked(Transformer):
    """Base: the input must be a DataFrame (TypeError) with the needed columns (ValueError)."""

    needs: tuple[str, ...] = ()

    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        if not isinstance(dataset, DataFrame):
            raise TypeError(f"expected a DataFrame, got {type(dataset).__name__}")
        lacking = [c for c in self.needs if c not in dataset.columns]
        if lacking:
            raise ValueError(f"missing columns: {', '.join(lacking)}")
        return self._transform(dataset)


class BinsDiscretizer(_Checked):
    """Adds a label column per binned column; specs: column -> (name, edges, labels)."""

    def __init__(self, specs: dict[str, tuple[str, tuple, tuple]] | None = None):
        super().__init__()
        self.specs = specs or BINS
        self.needs = tuple(self.specs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: binned(F.col(c), edges, labels) for c, (name, edges, labels) in self.specs.items()})


class RatioTransformer(_Checked):
    """Adds numerator / denominator columns, null where the denominator is 0; pairs, or triples with a name in front."""

    def __init__(self, pairs=RATIOS, sep: str = "_por_"):
        super().__init__()
        self.triples = [p if len(p) == 3 else (f"{p[0]}{sep}{p[1]}", *p) for p in pairs]
        self.needs = tuple(dict.fromkeys(c for t in self.triples for c in t[1:]))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: ratio(F.col(a).cast("double"), F.col(b).cast("double")) for n, a, b in self.triples})


class GeodesicDistance(_Checked):
    """Adds distancia_{name}_km to each point."""

    def __init__(self, points: dict[str, tuple[float, float]] | None = None, lat: str = "latitude", lon: str = "longitude"):
        super().__init__()
        self.points, self.lat, self.lon = points or POINTS, lat, lon
        self.needs = (lat, lon)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"distancia_{n}_km": distance_km(F.col(self.lat), F.col(self.lon), p) for n, p in self.points.items()})


class ClusterTransformer(Estimator):
    """k-means over coordinates, fitted once; the label is text. Rows without coordinates are an error."""

    def __init__(self, k: int = 16, seed: int = 1667, columns: tuple[str, ...] = ("latitude", "longitude"), name: str = "cluster", iterations: int = 20, tolerance: float = 1e-4):
        super().__init__()
        self.k, self.seed, self.columns, self.name, self.iterations, self.tolerance = k, seed, columns, name, iterations, tolerance

    def _fit(self, df: DataFrame) -> ClusterModel:
        if not isinstance(df, DataFrame):
            raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
        lacking = [c for c in self.columns if c not in df.columns]
        if lacking:
            raise ValueError(f"missing columns: {', '.join(lacking)}")
        put = VectorAssembler(inputCols=list(self.columns), outputCol="__v", handleInvalid="error")
        means = KMeans(k=self.k, seed=self.seed, featuresCol="__v", predictionCol="__c", maxIter=self.iterations, tol=self.tolerance)
        return ClusterModel([list(map(float, c)) for c in means.fit(put.transform(df)).clusterCenters()], self.columns, self.name)

    def fit(self, dataset: DataFrame, params=None) -> ClusterModel:
        return self._fit(dataset)


class ClusterModel(Model):
    """Labels rows by the nearest centre, the first of equals; centres holds the centres by label."""

    def __init__(self, centres: Sequence[Sequence[float]], columns: Sequence[str] = ("latitude", "longitude"), name: str = "cluster"):
        super().__init__()
        self.centres, self.columns, self.name = [list(c) for c in centres], list(columns), name

    def _transform(self, df: DataFrame) -> DataFrame:
        told = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in self.columns))
        far = F.array(*(reduce(lambda a, b: a + b, (F.pow(F.col(c) - v, 2) for c, v in zip(self.columns, centre))) for centre in self.centres))
        label = (F.array_position(far, F.array_min(far)) - 1).cast("string")
        return df.withColumn(self.name, F.when(told, label).otherwise(F.raise_error(F.lit("row without coordinates")).cast("string")))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a folder, replacing what is there."""
        text = json.dumps({"centres": self.centres, "columns": self.columns, "name": self.name})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ClusterModel:
        """Read what save() wrote."""
        return ClusterModel(**json.loads(spark.read.text(path, wholetext=True).first()[0]))
