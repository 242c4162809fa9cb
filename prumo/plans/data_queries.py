"""Queries of the general data-processing problems 2, 4 and 5 over the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.functions.listing import STAND_IN_PATTERN, STAND_INS, in_condominium, is_place_name, kind
from prumo.functions.text import fold, squeeze
from prumo.operators.hotdeck import Target, hot_deck
from prumo.operators.packed import learn, learn_heads, split_packed
from prumo.operators.spatial import EARTH_M, nearby
from prumo.session import cut, table


#: What becomes of a cell that had to be filled.
OPEN = ("filled", "filled_unsorted", "no_donor")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points whose reach covers a cache row, and regions that contain it."""
    return nearby(table(spark, sf_dir, "geocoding_cache"), "place_id", table(spark, sf_dir, "pontos_referencia"), table(spark, sf_dir, "regioes"))


def filled_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes with fee, parking, bathrooms and neighbourhood filled from similar listings, each cell with its status.

    Usable: fees above 1 and below 100 000; 0 to 50 parking spaces; 1 to 50 bathrooms; a name of a neighbourhood.
    """
    raw = table(spark, sf_dir, "zap_dataset").select("id", "scraped_at", "titulo", "tipo_imovel", "url", "cidade", "condominio", "area_m2", "quartos", "banheiros", "vagas", "bairro", "rua")
    df = raw.withColumn("tipo", kind(F.col("titulo"), F.col("tipo_imovel"), F.col("url"), F.coalesce("banheiros", "vagas")))
    df = df.withColumn("com_taxa", in_condominium(F.col("tipo"), F.col("titulo"))).withColumn("lugar", is_place_name(F.col("bairro"), F.col("cidade")))
    df = df.withColumn("logradouro", F.regexp_extract(squeeze(fold("rua")), r"^([a-z .'-]{5,}|[a-z. ]+ ?[a-z]{0,2}[ -]*\d+)", 1))
    df = df.withColumn("regiao", F.when(F.col("lugar"), squeeze(fold("bairro")))).drop("titulo", "tipo_imovel", "url", "cidade", "rua")
    df = cut(df)  # read several times
    inhabited = F.col("tipo").isNull() | (F.col("tipo") != "lote")
    numbers = [
        Target("condominio", F.col("condominio").between(1.01, 99_999.0), F.col("com_taxa") & inhabited),
        Target("vagas", F.col("vagas").between(0, 50), inhabited),
        Target("banheiros", F.col("banheiros").between(1, 50), inhabited),
    ]
    key = ["id", "scraped_at"]
    df = cut(hot_deck(df, key, numbers, [[F.col("tipo"), F.col("com_taxa"), F.col("regiao")], [F.col("tipo"), F.col("com_taxa")]], F.col("area_m2")))
    place = [Target("bairro", F.col("lugar"))]
    # a record without a street has no street in common with others: its own key keeps it alone in the narrow group
    street = F.when(F.length("logradouro") > 5, F.col("logradouro")).otherwise(F.concat(F.lit("#"), F.coalesce("id", F.lit(""))))
    return hot_deck(df, key, place, [[street], [F.col("tipo")]], F.col("area_m2"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a usable value where the kind of property has one: the cells that the hot deck filled or found no donor for."""
    return p4_filled(spark, sf_dir).select("id", "scraped_at", "campo").distinct()


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell the hot deck had to fill: stored and filled value as text, distance to the donor, status."""
    df = filled_listings(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor"), F.col(f"{c}_preenchido").cast("string").alias("preenchido"), F.col(f"{c}_distancia").alias("distancia"), F.col(f"{c}_status").alias("situacao")) for c in ("condominio", "vagas", "banheiros", "bairro")))
    out = df.select("id", "scraped_at", F.explode(F.filter(cells, lambda x: x["situacao"].isin(*OPEN))).alias("c"))
    return out.select("id", "scraped_at", "c.*").distinct()


def p4_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_filled with the distance to the donor and the status only."""
    return p4_filled(spark, sf_dir).select("id", "scraped_at", "campo", F.round("distancia", 4).alias("distancia"), "situacao").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values packed in comodidades and fotos_urls, one per row with its position."""
    raw = table(spark, sf_dir, "zap_dataset").select("id", "scraped_at", "comodidades", "fotos_urls")
    return split_packed(raw.distinct(), ["id", "scraped_at"], {"comodidades": learn(raw, "comodidades"), "fotos_urls": learn_heads(raw, "fotos_urls")})


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_filled": p4_filled, "p4_donors": p4_donors, "p5_found": p5_found}

_FOLD = "lower(strip_accents({0}))"
_KIND = "CASE regexp_extract(url, '/(?:venda|aluguel|compra|lancamento)-([a-z]+)-', 1) WHEN 'apartamento' THEN 'apartamento' WHEN 'casa' THEN 'casa' WHEN 'lote' THEN 'lote' WHEN 'sala' THEN 'sala' END"
_STAND_IN = f"""(x IS NULL OR NOT regexp_matches(x, '[a-z0-9]') OR x IN ({", ".join(f"'{w}'" for w in STAND_INS)}) OR regexp_matches(x, '{STAND_IN_PATTERN}') OR regexp_replace(x, '\\s*[-/,]\\s*[a-z]{{2}}$', '') = coalesce(c, '') OR regexp_matches(x, '^goiania(\\s*[-/,]?\\s*go(ias)?)?$'))"""
_LISTED = f"""z AS (SELECT *, {_KIND} AS k, regexp_matches({_FOLD.format("titulo")}, '\\bcond(\\b|ominio)') AS em_cond, trim(regexp_replace({_FOLD.format("bairro")}, '\\s+', ' ', 'g')) AS x, trim({_FOLD.format("cidade")}) AS c, regexp_extract(trim(regexp_replace(regexp_replace({_FOLD.format("replace(replace(rua, 'º', 'o'), 'ª', 'a')")}, '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')), '^([a-z .''-]{{5,}}|[a-z. ]+ ?[a-z]{{0,2}}[ -]*\\d+)', 1) AS l FROM zap_dataset)"""


def _donors(campo: str, usable: str, applies: str, narrow: str, wide: str) -> str:
    """Distance to the nearest donor and status of each cell to fill: the donors of the narrow group, else of the wide one."""
    near = ", ".join(
        f"least(o - max(doa) OVER (PARTITION BY {g} ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(doa) OVER (PARTITION BY {g} ORDER BY o RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - o) AS d{i}, max(doa) OVER (PARTITION BY {g}) AS a{i}"
        for i, g in enumerate((narrow, wide))
    )
    return (
        f"SELECT DISTINCT id, scraped_at, '{campo}' AS campo, CASE WHEN o IS NOT NULL THEN round(CASE WHEN a0 IS NOT NULL THEN d0 ELSE d1 END, 4) END AS distancia, CASE WHEN coalesce(a0, a1) IS NULL THEN 'no_donor' WHEN o IS NULL THEN 'filled_unsorted' ELSE 'filled' END AS situacao "
        f"FROM (SELECT *, {near} FROM (SELECT *, CASE WHEN usa AND aplica THEN o END AS doa FROM (SELECT *, CASE WHEN isfinite(area_m2) THEN area_m2 END AS o, coalesce({usable}, false) AS usa, {applies} AS aplica FROM y))) WHERE aplica AND NOT usa"
    )


_HABITED = "(k IS NULL OR k <> 'lote')"
_RANGES = (("condominio", "condominio BETWEEN 1.01 AND 99999.0", f"taxa AND {_HABITED}"), ("vagas", "vagas BETWEEN 0 AND 50", _HABITED), ("banheiros", "banheiros BETWEEN 1 AND 50", _HABITED))
SQL = {
    "p4_donors": f"WITH {_LISTED}, y AS MATERIALIZED (SELECT *, coalesce(k IN ('apartamento', 'sala') OR k = 'casa' AND em_cond, true) AS taxa, NOT {_STAND_IN} AS lugar, CASE WHEN NOT {_STAND_IN} THEN x END AS regiao FROM z) "
    + " UNION ALL ".join(_donors(c, u, a, "k, taxa, regiao", "k, taxa") for c, u, a in _RANGES)
    + " UNION ALL "
    + _donors("bairro", "lugar", "true", "CASE WHEN length(l) > 5 THEN l ELSE '#' || coalesce(id, '') END", "k"),
    "p2_found": f"""WITH g AS (SELECT place_id, latitude AS lat, longitude AS lon FROM geocoding_cache WHERE isfinite(latitude) AND isfinite(longitude)),
e AS (SELECT regiao_id, latitude AS y1, longitude AS x1, coalesce(lead(latitude) OVER w, first_value(latitude) OVER w) AS y2, coalesce(lead(longitude) OVER w, first_value(longitude) OVER w) AS x2 FROM regioes WINDOW w AS (PARTITION BY regiao_id, anel ORDER BY ordem))
SELECT place_id, regiao_id AS alvo_id FROM g JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1
UNION ALL SELECT place_id, ponto_id FROM g JOIN pontos_referencia p ON 2 * {EARTH_M} * asin(least(1.0, sqrt(pow(sin((radians(p.latitude) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(p.latitude)) * pow(sin((radians(p.longitude) - radians(lon)) / 2), 2)))) <= raio_m""",
    "p4_found": f"""WITH z AS (SELECT *, {_KIND} AS k, regexp_matches({_FOLD.format("titulo")}, '\\bcond(\\b|ominio)') AS em_cond, trim(regexp_replace({_FOLD.format("bairro")}, '\\s+', ' ', 'g')) AS x, trim({_FOLD.format("cidade")}) AS c FROM zap_dataset)
SELECT DISTINCT id, scraped_at, 'condominio' AS campo FROM z WHERE k <> 'lote' AND (k <> 'casa' OR em_cond) AND NOT coalesce(condominio BETWEEN 1.01 AND 99999.0, false)
UNION ALL SELECT DISTINCT id, scraped_at, 'vagas' FROM z WHERE k <> 'lote' AND NOT coalesce(vagas BETWEEN 0 AND 50, false)
UNION ALL SELECT DISTINCT id, scraped_at, 'banheiros' FROM z WHERE k <> 'lote' AND NOT coalesce(banheiros BETWEEN 1 AND 50, false)
UNION ALL SELECT DISTINCT id, scraped_at, 'bairro' FROM z WHERE {_STAND_IN}""",
}
