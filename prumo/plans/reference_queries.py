"""Queries of the listing operators, each beside the SQL it must agree with where SQL can express it.

Names start with the operator's number in the inventory; those of projections and filters with sel, as p stands for the
data problems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prumo.functions.cast import clip, falsy_or, ratio, safe_float, safe_int, safe_str, timestamp_or, zero_if_missing
from prumo.functions.text import address, contains_normalized, first_word, lower_key, neighbourhood_told, normalize_text, parking_told, title_number
from prumo.ml import metrics as ml_metrics
from prumo.ml import models as ml_models
from prumo.ml import prep
from prumo.ml.features import BINS, POINTS, RATIOS, SMOKE_POINTS, BinsDiscretizer, ClusterModel, ClusterTransformer, GeodesicDistance, RatioTransformer, distance_km
from prumo.operators import clean as cl
from prumo.operators import dedup as dd
from prumo.operators import enrich as en
from prumo.operators import stats as st
from prumo.plans import model_sql as ms
from prumo.plans import pipelines as pl
from prumo.schema import LISTING_SCHEMA, UNUSED, columns_by_type, keep_existing, nan_to_null, narrow
from prumo.session import cut, scratch, table
from prumo.sources import files, pages, store
from prumo.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A fixed moment where an operator takes the present as a parameter.
NOW = "2030-01-01 00:00:00"
#: Raw listings with NaN as null, in SQL.
Z = "z AS (SELECT * REPLACE (CASE WHEN NOT isnan(preco) THEN preco END AS preco, CASE WHEN NOT isnan(condominio) THEN condominio END AS condominio, CASE WHEN NOT isnan(area_m2) THEN area_m2 END AS area_m2) FROM zap_dataset)"
#: The cache with NaN as null, in SQL.
G = "g AS (SELECT * REPLACE (CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude) FROM geocoding_cache)"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return nan_to_null(table(spark, d, "zap_dataset"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    return nan_to_null(table(spark, d, "geocoding_cache"))


def stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _on_raw(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: f(raw(spark, d))
    SQL[name] = f"WITH {Z} {sql}"


# --- sources and sinks

_PLAIN = r"replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_CSV_NULL = "CASE WHEN {0} NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN {0} END"


def _through_csv(spark: SparkSession, d: str) -> str:
    path = scratch(spark)
    files.write_csv(raw(spark, d), path)
    return path


@query("s1_csv_scan", f"WITH {Z} SELECT id, {_CSV_NULL.format('bairro')} AS bairro, preco, quartos, aceita_pets, length({_PLAIN.format(_CSV_NULL.format('descricao_completa'))}) AS n_desc FROM z")
def _(spark, d):
    df = files.scan_csv(spark, _through_csv(spark, d))
    return df.select("id", "bairro", "preco", "quartos", "aceita_pets", F.length(F.regexp_replace("descricao_completa", "\r\n?", "\n")).alias("n_desc"))


@query("s2_scan_limited", "SELECT count(*) AS n FROM (SELECT id FROM zap_dataset LIMIT 100)")
def _(spark, d):
    return raw(spark, d).limit(100).agg(F.count("*").alias("n"))


@query("s3_csv_one_column", "SELECT id, count(*) AS n FROM zap_dataset WHERE id IS NOT NULL GROUP BY id")
def _(spark, d):
    return files.scan_csv(spark, _through_csv(spark, d), columns=["id"]).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))


@query("s4_chunked_scan", "SELECT count(*) AS linhas, CAST(ceil(count(*) / 2000.0) AS BIGINT) AS lotes FROM zap_dataset")
def _(spark, d):
    return files.scan_csv(spark, _through_csv(spark, d), columns=["id"]).agg(F.count("*").alias("linhas"), F.ceil(F.count("*") / 2000.0).cast("bigint").alias("lotes"))


@query("s5_parquet_scan", f"WITH {Z} SELECT count(*) AS n, count(preco) AS n_preco, max(preco) AS max_preco, min(scraped_at) AS min_scraped FROM z")
def _(spark, d):
    return nan_to_null(files.scan_parquet(spark, f"{d}/zap_dataset.parquet")).agg(F.count("*").alias("n"), F.count("preco").alias("n_preco"), F.max("preco").alias("max_preco"), F.min("scraped_at").alias("min_scraped"))


@query("s6_parquet_columns", "SELECT bairro, count(*) AS n FROM zap_dataset GROUP BY bairro")
def _(spark, d):
    return files.scan_parquet(spark, f"{d}/zap_dataset.parquet", ["bairro"]).groupBy("bairro").agg(F.count("*").alias("n"))


@query("s7_csv_sink_overwrite", f"SELECT id, {_CSV_NULL.format('titulo')} AS titulo, count(*) AS n FROM zap_dataset GROUP BY ALL")
def _(spark, d):
    path = scratch(spark)
    for _ in range(2):
        files.write_csv(raw(spark, d).select("id", "titulo"), path)
    return files.scan_csv(spark, path, LISTING_SCHEMA[:2], one_line=True).groupBy("id", "titulo").agg(F.count("*").alias("n"))


@query("s8_csv_sink_append", f"SELECT id, {_CSV_NULL.format('titulo')} AS titulo, 2 * count(*) AS n FROM zap_dataset GROUP BY ALL")
def _(spark, d):
    path = scratch(spark)
    for _ in range(2):
        files.write_csv(raw(spark, d).select("id", "titulo"), path, append=True)
    return files.scan_csv(spark, path, LISTING_SCHEMA[:2]).groupBy("id", "titulo").agg(F.count("*").alias("n"))


@query("s9_parquet_sink", "SELECT estado, count(*) AS n FROM zap_dataset GROUP BY estado")
def _(spark, d):
    path = scratch(spark)
    files.write_parquet(raw(spark, d).select("id", "estado"), path)
    return files.scan_parquet(spark, path).groupBy("estado").agg(F.count("*").alias("n"))


@query("s10_engine_url", "SELECT pedido, CASE WHEN pedido = '' THEN 'sqlite:///data/listings.db' ELSE regexp_replace(pedido, '^postgres(ql)?://', 'postgresql+psycopg://') END AS url FROM (VALUES (''), ('postgres://u:p@h/b'), ('postgresql://h/b'), ('sqlite:///x.db')) t(pedido)")
def _(spark, d):
    return spark.createDataFrame([(u, store.engine_url(u)) for u in ("", "postgres://u:p@h/b", "postgresql://h/b", "sqlite:///x.db")], "pedido string, url string")


@query("s11_create_if_missing", "SELECT 0 AS antes, CAST((SELECT count(*) FROM listings) AS INTEGER) AS depois")
def _(spark, d):
    path = scratch(spark)
    a = store.ensure_table(spark, path).count()
    store.insert_if_absent(stored(spark, d), path)
    b = store.ensure_table(spark, path).count()
    return spark.createDataFrame([(a, b)], "antes int, depois int")


@query("s12_key_scan", "SELECT DISTINCT listing_id FROM listings")
def _(spark, d):
    return stored(spark, d).select("listing_id").distinct()


@query("s13_retry_waits", "SELECT CAST(i AS INTEGER) AS tentativa, least(45.0, 8.0 * pow(1.5, i)) AS segundos FROM range(6) r(i)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(pages.retry_waits(6))), "tentativa int, segundos double")


@query("s14_retry_waits_async", "SELECT CAST(i AS INTEGER) AS tentativa, least(30.0, 5.0 * pow(1.5, i)) AS segundos FROM range(6) r(i)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(pages.retry_waits(6, 5.0, 1.5, 30.0))), "tentativa int, segundos double")


_CATS = ", ".join(f"('{c}')" for c in pages.CATEGORIES)
_RANGES = ", ".join(f"({a}, {'NULL' if b is None else b})" for a, b in pages.PRICE_RANGES)


@query("s15_search_url", f"SELECT c || '|' || a AS chave, '{pages.BASE_URL}/venda/' || c || '/go+goiania/?pagina=2&preco-de=' || a || CASE WHEN b IS NULL THEN '' ELSE '&preco-ate=' || b END AS url FROM (VALUES {_CATS}) x(c), (VALUES {_RANGES}) y(a, b)")
def _(spark, d):
    path = F.concat(F.lit("/venda/"), F.col("categoria"), F.lit("/go+goiania/"))
    return pages.partitions(spark).select(F.concat_ws("|", "categoria", "preco_de").alias("chave"), pages.search_url(path, F.lit(2), F.col("preco_de"), F.col("preco_ate")).alias("url"))


def landed(spark: SparkSession, d: str) -> DataFrame:
    """Search pages made of the raw listings: a page each, with a heading, a bad script and an item list."""
    z = raw(spark, d)
    words = F.transform(F.split("comodidades", ", "), lambda v: F.struct(v.alias("value")))
    item = F.struct(
        F.col("id").alias("@id"), F.col("titulo").alias("name"), "url", F.concat(F.lit("http://schema.example/"), F.col("tipo_imovel")).alias("additionalType"),
        F.struct(F.col("preco").alias("price"), F.col("moeda").alias("priceCurrency"), F.struct(F.lit("Condominium Fee").alias("name"), F.col("condominio").alias("value")).alias("additionalProperty")).alias("offers"),
        F.struct(F.col("area_m2").alias("value")).alias("floorSize"), F.lit(0).alias("numberOfBedrooms"), F.col("quartos").alias("numberOfRooms"), F.col("banheiros").alias("numberOfBathroomsTotal"),
        F.struct(F.col("rua").alias("streetAddress"), F.col("cidade").alias("addressLocality"), F.col("estado").alias("addressRegion"), F.col("pais").alias("addressCountry")).alias("address"),
        F.col("aceita_pets").alias("petsAllowed"), words.alias("amenityFeature"), F.split("fotos_urls", ", ").alias("image"), F.col("descricao_completa").alias("description"),
        F.col("data_publicacao").alias("datePublished"), F.col("data_modificacao").alias("dateModified"),
    )
    data = F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.array(F.struct(item.alias("item"))).alias("itemListElement")))
    html = F.concat(F.lit("<html><h1 class='t'> <b>1.234</b> imóveis</h1><script type=\"application/ld+json\">{bad</script><script type='application/ld+json'>"), data, F.lit("</script></html>"))
    return z.select(html.alias("html"))


_S16 = f"""WITH {Z} SELECT id, coalesce(titulo, '') AS titulo, coalesce(tipo_imovel, nullif(regexp_extract(coalesce(titulo, ''), '^\\s*(\\S+)', 1), '')) AS tipo_imovel, preco, condominio, area_m2,
quartos, banheiros, TRY_CAST(regexp_extract(titulo, '(?i)(\\d+)\\s+vagas?', 1) AS INTEGER) AS vagas,
nullif(trim(regexp_extract(titulo, '(?i)em\\s+(.+?),\\s*(?:Goiânia|GO|Brasil)', 1)), '') AS bairro, rua, aceita_pets,
coalesce(array_to_string(list_filter(string_split(comodidades, ', '), lambda x: x <> ''), ', '), '') AS comodidades, coalesce(fotos_urls, '') AS fotos_urls, descricao_completa, data_modificacao FROM z"""


@query("s16_html_items", _S16)
def _(spark, d):
    df = pages.parse_items(pages.embedded_items(landed(spark, d)), F.lit(NOW))
    return df.select("id", "titulo", "tipo_imovel", "preco", "condominio", "area_m2", "quartos", "banheiros", "vagas", "bairro", "rua", "aceita_pets", "comodidades", "fotos_urls", "descricao_completa", "data_modificacao")


@query("s17_result_count", "SELECT 1234 AS total, count(*) AS n FROM zap_dataset")
def _(spark, d):
    return landed(spark, d).select(pages.result_count(F.col("html")).alias("total")).groupBy("total").agg(F.count("*").alias("n"))


def _norm(x: str) -> str:
    """normalize_text() in SQL."""
    t = f"regexp_replace(lower(strip_accents(replace(replace(replace(coalesce({x}, ''), 'º', 'o'), 'ª', 'a'), '²', '2'))), '[^\\x00-\\x7F]', '', 'g')"
    t = f"replace(replace(replace(replace(replace(replace({t}, '-', ' '), 'da', ''), 'do', ''), 'de', ''), 'das', ''), 'dos', '')"
    for a, b in (("r", "rua"), ("av", "avenida"), ("pq", "parque"), ("qd", "quadra")):
        t = f"regexp_replace({t}, '\\b{a}\\.\\s*', '{b} ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_GAZ = f"gz AS (SELECT nome, latitude, longitude, place_id FROM (SELECT {_norm('address')} AS nome, latitude, longitude, place_id, row_number() OVER (PARTITION BY {_norm('address')} ORDER BY place_id) AS r FROM g) WHERE r = 1 AND nome <> '')"
_CASCADE = f"""WITH {Z}, {G}, {_GAZ}, a AS (SELECT DISTINCT coalesce(rua, '') || ', ' || coalesce(bairro, '') AS endereco FROM z),
q AS (SELECT endereco, 0 AS ordem, trim(split_part(endereco, ',', 1)) || ', ' || trim(split_part(endereco, ',', 2)) AS nome FROM a UNION ALL SELECT endereco, 1, trim(split_part(endereco, ',', 2)) FROM a UNION ALL SELECT endereco, 2, trim(split_part(endereco, ',', 1)) FROM a),
h AS (SELECT endereco, min(ordem) AS passo, arg_min(gz.latitude, ordem) FILTER (WHERE TRUE) AS l0 FROM q JOIN gz ON gz.nome = {_norm('q.nome')} AND gz.nome <> ',' GROUP BY endereco)
SELECT a.endereco, gz2.latitude, gz2.longitude, gz2.place_id, h.passo FROM a LEFT JOIN h USING (endereco) LEFT JOIN q ON q.endereco = h.endereco AND q.ordem = h.passo LEFT JOIN gz gz2 ON gz2.nome = {_norm('q.nome')} AND h.passo IS NOT NULL"""


@query("s18_gazetteer", _CASCADE)
def _(spark, d):
    return en.cascade(en.with_address(raw(spark, d)), cache(spark, d).withColumnRenamed("address", "nome"))


_TOWN = "CASE CAST(right(place_id, 1) AS INTEGER) % 3 WHEN 0 THEN 'Goiânia' WHEN 1 THEN 'Anápolis' END"


@query("q3_city_predicate", _CASCADE.replace("FROM g) WHERE r = 1", f"FROM g WHERE coalesce({_TOWN}, '') IN ('', 'Goiânia')) WHERE r = 1"))
def _(spark, d):
    """The fallback lookup over a gazetteer that names cities, for one of them."""
    rest = F.substring("place_id", -1, 1).cast("int") % 3
    gazetteer = cache(spark, d).withColumnRenamed("address", "nome").withColumn("cidade", F.when(rest == 0, "Goiânia").when(rest == 1, "Anápolis"))
    return en.cascade(en.with_address(raw(spark, d)), gazetteer, city="Goiânia")


_BBOX = "latitude BETWEEN -16.85 AND -16.55 AND longitude BETWEEN -49.45 AND -49.15"
SQL["s19_gazetteer_bbox"] = SQL["sel5_bbox"] = f"WITH {G} SELECT place_id, latitude, longitude FROM g WHERE {_BBOX}"
QUERIES["s19_gazetteer_bbox"] = QUERIES["sel5_bbox"] = lambda spark, d: en.inside_bounds(cache(spark, d)).select("place_id", "latitude", "longitude")


@query("s20_from_records", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey <> 1 THEN n_name END AS titulo, CAST(n_regionkey AS DOUBLE) AS preco, CAST(NULL AS VARCHAR) AS rua FROM nation")
def _(spark, d):
    """The nations as records held in memory, some without a name."""
    records = [{"id": str(r.n_nationkey), "preco": float(r.n_regionkey)} | ({"titulo": r.n_name} if r.n_regionkey != 1 else {}) for r in table(spark, d, "nation").collect()]
    return files.from_records(spark, records).select("id", "titulo", "preco", "rua")


# --- projection, filter, cast

_on_raw("sel1_drop_unused", "SELECT titulo, preco, bairro, count(*) AS n FROM z GROUP BY ALL", lambda df: cl.drop_unused(df, *UNUSED).groupBy("titulo", "preco", "bairro").agg(F.count("*").alias("n")))
_on_raw("sel2_with_target", "SELECT id, scraped_at, preco FROM z WHERE preco IS NOT NULL", lambda df: cl.with_target(df).select("id", "scraped_at", "preco"))
_KIND = "CASE tipo_imovel WHEN 'House' THEN 'casa' WHEN 'Apartment' THEN 'apartamento' WHEN 'Place' THEN 'outro' END"
_on_raw("sel3_rename_kinds", f"SELECT id, scraped_at, {_KIND} AS tipo_imovel FROM z", lambda df: cl.rename_kinds(df).select("id", "scraped_at", "tipo_imovel"))
_FIRST = "nullif(regexp_extract(titulo, '^\\s*(\\S+)', 1), '')"
_TOLD = f"CASE {_FIRST} WHEN 'Casa' THEN 'casa' WHEN 'Apartamento' THEN 'apartamento' WHEN 'Flat' THEN 'flat' WHEN 'Cobertura' THEN 'cobertura' WHEN 'Sobrado' THEN 'sobrado' WHEN 'Studio' THEN 'studio' ELSE 'outro' END"
_on_raw("sel4_kind_from_title", f"SELECT id, scraped_at, CASE WHEN k = 'outro' THEN {_TOLD} ELSE k END AS tipo_imovel FROM (SELECT *, {_KIND} AS k FROM z)", lambda df: cl.kind_from_title(cl.rename_kinds(df)).select("id", "scraped_at", "tipo_imovel"))
_on_raw("sel6_to_number", "SELECT id, scraped_at, TRY_CAST(split_part(titulo, ' ', 3) AS DOUBLE) AS numero FROM z", lambda df: df.select("id", "scraped_at", safe_float(F.split_part("titulo", F.lit(" "), F.lit(3))).alias("numero")))
_on_raw("sel7_zero_if_missing", "SELECT id, scraped_at, CAST(coalesce(trunc(TRY_CAST(area_m2 AS DOUBLE)), 0) AS INTEGER) AS area FROM z", lambda df: df.select("id", "scraped_at", zero_if_missing(F.col("area_m2")).alias("area")))
SQL["sel8_safe_float"] = "SELECT id, scraped_at, CASE WHEN NOT isnan(condominio) THEN condominio END AS condominio FROM zap_dataset"
QUERIES["sel8_safe_float"] = lambda spark, d: table(spark, d, "zap_dataset").select("id", "scraped_at", safe_float(F.col("condominio")).alias("condominio"))
_on_raw("sel9_safe_int", "SELECT id, scraped_at, CAST(trunc(area_m2) AS INTEGER) AS area FROM z", lambda df: df.select("id", "scraped_at", safe_int(F.col("area_m2").cast("string")).alias("area")))
_on_raw("sel10_safe_str", "SELECT id, scraped_at, nullif(trim(bairro), '') AS bairro FROM z", lambda df: df.select("id", "scraped_at", safe_str(F.col("bairro")).alias("bairro")))
_on_raw(
    "sel11_timestamp_or_now",
    f"SELECT id, scraped_at AS s, CAST(coalesce(TRY_CAST(scraped_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', TIMESTAMP '{NOW}') AS VARCHAR) AS quando FROM z",
    lambda df: df.select("id", F.col("scraped_at").alias("s"), F.regexp_replace(F.date_format(timestamp_or(F.col("scraped_at"), F.lit(NOW).cast("timestamp")), "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("quando")),
)
SQL["sel12_nan_to_null"] = f"WITH {Z} SELECT count(*) - count(preco) AS preco, count(*) - count(condominio) AS condominio, count(*) - count(area_m2) AS area_m2 FROM z"
QUERIES["sel12_nan_to_null"] = lambda spark, d: raw(spark, d).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("preco", "condominio", "area_m2")))
_on_raw("sel13_narrow", "SELECT id, scraped_at, CAST(quartos AS BIGINT) AS quartos, CAST(vagas AS BIGINT) AS vagas FROM z", lambda df: narrow(df).select("id", "scraped_at", "quartos", "vagas"))
_on_raw("sel14_falsy_or", "SELECT id, scraped_at, CASE WHEN vagas IS NOT NULL AND vagas <> 0 THEN vagas ELSE quartos END AS v FROM z", lambda df: df.select("id", "scraped_at", falsy_or(F.col("vagas"), F.col("quartos")).alias("v")))
_on_raw("sel15_default_if_absent", "SELECT id, scraped_at, coalesce(moeda, 'BRL') AS moeda FROM z", lambda df: df.select("id", "scraped_at", F.coalesce("moeda", F.lit("BRL")).alias("moeda")))
_on_raw("sel16_fill_default", "SELECT id, scraped_at, coalesce(rua, '') AS rua, coalesce(aceita_pets, false) AS pets FROM z", lambda df: df.fillna({"rua": "", "aceita_pets": False}).select("id", "scraped_at", "rua", F.col("aceita_pets").alias("pets")))
_on_raw("sel17_zero_to_null", "SELECT id, scraped_at, nullif(vagas, 0) AS vagas FROM z", lambda df: df.select("id", "scraped_at", F.nullif("vagas", F.lit(0)).alias("vagas")))
_on_raw("sel18_told_flag", "SELECT id, scraped_at, CAST(rua IS NOT NULL AS INTEGER) AS tem FROM z", lambda df: df.select("id", "scraped_at", F.col("rua").isNotNull().cast("int").alias("tem")))
_on_raw(
    "sel19_matches_date",
    "SELECT id, scraped_at FROM z WHERE coalesce(coalesce(TRY_CAST(left(data_publicacao, 10) AS DATE), TRY_CAST(left(data_modificacao, 10) AS DATE)) = DATE '2025-03-10', false)",
    lambda df: df.where(pages.matches_date(F.col("data_publicacao"), F.col("data_modificacao"), F.lit("2025-03-10").cast("date"))).select("id", "scraped_at"),
)
_on_raw("sel20_later_copies", "SELECT id, scraped_at FROM (SELECT id, scraped_at, row_number() OVER (PARTITION BY ALL_COLS) AS r FROM z) WHERE r > 1".replace("ALL_COLS", ", ".join(LISTING_SCHEMA.names)), lambda df: dd.later_copies(df).select("id", "scraped_at"))


@query("sel21_columns_by_type", "SELECT tipo, CAST(count(*) AS INTEGER) AS n FROM (SELECT CASE WHEN column_type IN ('DOUBLE', 'INTEGER') THEN 'number' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS tipo FROM (DESCRIBE zap_dataset)) GROUP BY tipo")
def _(spark, d):
    df = raw(spark, d)
    return spark.createDataFrame([(k, len(columns_by_type(df, k))) for k in ("number", "boolean", "string")], "tipo string, n int")


_on_raw("sel22_rename_key", "SELECT id AS listing_id, scraped_at FROM z", lambda df: df.withColumnRenamed("id", "listing_id").select("listing_id", "scraped_at"))
_on_raw("sel23_first_columns", "SELECT id, titulo, tipo_imovel, url, preco, moeda FROM z", lambda df: df.select(*df.columns[:6]))
_on_raw("sel24_keep_existing", "SELECT quartos, area_m2, count(*) AS n FROM z GROUP BY ALL", lambda df: keep_existing(df, "quartos", "nada", "area_m2").groupBy("quartos", "area_m2").agg(F.count("*").alias("n")))
_on_raw("sel25_recode_labels", "SELECT id, scraped_at, CASE sign(preco - 500000) WHEN 1 THEN 'normal' WHEN -1 THEN 'outlier' END AS rotulo FROM z", lambda df: df.select("id", "scraped_at", cl.recode(F.signum(F.col("preco") - 500000).cast("int").cast("string"), {"1": "normal", "-1": "outlier"}).alias("rotulo")))
_on_raw("sel26_casts", "SELECT id, scraped_at, CAST(quartos AS DOUBLE) AS q, CAST(vagas AS VARCHAR) AS v FROM z", lambda df: df.select("id", "scraped_at", F.col("quartos").cast("double").alias("q"), F.col("vagas").cast("string").alias("v")))
_on_raw("sel27_index_reset", "SELECT count(*) AS n FROM z WHERE preco IS NOT NULL", lambda df: cl.with_target(df).agg(F.count("*").alias("n")))
_on_raw("sel28_features_and_target", "SELECT preco, area_m2, quartos FROM z WHERE preco IS NOT NULL", lambda df: cl.with_target(df).select("preco", "area_m2", "quartos"))

# --- deduplication

_on_raw("d1_drop_copies", "SELECT DISTINCT * FROM z", dd.drop_copies)
_KEY = r"trim(lower(coalesce({0}, '')))"
_on_raw("d2_lower_key", f"SELECT {_KEY.format('rua')} AS rua, count(*) AS n FROM z GROUP BY ALL", lambda df: df.groupBy(lower_key(F.col("rua")).alias("rua")).agg(F.count("*").alias("n")))
_RND = "coalesce(CAST(CAST(round_even({0}, 0) AS DECIMAL(20,0)) AS VARCHAR), 'nan')"
_SIG = (
    f"CASE WHEN {_KEY.format('rua')} <> '' AND area_m2 IS NOT NULL AND preco IS NOT NULL THEN 'RUA:' || {_KEY.format('rua')} || '|A:' || {_RND.format('area_m2')} || '|Q:' || coalesce(quartos, 0) || '|P:' || {_RND.format('preco')} "
    f"ELSE 'B:' || {_KEY.format('bairro')} || '|T:' || {_KEY.format('tipo_imovel')} || '|A:' || {_RND.format('area_m2')} || '|Q:' || coalesce(quartos, 0) || '|BNH:' || coalesce(banheiros, 0) || '|V:' || coalesce(vagas, 0) || '|P:' || {_RND.format('preco')} END"
)
_on_raw("d3_signature", f"SELECT id, scraped_at, {_SIG} AS assinatura FROM z", lambda df: df.select("id", "scraped_at", dd.signature().alias("assinatura")))
_on_raw("d4_round_half_even", "SELECT id, scraped_at, round_even(area_m2, 0) AS area, round_even(preco, 0) AS preco FROM z", lambda df: df.select("id", "scraped_at", F.bround("area_m2", 0).alias("area"), F.bround("preco", 0).alias("preco")))
_RICH = "length(coalesce(descricao_completa, '')) AS desc_len, CASE WHEN coalesce(fotos_urls, '') = '' THEN 0 ELSE length(fotos_urls) - length(replace(fotos_urls, ',', '')) + 1 END AS foto_count, CAST(bairro IS NOT NULL AS INTEGER) AS has_bairro, CAST(rua IS NOT NULL AS INTEGER) AS has_rua"
_on_raw("d5_richness", f"SELECT id, scraped_at, {_RICH} FROM z", lambda df: df.select("id", "scraped_at", *(v.alias(k) for k, v in dd.richness().items())))
_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SIG} ORDER BY has_rua DESC, has_bairro DESC, foto_count DESC, desc_len DESC, id, scraped_at) AS r FROM (SELECT *, {_RICH} FROM z)) WHERE r = 1"
_on_raw("d6_keep_best", f"SELECT id, scraped_at, titulo, preco, rua FROM ({_BEST})", lambda df: dd.keep_best(df).select("id", "scraped_at", "titulo", "preco", "rua"))
_on_raw("d7_dedup_counts", f"SELECT count(*) AS inicial, count(*) - count(DISTINCT {_SIG}) AS removidos, count(DISTINCT {_SIG}) AS unicos FROM z", dd.dedup_counts)
_FIRSTID = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(id) ORDER BY scraped_at) AS r FROM z WHERE trim(id) <> '') WHERE r = 1"
_on_raw("d8_first_per_id", f"SELECT id, scraped_at FROM ({_FIRSTID})", lambda df: dd.first_per_id(df).select("id", "scraped_at"))
SQL["d9_incremental"] = f"WITH {Z} SELECT id, scraped_at FROM ({_FIRSTID}) f WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.listing_id = trim(f.id))"
QUERIES["d9_incremental"] = lambda spark, d: dd.first_per_id(dd.only_new(raw(spark, d), stored(spark, d))).select("id", "scraped_at")
_on_raw("d10_distinct_values", "SELECT DISTINCT bairro FROM z WHERE bairro IS NOT NULL", lambda df: dd.distinct_values(df, "bairro"))
_NA = _norm("address")
_NEW = f"n AS (SELECT {_norm('coalesce(rua, ' + chr(39) * 2 + ') || ' + chr(39) + ', ' + chr(39) + ' || coalesce(bairro, ' + chr(39) * 2 + ')')} AS address, min(id) AS place_id FROM z GROUP BY 1)"
SQL["d11_cache_insert"] = f"WITH {Z}, {G}, {_NEW} SELECT address, place_id FROM n WHERE address <> '' AND NOT EXISTS (SELECT 1 FROM g WHERE {_NA} = n.address)"
QUERIES["d11_cache_insert"] = lambda spark, d: en.absent(en.with_address(raw(spark, d)).select(F.col("endereco").alias("address"), F.col("id").alias("place_id")), cache(spark, d)).select("address", "place_id")

# --- joins and set operations

SQL["j1_insert_new"] = f"WITH {Z} SELECT id, count(*) AS n FROM z WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.listing_id = trim(z.id)) GROUP BY id"
QUERIES["j1_insert_new"] = lambda spark, d: dd.only_new(raw(spark, d).where("id IS NOT NULL"), stored(spark, d)).groupBy("id").agg(F.count("*").alias("n"))
SQL["j2_known_ids"] = "SELECT DISTINCT id FROM zap_dataset WHERE id IN (SELECT listing_id FROM listings)"
QUERIES["j2_known_ids"] = lambda spark, d: dd.known_ids(raw(spark, d), stored(spark, d))
_COORD = f"c AS (SELECT n, latitude, longitude FROM (SELECT {_NA} AS n, latitude, longitude, row_number() OVER (PARTITION BY {_NA} ORDER BY place_id) AS r FROM g) WHERE r = 1 AND n <> '')"
_ADDR = "coalesce(rua, '') || ', ' || coalesce(bairro, '')"
SQL["j3_lookup"] = f"WITH {Z}, {G}, {_COORD}, a AS (SELECT *, {_ADDR} AS endereco FROM z) SELECT a.id, a.scraped_at, a.endereco, c.latitude, c.longitude FROM a LEFT JOIN c ON c.n = {_norm('a.endereco')}"
QUERIES["j3_lookup"] = lambda spark, d: en.lookup(en.with_address(raw(spark, d)), cache(spark, d)).select("id", "scraped_at", "endereco", "latitude", "longitude")
SQL["j4_cascade"], QUERIES["j4_cascade"] = SQL["s18_gazetteer"], QUERIES["s18_gazetteer"]
SQL["j5_cache_split"] = f"WITH {Z}, {G}, a AS (SELECT DISTINCT {_ADDR} AS endereco FROM z) SELECT endereco, {_norm('endereco')} IN (SELECT {_NA} FROM g) AS no_cache FROM a"
QUERIES["j5_cache_split"] = lambda spark, d: en.split_by_cache(en.with_address(raw(spark, d)), cache(spark, d))
SQL["j6_by_key"] = "SELECT l.listing_id, l.bairro, count(z.id) AS n FROM listings l LEFT JOIN zap_dataset z ON z.id = l.listing_id GROUP BY ALL"
QUERIES["j6_by_key"] = lambda spark, d: stored(spark, d).select("listing_id", "bairro").join(raw(spark, d).groupBy(F.col("id").alias("listing_id")).agg(F.count("*").alias("n")), "listing_id", "left").select("listing_id", "bairro", F.coalesce("n", F.lit(0)).alias("n"))
SQL["j7_cross_product"] = f"SELECT c AS categoria, a AS preco_de, b AS preco_ate FROM (VALUES {_CATS}) x(c), (VALUES {_RANGES}) y(a, b)"
QUERIES["j7_cross_product"] = lambda spark, d: pages.partitions(spark)
SQL["j8_set_difference"] = "SELECT DISTINCT id FROM zap_dataset EXCEPT SELECT listing_id FROM listings"
QUERIES["j8_set_difference"] = lambda spark, d: raw(spark, d).select("id").distinct().exceptAll(stored(spark, d).select("listing_id").distinct())
SQL["u1_right_wins"] = "SELECT id, titulo FROM (SELECT listing_id AS id, 'store' AS titulo FROM listings WHERE listing_id NOT IN (SELECT id FROM zap_dataset WHERE id IS NOT NULL AND vagas = 1)) UNION ALL SELECT DISTINCT id, 'raw' FROM zap_dataset WHERE id IS NOT NULL AND vagas = 1"
QUERIES["u1_right_wins"] = lambda spark, d: dd.union_right_wins(stored(spark, d).select(F.col("listing_id").alias("id"), F.lit("store").alias("titulo")), raw(spark, d).where("vagas = 1 AND id IS NOT NULL").select("id", F.lit("raw").alias("titulo")).distinct(), "id")
SQL["u2_append"] = "SELECT bairro, count(*) AS n FROM (SELECT bairro FROM zap_dataset UNION ALL SELECT bairro FROM listings) GROUP BY bairro"
QUERIES["u2_append"] = lambda spark, d: raw(spark, d).select("bairro").unionByName(stored(spark, d).select("bairro")).groupBy("bairro").agg(F.count("*").alias("n"))
SQL["u3_set_difference"], QUERIES["u3_set_difference"] = SQL["j8_set_difference"], QUERIES["j8_set_difference"]
_on_raw("u4_subset_columns", "SELECT id, scraped_at, bairro FROM z", lambda df: keep_existing(df, "id", "scraped_at", "bairro", "latitude"))

# --- aggregations

_on_raw("a1_count_distinct", "SELECT count(DISTINCT id) AS n FROM z", lambda df: df.agg(F.countDistinct("id").alias("n")))
_on_raw("a2_value_counts", "SELECT CAST(tipo_imovel AS VARCHAR) AS valor, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM z), 6) AS pct FROM z GROUP BY tipo_imovel", lambda df: st.value_counts(df, "tipo_imovel").withColumn("pct", F.round("pct", 6)))
_on_raw("a3_null_profile", " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct FROM z" for c in LISTING_SCHEMA.names), st.null_profile)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    floats = {n for n, t in df.dtypes if t == "double"}
    return df.select(*(F.round(c, digits).alias(c) if c in floats else F.col(c) for c in df.columns))


_DESC = "count({0}) AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, round(min({0}), 4) AS min, round(quantile_cont({0}, 0.25), 4) AS p25, round(quantile_cont({0}, 0.5), 4) AS p50, round(quantile_cont({0}, 0.75), 4) AS p75, round(max({0}), 4) AS max"
_GROUPS = ("tipo_imovel", "quartos", "banheiros", "vagas", "bairro")
_on_raw("a4_describe_by", " UNION ALL ".join(f"SELECT '{k}' AS chave, CAST({k} AS VARCHAR) AS valor, {_DESC.format('preco')} FROM z WHERE {k} IS NOT NULL GROUP BY {k}" for k in _GROUPS), lambda df: _rounded(st.describe_by(df, list(_GROUPS), "preco")))
_on_raw("a5_describe", f"SELECT {_DESC.format('x')} FROM (SELECT (preco - 500000) / preco AS x FROM z)", lambda df: _rounded(st.describe(df.select(((F.col("preco") - 500000) / F.col("preco")).alias("x")), "x")))
_on_raw("a6_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS coluna, CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 4) AS valor FROM z" for c in ("preco", "area_m2") for q in (0.0, 0.999)), lambda df: _rounded(st.quantiles(df, ["preco", "area_m2"], [0.0, 0.999])))
_T = {c: f"TRY_CAST(regexp_extract(titulo, '(\\d+) {u}', 1) AS DOUBLE)" for c, u in (("quartos", "quarto[s]"), ("banheiros", "banheiro[s]"), ("vagas", "vaga[s]"), ("area_m2", "m²"))}
_RIGHT = " + ".join(f"count(*) FILTER (WHERE {t} = {c})" for c, t in _T.items())
_SAID = " + ".join(f"count({t})" for t in _T.values())
_on_raw("a7_coherence", f"SELECT {_RIGHT} AS certos, {_SAID} AS informados, round(100.0 * ({_RIGHT}) / nullif({_SAID}, 0), 6) AS coherence_pct FROM z", lambda df: cl.coherence(df).withColumn("coherence_pct", F.round("coherence_pct", 6)))
SQL["a8_coverage"] = "SELECT c.categoria, coalesce(l.n, 0) AS locais, c.total AS oficiais, CASE WHEN c.total > 0 THEN round(100.0 * coalesce(l.n, 0) / c.total, 6) END AS pct FROM (VALUES ('House', 100), ('Apartment', 2000), ('Place', 0), ('Boat', 5)) c(categoria, total) LEFT JOIN (SELECT tipo_imovel, count(DISTINCT id) AS n FROM zap_dataset GROUP BY 1) l ON l.tipo_imovel = c.categoria"
QUERIES["a8_coverage"] = lambda spark, d: st.coverage(raw(spark, d), spark.createDataFrame([("House", 100), ("Apartment", 2000), ("Place", 0), ("Boat", 5)], "categoria string, total int"), "id", "tipo_imovel").withColumn("pct", F.round("pct", 6))
_on_raw("a9_mean", "SELECT round(avg(preco), 4) AS media FROM z", lambda df: df.agg(F.round(F.avg("preco"), 4).alias("media")))
_SPEAR = ("preco", "area_m2", "condominio", "quartos")


def _spear(a: str, b: str) -> str:
    r = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho FROM (SELECT {r.format(a)} AS ra, {r.format(b)} AS rb FROM z WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_PAIRS = [(a, b) for i, a in enumerate(_SPEAR) for b in _SPEAR[i + 1 :]]
_on_raw("a10_spearman", " UNION ALL ".join(_spear(a, b) for a, b in _PAIRS), lambda df: _rounded(st.spearman(df, list(_SPEAR)), 6))
_NULLS = ("preco", "condominio", "rua", "bairro")
_on_raw("a11_null_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)), 6) AS r FROM z" for i, a in enumerate(_NULLS) for b in _NULLS[i + 1 :]), lambda df: _rounded(st.null_correlation(df, list(_NULLS)), 6))
_HIST = "CASE WHEN hi = lo THEN 1 ELSE CAST(least(floor((x - lo) / (hi - lo) * {0}) + 1, {0}) AS INTEGER) END"
_on_raw("a12_histogram_by", f"SELECT grupo, {_HIST.format(50)} AS bin, count(*) AS n FROM (SELECT CAST(quartos AS VARCHAR) AS grupo, preco AS x, min(preco) OVER (PARTITION BY quartos) AS lo, max(preco) OVER (PARTITION BY quartos) AS hi FROM z WHERE preco IS NOT NULL AND quartos IS NOT NULL) GROUP BY ALL", lambda df: st.histogram(df, "preco", 50, "quartos"))
_on_raw("a12_histogram", f"SELECT {_HIST.format(100)} AS bin, count(*) AS n FROM (SELECT area_m2 AS x, min(area_m2) OVER () AS lo, max(area_m2) OVER () AS hi FROM z WHERE area_m2 IS NOT NULL) GROUP BY ALL", lambda df: st.histogram(df, "area_m2", 100))
_on_raw(
    "a13_density",
    "SELECT round(x, 4) AS x, round(densidade, 6) AS densidade FROM (SELECT x, sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS densidade FROM (SELECT lo + i * (hi - lo) / 49 AS x, n, h FROM (SELECT count(area_m2) AS n, stddev_samp(area_m2) * pow(count(area_m2), -0.2) AS h, min(area_m2) AS lo, max(area_m2) AS hi FROM z), range(50) r(i)) CROSS JOIN (SELECT area_m2 AS v FROM z WHERE area_m2 IS NOT NULL) GROUP BY x)",
    lambda df: st.density(df, "area_m2").select(F.round("x", 4).alias("x"), F.round("densidade", 6).alias("densidade")),
)
_on_raw("a14_null_patterns", "SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in _NULLS) + " AS padrao, count(*) AS n FROM z GROUP BY ALL", lambda df: st.null_patterns(df, list(_NULLS)))
_TERMS = {k: "|".join(t) for k, t in cl.AMENITIES.items()}
_FLAG = {k: f"coalesce(regexp_matches(comodidades, '{v}'), false)" for k, v in _TERMS.items()}
_on_raw("a15_any_true", f"SELECT id, scraped_at, {_FLAG['pets']} OR coalesce(aceita_pets, false) AS pets FROM z", lambda df: cl.pets_allowed(cl.amenity_flags(df)).select("id", "scraped_at", "pets"))
SQL["a16_counters"] = f"WITH {Z} SELECT (SELECT count(*) FROM z) AS processados, (SELECT count(*) FROM ({_FIRSTID}) f WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.listing_id = trim(f.id))) AS inseridos"


@query("a16_counters", SQL["a16_counters"])
def _(spark, d):
    return raw(spark, d).agg(F.count("*").alias("processados")).crossJoin(store.insertable(raw(spark, d), stored(spark, d)).agg(F.count("*").alias("inseridos")))


# --- windows, sorts, limits

_PAGES = "pg AS (SELECT user_id AS parte, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pagina, CASE WHEN event_type = 'error' AND value > 50 THEN [] ELSE [CAST(event_id AS VARCHAR)] END AS itens, event_type AS tipo FROM events)"


def _event_pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    items = F.when((F.col("event_type") == "error") & (F.col("value") > 50), F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string")))
    return table(spark, d, "events").select(F.col("user_id").alias("parte"), page.alias("pagina"), items.alias("itens"))


SQL["w1_best_of_group"], QUERIES["w1_best_of_group"] = SQL["d6_keep_best"], QUERIES["d6_keep_best"]


@query("w2_stop_page", f"WITH {_PAGES}, s AS (SELECT *, min(CASE WHEN len(itens) = 0 OR (pagina > 1 AND tipo = 'view') THEN pagina END) OVER (PARTITION BY parte) AS para FROM pg) SELECT parte, pagina FROM s WHERE (para IS NULL OR pagina < para) AND pagina <= 10")
def _(spark, d):
    known = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").cast("string").alias("id"))
    return en.pages_to_keep(_event_pages(spark, d), ["parte"], "pagina", "itens", known, 10).select("parte", "pagina")


@query("w3_page_cap", f"WITH {_PAGES}, s AS (SELECT *, min(CASE WHEN len(itens) = 0 THEN pagina END) OVER (PARTITION BY parte) AS para FROM pg) SELECT parte, count(*) AS n FROM s WHERE (para IS NULL OR pagina < para) AND pagina <= 3 GROUP BY parte")
def _(spark, d):
    return en.pages_to_keep(_event_pages(spark, d), ["parte"], "pagina", "itens", None, 3).groupBy("parte").agg(F.count("*").alias("n"))


_on_raw("w4_average_rank", "SELECT id, scraped_at, area_m2, rank() OVER (ORDER BY area_m2) + (count(*) OVER (PARTITION BY area_m2) - 1) / 2.0 AS posto FROM z WHERE area_m2 IS NOT NULL", lambda df: st.with_average_rank(df, "area_m2", "posto").select("id", "scraped_at", "area_m2", "posto"))
_on_raw("o1_multi_key_sort", "SELECT id, scraped_at, preco FROM z ORDER BY preco DESC NULLS LAST, area_m2 DESC NULLS LAST, id, scraped_at", lambda df: df.orderBy(F.desc_nulls_last("preco"), F.desc_nulls_last("area_m2"), "id", "scraped_at").select("id", "scraped_at", "preco"))
_on_raw("o2_sorted_counts", "SELECT bairro, count(*) AS n FROM z GROUP BY bairro ORDER BY n DESC, bairro NULLS FIRST", lambda df: df.groupBy("bairro").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("bairro")))
_on_raw(
    "o3_top_errors",
    "SELECT id, scraped_at, round(abs(preco - 500000), 4) AS abs_error FROM (SELECT DISTINCT * FROM z) WHERE preco IS NOT NULL ORDER BY abs(preco - 500000) DESC, id, scraped_at LIMIT 20",
    lambda df: ml_metrics.worst(df.distinct().where("preco IS NOT NULL").withColumn("p", F.lit(500000.0)), 20, "preco", "p", "id", "scraped_at").select("id", "scraped_at", F.round("abs_error", 4).alias("abs_error")),
)
_on_raw("o4_head", "SELECT count(*) AS n FROM (SELECT * FROM z LIMIT 5)", lambda df: df.limit(5).agg(F.count("*").alias("n")))

# --- text

_on_raw("f1_parking_told", "SELECT titulo, TRY_CAST(regexp_extract(titulo, '(?i)(\\d+)\\s+vagas?', 1) AS INTEGER) AS vagas FROM z", lambda df: df.select("titulo", parking_told(F.col("titulo")).alias("vagas")))
_on_raw("f2_neighbourhood_told", "SELECT titulo, nullif(trim(regexp_extract(titulo, '(?i)em\\s+(.+?),\\s*(?:Goiânia|GO|Brasil)', 1)), '') AS bairro FROM z", lambda df: df.select("titulo", neighbourhood_told(F.col("titulo")).alias("bairro")))
_on_raw("f3_kind_of_item", f"SELECT url, titulo, coalesce(nullif(split_part(split_part(url, '/imovel/', 2), '-', 2), ''), {_FIRST}) AS tipo FROM z", lambda df: df.select("url", "titulo", F.coalesce(F.nullif(F.split_part(F.split_part("url", F.lit("/imovel/"), F.lit(2)), F.lit("-"), F.lit(2)), F.lit("")), first_word(F.col("titulo"))).alias("tipo")))
_on_raw("f4_join_list", "SELECT id, scraped_at, array_to_string(list_filter([rua, bairro, cidade], lambda x: x IS NOT NULL), ', ') AS texto FROM z", lambda df: df.select("id", "scraped_at", F.array_join(F.array("rua", "bairro", "cidade"), ", ").alias("texto")))
_on_raw("f5_title_numbers", "SELECT titulo, " + ", ".join(f"{t} AS {c}" for c, t in _T.items()) + " FROM z", lambda df: df.select("titulo", *(title_number(F.col("titulo"), u).alias(c) for c, u in (("quartos", "quarto[s]"), ("banheiros", "banheiro[s]"), ("vagas", "vaga[s]"), ("area_m2", "m²")))))
_on_raw("f6_amenity_flags", "SELECT id, scraped_at, " + ", ".join(f"{v} AS {k}" for k, v in _FLAG.items()) + " FROM z", lambda df: cl.amenity_flags(df).select("id", "scraped_at", *cl.AMENITIES))
_on_raw("f6_amenity_flags_exact", "SELECT id, scraped_at, " + ", ".join(f"coalesce(list_has_any(list_transform(string_split(comodidades, ','), lambda x: trim(x, ' ')), {list(v)}), false) AS {k}" for k, v in cl.AMENITIES.items()) + " FROM z", lambda df: cl.amenity_flags(df, exact=True).select("id", "scraped_at", *cl.AMENITIES))
_on_raw("f7_first_word", f"SELECT titulo, {_FIRST} AS palavra FROM z", lambda df: df.select("titulo", first_word(F.col("titulo")).alias("palavra")))
_on_raw("f8_address", f"SELECT id, scraped_at, {_ADDR} AS endereco FROM z", lambda df: df.select("id", "scraped_at", address(F.col("rua"), F.col("bairro")).alias("endereco")))
SQL["f9_split_address"] = "SELECT address, trim(split_part(address, ',', 1)) AS rua, trim(split_part(address, ',', 2)) AS bairro FROM geocoding_cache"
QUERIES["f9_split_address"] = lambda spark, d: cache(spark, d).select("address", *(c.alias(n) for c, n in zip(en.split_address(F.col("address")), ("rua", "bairro"))))
SQL["f10_normalize_text"] = f"SELECT rua, {_norm('rua')} AS normal FROM zap_dataset UNION ALL SELECT address, {_NA} FROM geocoding_cache"
QUERIES["f10_normalize_text"] = lambda spark, d: raw(spark, d).select("rua").unionAll(cache(spark, d).select("address")).select("rua", normalize_text(F.col("rua")).alias("normal"))
SQL["f11_normalized_contains"] = f"SELECT place_id, contains({_norm('formatted_address')}, {_norm(chr(39) + 'Setor Préndesrai' + chr(39))}) AS contem FROM geocoding_cache"
QUERIES["f11_normalized_contains"] = lambda spark, d: cache(spark, d).select("place_id", contains_normalized(F.col("formatted_address"), F.lit("Setor Préndesrai")).alias("contem"))
_on_raw("f12_length", "SELECT id, scraped_at, length(descricao_completa) AS n FROM z", lambda df: df.select("id", "scraped_at", F.length("descricao_completa").alias("n")))
_on_raw("f13_dotted_number", "SELECT id, scraped_at, TRY_CAST(replace(format('{:t.}', CAST(preco AS BIGINT)), '.', '') AS INTEGER) AS numero FROM z".replace("format('{:t.}', CAST(preco AS BIGINT))", "CAST(CAST(floor(preco) AS BIGINT) AS VARCHAR)"), lambda df: df.select("id", "scraped_at", F.replace(F.translate(F.format_number(F.floor("preco"), 0), ",", "."), F.lit("."), F.lit("")).try_cast("int").alias("numero")))
_on_raw("f14_percent_text", "SELECT printf('%.2f%%', 100.0 * count(preco) / count(*)) AS texto FROM z", lambda df: df.agg(F.format_string("%.2f%%", 100.0 * F.count("preco") / F.count("*")).alias("texto")))
_on_raw("f15_slug", "SELECT url, split_part(rtrim(url, '/'), '/', -1) AS rotulo FROM z", lambda df: df.select("url", pages.slug(F.rtrim("url", F.lit("/"))).alias("rotulo")))

# --- numbers, dates, arrays


def _hav(p: tuple[float, float]) -> str:
    return f"CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians({p[0]}) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians({p[0]})) * pow(sin((radians({p[1]}) - radians(longitude)) / 2), 2)))), 6) END"


SQL["m1_haversine"] = f"WITH {G} SELECT place_id, " + ", ".join(f"{_hav(p)} AS distancia_{n}_km" for n, p in POINTS.items()) + " FROM g"
SQL["m1_smoke_points"] = f"WITH {G} SELECT place_id, " + ", ".join(f"{_hav(p)} AS distancia_{n}_km" for n, p in SMOKE_POINTS.items()) + " FROM g"
QUERIES["m1_smoke_points"] = lambda spark, d: GeodesicDistance(SMOKE_POINTS).transform(cache(spark, d)).select("place_id", *(F.round(f"distancia_{n}_km", 6).alias(f"distancia_{n}_km") for n in SMOKE_POINTS))
QUERIES["m1_haversine"] = lambda spark, d: GeodesicDistance().transform(cache(spark, d)).select("place_id", *(F.round(f"distancia_{n}_km", 6).alias(f"distancia_{n}_km") for n in POINTS))
_on_raw("m2_ratios", "SELECT id, scraped_at, " + ", ".join(f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6) AS {n}" for n, a, b in RATIOS) + " FROM z", lambda df: RatioTransformer().transform(df).select("id", "scraped_at", *(F.round(n, 6).alias(n) for n, _, _ in RATIOS)))
_on_raw("m3_price_per_m2", "SELECT id, scraped_at, round(preco / nullif(area_m2, 0), 6) AS preco_m2 FROM z", lambda df: df.select("id", "scraped_at", F.round(ratio(F.col("preco"), F.col("area_m2")), 6).alias("preco_m2")))


def _bins(c: str) -> str:
    name, edges, labels = BINS[c]
    return "CASE " + " ".join(f"WHEN {c} > {a}" + ("" if b == float("inf") else f" AND {c} <= {b}") + f" THEN '{x}'" for a, b, x in zip(edges, edges[1:], labels)) + f" END AS {name}"


_on_raw("m4_bins", f"SELECT id, scraped_at, {_bins('area_m2')}, {_bins('condominio')} FROM z", lambda df: BinsDiscretizer().transform(df).select("id", "scraped_at", "faixa_area", "faixa_condominio"))
_on_raw("m5_clip", "SELECT id, scraped_at, CASE WHEN preco IS NOT NULL THEN least(greatest(preco, 100000.0), 900000.0) END AS preco FROM z", lambda df: df.select("id", "scraped_at", clip(F.col("preco"), F.lit(100000.0), F.lit(900000.0)).alias("preco")))
_on_raw("m5_clip_to_quantiles", "SELECT id, scraped_at, round(CASE WHEN preco IS NOT NULL THEN least(greatest(preco, (SELECT quantile_cont(preco, 0.0) FROM z)), (SELECT quantile_cont(preco, 0.999) FROM z)) END, 4) AS preco FROM z", lambda df: st.clip_to_quantiles(df, ["preco"]).select("id", "scraped_at", F.round("preco", 4).alias("preco")))
_on_raw("m6_log1p", "SELECT id, scraped_at, round(ln(1 + preco), 6) AS log_preco FROM z", lambda df: prep.log1p(df, "preco").select("id", "scraped_at", F.round("preco", 6).alias("log_preco")))
_ERR = "preco AS y_true, area_m2 * 5000 AS y_pred"
_on_raw(
    "m7_errors",
    f"SELECT id, scraped_at, round(y_true - y_pred, 4) AS residual, round(abs(y_true - y_pred), 4) AS abs_error, round((y_true - y_pred) / nullif(y_true, 0), 6) AS relative_error FROM (SELECT *, {_ERR} FROM z)",
    lambda df: ml_metrics.error_frame(df.withColumns({"y_true": F.col("preco"), "y_pred": F.col("area_m2") * 5000})).select("id", "scraped_at", F.round("residual", 4).alias("residual"), F.round("abs_error", 4).alias("abs_error"), F.round("relative_error", 6).alias("relative_error")),
)
_on_raw("m8_round_half_even", "SELECT id, scraped_at, round_even(area_m2 / 4, 0) AS r FROM z", lambda df: df.select("id", "scraped_at", F.bround(F.col("area_m2") / 4, 0).alias("r")))
_on_raw("m9_date_prefix", "SELECT id, scraped_at, CAST(TRY_CAST(left(data_modificacao, 10) AS DATE) AS VARCHAR) AS dia FROM z", lambda df: df.select("id", "scraped_at", F.left("data_modificacao", F.lit(10)).try_cast("date").cast("string").alias("dia")))
_on_raw("m10_now_parameter", f"SELECT count(*) AS n, '{NOW}' AS agora FROM z", lambda df: df.agg(F.count("*").alias("n")).withColumn("agora", F.date_format(F.lit(NOW).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")))
_on_raw("m11_date_stamp", "SELECT DISTINCT 'zap_dataset_' || replace(left(scraped_at, 10), '-', '') || '.csv' AS arquivo FROM z", lambda df: df.select(F.concat(F.lit("zap_dataset_"), F.replace(F.left("scraped_at", F.lit(10)), F.lit("-"), F.lit("")), F.lit(".csv")).alias("arquivo")).distinct())
SQL["m12_json_parse"] = SQL["m13_json_field"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
QUERIES["m12_json_parse"] = lambda spark, d: table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
QUERIES["m13_json_field"] = lambda spark, d: table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
_on_raw("m14_filter_map", "SELECT id, scraped_at, array_to_string(list_transform(list_filter(string_split(comodidades, ','), lambda x: trim(x, ' ') <> ''), lambda x: upper(trim(x, ' '))), '|') AS itens FROM z WHERE comodidades IS NOT NULL", lambda df: df.where("comodidades IS NOT NULL").select("id", "scraped_at", F.array_join(F.transform(F.filter(F.split("comodidades", ","), lambda x: F.trim(x) != ""), lambda x: F.upper(F.trim(x))), "|").alias("itens")))


@query("m15_split_and_folds", f"WITH {Z} SELECT DISTINCT id, CASE WHEN {ms.unit('id', 1667, 9)} / 4294967296.0 < 0.8 THEN 'treino' ELSE 'teste' END AS parte, CAST({ms.unit('id', 1667)} % 5 AS INTEGER) AS fold FROM z")
def _(spark, d):
    a, b = prep.split(raw(spark, d), "id", 0.8)
    return a.select("id", F.lit("treino").alias("parte")).unionByName(b.select("id", F.lit("teste").alias("parte"))).withColumn("fold", prep.fold_of(F.col("id"), 5)).distinct()


# --- preprocessing estimators

_on_raw("e1_impute_median", "SELECT id, scraped_at, coalesce(area_m2, (SELECT quantile_cont(area_m2, 0.5) FROM z)) AS area_m2 FROM z", lambda df: prep.impute_median(df, ["area_m2"]).transform(df).select("id", "scraped_at", "area_m2"))
_on_raw("e2_impute_mode", "SELECT id, scraped_at, coalesce(vagas, (SELECT vagas FROM z WHERE vagas IS NOT NULL GROUP BY vagas ORDER BY count(*) DESC, vagas LIMIT 1)) AS vagas FROM z", lambda df: prep.impute_mode(df, ["vagas"]).transform(df).select("id", "scraped_at", "vagas"))
_on_raw("e3_standard_scale", "SELECT id, scraped_at, round((preco - (SELECT avg(preco) FROM z)) / (SELECT stddev_pop(preco) FROM z), 6) AS preco FROM z", lambda df: prep.standard_scale(df, ["preco"]).transform(df).select("id", "scraped_at", F.round("preco", 6).alias("preco")))
_on_raw("e4_robust_scale", "SELECT id, scraped_at, round((preco - (SELECT quantile_cont(preco, 0.5) FROM z)) / (SELECT quantile_cont(preco, 0.75) - quantile_cont(preco, 0.25) FROM z), 6) AS preco FROM z", lambda df: prep.robust_scale(df, ["preco"]).transform(df).select("id", "scraped_at", F.round("preco", 6).alias("preco")))
_on_raw("e5_winsorize", "SELECT id, scraped_at, round(CASE WHEN area_m2 IS NOT NULL THEN least(area_m2, (SELECT quantile_cont(area_m2, 0.99) FROM z)) END, 4) AS area_m2 FROM z", lambda df: prep.winsorize(df, ["area_m2"]).transform(df).select("id", "scraped_at", F.round("area_m2", 4).alias("area_m2")))


def _yj(x: str) -> str:
    up = f"CASE WHEN abs(g) < 1e-9 THEN ln(1 + {x}) ELSE (pow({x} + 1, g) - 1) / g END"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE CASE WHEN abs(g - 2) < 1e-9 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - g) - 1) / (2 - g) END END"


_BC = "CASE WHEN abs(g) < 1e-9 THEN ln({0}) ELSE (pow({0}, g) - 1) / g END"


@query("e6_yeo_johnson", f"WITH {Z}, {ms.best_lambda('z', 'area_m2', _yj('area_m2'), 'sign(area_m2) * ln(1 + abs(area_m2))')} SELECT id, scraped_at, round({_yj('area_m2')}, 6) AS area_m2 FROM z, lam")
def _(spark, d):
    df = raw(spark, d)
    return prep.fit_yeo_johnson(df, ["area_m2"])[0].transform(df).select("id", "scraped_at", F.round("area_m2", 6).alias("area_m2"))


@query("e7_box_cox", f"WITH {Z}, c AS (SELECT * FROM z WHERE preco > 0), {ms.best_lambda('c', 'preco', _BC.format('preco'), 'ln(preco)')} SELECT id, scraped_at, round(CASE WHEN preco > 0 THEN {_BC.format('preco')} END, 6) AS preco FROM z, lam")
def _(spark, d):
    df = raw(spark, d)
    return prep.fit_box_cox(df, ["preco"])[0].transform(df).select("id", "scraped_at", F.round("preco", 6).alias("preco"))


@query("e8_normal_quantiles", f"WITH {Z}, c AS (SELECT id, scraped_at, preco FROM z WHERE preco IS NOT NULL), {ms.knots('c', 'preco')} SELECT id, scraped_at, preco, round(z, 6) AS z, round(preco, 2) AS volta FROM ({ms.interpolated('c', 'preco', 'v', 's', 'z', 'id, scraped_at, preco')})")
def _(spark, d):
    df = raw(spark, d).where("preco IS NOT NULL")
    q = prep.NormalQuantiles(df, "preco")
    z = q.forward(F.col("preco"))
    return df.select("id", "scraped_at", "preco", F.round(z, 6).alias("z"), F.round(q.inverse(z), 2).alias("volta"))


_KINDS4 = ("Apartment", "House", "Place")
_on_raw("e9_one_hot", "SELECT id, scraped_at, " + ", ".join(f"CAST(coalesce(t = '{k}', false) AS INTEGER) AS t_{k}" for k in _KINDS4[1:]) + f" FROM (SELECT *, CASE WHEN tipo_imovel IN {_KINDS4} THEN tipo_imovel END AS t FROM z)", lambda df: (lambda x: prep.one_hot(x, "t").transform(x))(df.withColumn("t", F.when(F.col("tipo_imovel").isin(*_KINDS4), F.col("tipo_imovel")))).select("id", "scraped_at", *(f"t_{k}" for k in _KINDS4[1:])))
_on_raw("e10_ordinal", "SELECT id, scraped_at, tipo_imovel, CASE WHEN tipo_imovel IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY tipo_imovel NULLS LAST) - 1 AS INTEGER) END AS ordem FROM z", lambda df: prep.ordinal(df, "tipo_imovel", "ordem").select("id", "scraped_at", "tipo_imovel", "ordem"))
_on_raw("e11_polynomial", "SELECT id, scraped_at, round(area_m2 * area_m2, 4) AS a, round(area_m2 * quartos, 4) AS b, CAST(quartos * quartos AS DOUBLE) AS c FROM z", lambda df: prep.polynomial(df, ["area_m2", "quartos"]).select("id", "scraped_at", F.round("area_m2_x_area_m2", 4).alias("a"), F.round("area_m2_x_quartos", 4).alias("b"), F.col("quartos_x_quartos").alias("c")))


_E12 = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM c)) AS {c}" for c in ("area_m2", "quartos"))
_E12R = ", ".join(f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM f)) / (SELECT coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) FROM f), 6) AS {c}" for c in ("area_m2", "quartos"))


@query("e12_column_transformer", f"WITH {Z}, c AS (SELECT * FROM z WHERE preco IS NOT NULL), f AS (SELECT id, scraped_at, tipo_imovel, {_E12} FROM c) SELECT id, scraped_at, {_E12R}, CAST(coalesce({_KIND} = 'casa', false) AS INTEGER) AS tipo_imovel_casa, CAST(coalesce({_KIND} = 'outro', false) AS INTEGER) AS tipo_imovel_outro FROM f")
def _(spark, d):
    df = cl.rename_kinds(cl.with_target(raw(spark, d)))
    numbers = prep.Chain([("impute_median", ["area_m2", "quartos"]), ("robust_scale", ["area_m2", "quartos"])])
    made = prep.ColumnTransformer([numbers, prep.Chain([("one_hot", ["tipo_imovel"])])], keep=["id", "scraped_at"]).fit(df)
    path = scratch(spark)
    made.save(spark, path)
    out = prep.Fitted.load(spark, path).transform(df)
    return out.select("id", "scraped_at", *(F.round(c, 6).alias(c) for c in ("area_m2", "quartos")), "tipo_imovel_casa", "tipo_imovel_outro")


@query("e13_stateless_transformers", f"WITH {Z} SELECT id, scraped_at, {_bins('area_m2')}, round(CAST(area_m2 AS DOUBLE) / nullif(CAST(quartos AS DOUBLE), 0), 6) AS area_m2_por_quartos FROM z")
def _(spark, d):
    df = RatioTransformer([("area_m2", "quartos")]).transform(BinsDiscretizer({"area_m2": BINS["area_m2"]}).transform(raw(spark, d)))
    return df.select("id", "scraped_at", "faixa_area", F.round("area_m2_por_quartos", 6).alias("area_m2_por_quartos"))


def _located(spark: SparkSession, d: str) -> DataFrame:
    return en.inside_bounds(cache(spark, d)).select("place_id", "latitude", "longitude")


@query("e14_cluster_transformer")
def _(spark, d):
    df = _located(spark, d)
    return ClusterTransformer(k=8).fit(df).transform(df)


#: Centres for the labelling step alone.
_CENTRES = ((-16.60, -49.20), (-16.65, -49.25), (-16.70, -49.30), (-16.75, -49.35))
_NEAR = ", ".join(f"pow(latitude - ({a}), 2) + pow(longitude - ({b}), 2)" for a, b in _CENTRES)


@query("e14_labels_of_centres", f"WITH {G} SELECT place_id, CAST(list_position([{_NEAR}], least({_NEAR})) - 1 AS VARCHAR) AS cluster FROM g WHERE {_BBOX}")
def _(spark, d):
    df = _located(spark, d)
    return ClusterModel(_CENTRES).transform(df).select("place_id", "cluster")


# --- models and metrics


def _priced(spark: SparkSession, d: str) -> DataFrame:
    df = raw(spark, d).where("preco BETWEEN 20000 AND 20000000")
    return prep.impute_median(df, ["area_m2", "quartos", "banheiros"]).transform(df).select("id", "scraped_at", "preco", "area_m2", "quartos", "banheiros").distinct()


_FEATURES = ["area_m2", "quartos", "banheiros"]


@query("l1_kmeans")
def _(spark, d):
    df = _located(spark, d)
    return ClusterTransformer().fit(df).transform(df).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))


@query("l1_fixpoint", f"WITH {G} SELECT count(*) AS n, 0 AS longe, true AS medias FROM g WHERE {_BBOX}")
def _(spark, d):
    """Of the fitted clusters: rows, those nearer to another centre than their own, and whether all centres are their rows' means."""
    df = _located(spark, d)
    model = ClusterTransformer(k=4, iterations=200, tolerance=1e-9).fit(df)
    far = [F.pow(F.col("latitude") - a, 2) + F.pow(F.col("longitude") - b, 2) for a, b in model.centres]
    own = F.element_at(F.array(*far), F.col("cluster").cast("int") + 1)
    out = cut(model.transform(df))
    means = out.groupBy("cluster").agg(F.avg("latitude").alias("a"), F.avg("longitude").alias("b"))
    at = F.element_at(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in model.centres)), F.col("cluster").cast("int") + 1)
    still = means.agg(F.coalesce(F.max(F.abs(F.col("a") - at[0]) + F.abs(F.col("b") - at[1])) < 1e-5, F.lit(True)).alias("medias"))
    return out.agg(F.count("*").alias("n"), F.count_if(own > F.least(*far) + 1e-12).cast("int").alias("longe")).crossJoin(F.broadcast(still))


@query("l2_isolation_forest")
def _(spark, d):
    df = raw(spark, d).select("id", "scraped_at", "preco", *_FEATURES).distinct()
    return ml_models.isolation_forest(df.withColumn("chave", F.concat_ws("|", "id", "scraped_at")), "chave", ["preco", *_FEATURES])


_P = ms.priced(Z)
_PZ = ms.interpolated("p", "preco", "v", "s", "y", "id, scraped_at, preco, area_m2, quartos, banheiros")


@query("l3_linear_regression", f"WITH {_P}, {ms.knots('p', 'preco')}, t AS MATERIALIZED ({_PZ}), o AS ({ms.least_squares('t', 'y')}), r AS MATERIALIZED (SELECT t.*, {ms.predicted()} AS zp FROM t, o) SELECT id, scraped_at, preco, round(y_pred, 0) AS y_pred FROM ({ms.interpolated('r', 'zp', 's', 'v', 'y_pred', 'id, scraped_at, preco')})")
def _(spark, d):
    df = _priced(spark, d)
    return ml_models.fit_transformed(df, _FEATURES, "preco")(df).select("id", "scraped_at", "preco", F.round("y_pred", 0).alias("y_pred"))


@query("l3_simple_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS inclinacao, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercepto FROM lineitem")
def _(spark, d):
    m = ml_models.linear(["l_quantity"], "l_extendedprice").fit(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"))
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3), round(float(m.intercept), 2))], "inclinacao double, intercepto double")


@query("l4_ridge", f"WITH {_P}, o AS ({ms.least_squares('p', 'preco', '0.1 / (SELECT count(*) FROM p)')}) SELECT id, scraped_at, preco, round({ms.predicted()}, 1) AS y_pred FROM p, o")
def _(spark, d):
    df = _priced(spark, d)
    return ml_models.linear(_FEATURES, "preco", 0.1).fit(df).transform(df).select("id", "scraped_at", "preco", F.round("y_pred", 1).alias("y_pred"))


@query("l5_boosted_trees")
def _(spark, d):
    df = _priced(spark, d)
    return ml_models.boosted(_FEATURES, "preco", maxIter=5, maxDepth=4).fit(df).transform(df).select("id", "scraped_at", "preco", "y_pred")


#: Penalties searched, drawn once on a logarithmic scale.
_GRID = ml_models.random_grid({"alpha": (1e-4, 1.0)}, 10, log=True)
_FOLDED = f"f AS MATERIALIZED (SELECT *, CAST({ms.unit('id', 1667)} % 5 AS INTEGER) AS fold FROM p)"
_TRAIN = "(SELECT f.*, v.fold AS vez{0} FROM f, (SELECT unnest(range(5)) AS fold) v{1} WHERE f.fold <> v.fold)"
_ALPHAS = ", ".join(f"(CAST({g['alpha']!r} AS DOUBLE))" for g in _GRID)
_L6 = ms.least_squares(_TRAIN.format(", alfa", f", (VALUES {_ALPHAS}) g(alfa)"), "preco", "any_value(alfa) / count(*)", "vez, alfa")


@query("l6_tuning", f"WITH {_P}, {_FOLDED}, o AS MATERIALIZED ({_L6}), s AS (SELECT alfa, avg(mae) AS mae FROM (SELECT alfa, fold, avg(abs(preco - ({ms.predicted()}))) AS mae FROM f JOIN o ON o.vez = f.fold GROUP BY alfa, fold) GROUP BY alfa) SELECT alfa AS alpha, round(mae, 2) AS mae, round(mae, 2) = round((SELECT min(mae) FROM s), 2) AS melhor FROM s")
def _(spark, d):
    best, scores = ml_models.tune(_priced(spark, d), "id", _FEATURES, "preco", ml_models.linear, _GRID)
    low = round(min(s for _, s in scores), 2)
    return spark.createDataFrame([(g["alpha"], round(float(s), 2), round(float(s), 2) == low) for g, s in scores], "alpha double, mae double, melhor boolean")


_L7 = f"SELECT f.*, {ms.predicted()} AS y_pred FROM f JOIN o ON o.vez = f.fold"


@query("l7_cross_validation", f"WITH {_P}, {_FOLDED}, o AS MATERIALIZED ({ms.least_squares(_TRAIN.format('', ''), 'preco', '0', 'vez')}) SELECT fold, count(*) AS n, round(1 - sum((preco - y_pred) * (preco - y_pred)) / (var_pop(preco) * count(*)), 6) AS r2, round(sqrt(avg((preco - y_pred) * (preco - y_pred))), 2) AS rmse, round(avg(abs(preco - y_pred)), 2) AS mae, round(quantile_cont(abs(preco - y_pred), 0.5), 2) AS medae, round(avg(abs(preco - y_pred) / preco), 6) AS mape FROM ({_L7}) GROUP BY fold")
def _(spark, d):
    cv = ml_models.cross_validate(_priced(spark, d), "id", _FEATURES, "preco", ml_models.linear)
    return cv.select("fold", "n", *(F.round(c, 2 if c in ("rmse", "mae", "medae") else 6).alias(c) for c in ("r2", "rmse", "mae", "medae", "mape")))


_on_raw(
    "l8_holdout_metrics",
    "SELECT count(*) AS n, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 3) AS rmse, round(avg(abs(y_true - y_pred)), 3) AS mae, round(quantile_cont(abs(y_true - y_pred), 0.5), 3) AS medae, round(avg(abs(y_true - y_pred) / abs(nullif(y_true, 0))), 6) AS mape "
    f"FROM (SELECT {_ERR} FROM z) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL",
    lambda df: ml_metrics.metrics(df.select(F.col("preco").alias("y_true"), (F.col("area_m2") * 5000).alias("y_pred"))).select("n", F.round("r2", 6).alias("r2"), *(F.round(c, 3).alias(c) for c in ("rmse", "mae", "medae")), F.round("mape", 6).alias("mape")),
)
SQL["l9_error_frame"], QUERIES["l9_error_frame"] = SQL["m7_errors"], QUERIES["m7_errors"]
_on_raw("l10_plot_data", f"SELECT {_HIST.format(50)} AS bin, count(*) AS n FROM (SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM (SELECT preco - area_m2 * 5000 AS x FROM z) WHERE x IS NOT NULL) GROUP BY ALL", lambda df: st.histogram(df.select((F.col("preco") - F.col("area_m2") * 5000).alias("x")), "x", 50))


@query("l11_single_prediction", f"WITH {_P}, o AS ({ms.least_squares('p', 'preco')}) SELECT 80.0::DOUBLE AS area_m2, 3.0::DOUBLE AS quartos, 2.0::DOUBLE AS banheiros, round(a + 80 * b1 + 3 * b2 + 2 * b3, 2) AS y_pred, round(b1, 3) AS b1, round(b2, 3) AS b2, round(b3, 3) AS b3 FROM o")
def _(spark, d):
    m = ml_models.linear(_FEATURES, "preco").fit(_priced(spark, d))
    row = spark.createDataFrame([(80.0, 3.0, 2.0)], "area_m2 double, quartos double, banheiros double")
    coefs = {f"b{i + 1}": F.lit(round(float(c), 3)) for i, c in enumerate(m.coefficients)}
    return m.transform(row).select(*_FEATURES, F.round("y_pred", 2).alias("y_pred")).withColumns(coefs)


# --- composite pipelines

_CLEAN = f"SELECT titulo, {_KIND} AS tipo_imovel, preco, condominio, area_m2, CAST(quartos AS BIGINT) AS quartos, CAST(banheiros AS BIGINT) AS banheiros, CAST(vagas AS BIGINT) AS vagas, bairro, rua, aceita_pets, comodidades, data_publicacao, data_modificacao, scraped_at FROM (SELECT DISTINCT * FROM z) WHERE preco IS NOT NULL"
_on_raw("c1_clean", _CLEAN, cl.clean)
_EXTRACT = f"SELECT preco, area_m2, bairro, rua, scraped_at, {_FLAG['piscina']} AS piscina, {_FLAG['pets']} OR coalesce(aceita_pets, false) AS pets, CASE WHEN tipo_imovel = 'outro' THEN {_TOLD} ELSE tipo_imovel END AS tipo_imovel FROM ({_CLEAN})"
_on_raw("c2_extract", _EXTRACT, lambda df: cl.extract(cl.clean(df)).select("preco", "area_m2", "bairro", "rua", "scraped_at", "piscina", "pets", "tipo_imovel"))
_ENRICH = f"SELECT e.preco, e.area_m2, e.scraped_at, e.tipo_imovel, c.latitude, c.longitude FROM ({_EXTRACT}) e JOIN c ON c.n = {_norm(_ADDR)} WHERE {_BBOX}"
SQL["c3_enrich"] = f"WITH {Z}, {G}, {_COORD} {_ENRICH}"
QUERIES["c3_enrich"] = lambda spark, d: pl.preprocess(raw(spark, d), cache(spark, d)).select("preco", "area_m2", "scraped_at", "tipo_imovel", "latitude", "longitude")
SQL["c4_daily"] = f"WITH {Z}, f AS (SELECT * EXCLUDE (r) FROM ({_FIRSTID}) f WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.listing_id = trim(f.id))), b AS ({_BEST.replace('FROM z', 'FROM f')}) SELECT trim(id) AS listing_id, nullif(trim(titulo), '') AS titulo, preco FROM b"
QUERIES["c4_daily"] = lambda spark, d: pl.daily(raw(spark, d), stored(spark, d)).select("listing_id", "titulo", "preco")


@query("c5_bulk_load", f"WITH {Z} SELECT count(*) AS inseridos, 0 AS de_novo FROM ({_FIRSTID})")
def _(spark, d):
    path = scratch(spark)
    a, b = (pl.bulk_load(raw(spark, d), path) for _ in range(2))
    return spark.createDataFrame([(a, b)], "inseridos bigint, de_novo int")


SQL["c6_with_distances"] = f"WITH {Z}, {G}, {_COORD}, e AS ({_ENRICH}) SELECT preco, scraped_at, {_hav(POINTS['aeroporto'])} AS distancia_aeroporto_km FROM e"
QUERIES["c6_with_distances"] = lambda spark, d: pl.with_distances(raw(spark, d), cache(spark, d)).select("preco", "scraped_at", F.round("distancia_aeroporto_km", 6).alias("distancia_aeroporto_km"))


SQL["c7_features_alone"] = f"WITH {Z}, {G}, {_COORD}, e AS (SELECT e.*, c.latitude, c.longitude FROM ({_CLEAN}) e JOIN c ON c.n = {_norm(_ADDR)} WHERE {_BBOX}) SELECT preco, scraped_at, {_bins('area_m2')}, round(area_m2 / nullif(CAST(quartos AS DOUBLE), 0), 6) AS m2_por_quarto, {_hav(POINTS['aeroporto'])} AS distancia_aeroporto_km FROM e"
QUERIES["c7_features_alone"] = lambda spark, d: pl.features(pl.preprocess(raw(spark, d), cache(spark, d))).select("preco", "scraped_at", "faixa_area", F.round("m2_por_quarto", 6).alias("m2_por_quarto"), F.round("distancia_aeroporto_km", 6).alias("distancia_aeroporto_km"))


@query("c7_features")
def _(spark, d):
    return pl.clustered(cut(pl.preprocess(raw(spark, d), cache(spark, d)))).select("preco", "scraped_at", "faixa_area", "m2_por_quarto", "distancia_aeroporto_km", "cluster")


# --- streams (each run over all that has landed; the result equals the batch result)


def _stream_ids(spark: SparkSession, d: str) -> str:
    """Ids of the listings landed as files."""
    path = scratch(spark)
    raw(spark, d).select("id", F.col("scraped_at").try_cast("timestamp").alias("quando"), "bairro").write.parquet(path)
    return path


@query("st1_first_seen", "SELECT DISTINCT trim(id) AS id FROM zap_dataset WHERE trim(id) <> ''")
def _(spark, d):
    out, check = scratch(spark), scratch(spark)
    stream = ingest.first_seen(ingest.read_listings(spark, _stream_ids(spark, d), spark.createDataFrame([], "id string, quando timestamp, bairro string").schema))
    stream.select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string").parquet(out)


@query("st2_insert_if_absent", f"WITH {Z} SELECT DISTINCT trim(id) AS listing_id FROM z WHERE trim(id) <> ''")
def _(spark, d):
    src, out, check = scratch(spark), scratch(spark), scratch(spark)
    raw(spark, d).write.parquet(src)
    ingest.append_new(ingest.read_listings(spark, src, LISTING_SCHEMA, files_per_batch=2), out, check).awaitTermination()
    return spark.read.parquet(out).select("listing_id")


@query("st3_window_counts", "SELECT CAST(epoch(time_bucket(INTERVAL '30 days', ts::TIMESTAMP, TIMESTAMP '1970-01-01')) AS BIGINT) AS inicio, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    src, out, check = scratch(spark), scratch(spark), scratch(spark)
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(src)
    stream = ingest.counts_by_window(ingest.read_listings(spark, src, events.schema), "ts", "event_type", "30 days", "3650 days")
    rows = stream.select(F.unix_timestamp("janela.start").alias("inicio"), "event_type", "n")
    q = rows.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("inicio bigint, event_type string, n bigint").parquet(out)


@query("q9_price_gaps", f"SELECT b AS de, c AS ate FROM (SELECT b, lead(a) OVER (ORDER BY a) AS c FROM (VALUES {_RANGES}) t(a, b)) WHERE b < c")
def _(spark, d):
    return pages.range_gaps(spark)


@query("q15_upsert", f"WITH {Z} SELECT listing_id, preco FROM listings WHERE listing_id NOT IN (SELECT trim(id) FROM z WHERE trim(id) <> '') UNION ALL SELECT trim(id), preco FROM ({_FIRSTID})")
def _(spark, d):
    return store.upsert(raw(spark, d), nan_to_null(stored(spark, d))).select("listing_id", "preco")


@query("q19_distance_expression", f"WITH {G} SELECT place_id, {_hav((-16.7, -49.25))} AS km FROM g")
def _(spark, d):
    return cache(spark, d).select("place_id", F.round(distance_km(F.col("latitude"), F.col("longitude"), (-16.7, -49.25)), 6).alias("km"))
