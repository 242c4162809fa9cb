"""Schemas of listings and caches, and schema walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

#: The 23 fields of a parsed listing, in the order of the parser's output.
LISTING_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("id", _S), ("titulo", _S), ("tipo_imovel", _S), ("url", _S), ("preco", _D), ("moeda", _S), ("condominio", _D), ("area_m2", _D), ("quartos", _I), ("banheiros", _I), ("vagas", _I), ("bairro", _S),
            ("rua", _S), ("cidade", _S), ("estado", _S), ("pais", _S), ("aceita_pets", _B), ("comodidades", _S), ("fotos_urls", _S), ("descricao_completa", _S), ("data_publicacao", _S), ("data_modificacao", _S), ("scraped_at", _S),
        )
    ]
)
#: The stored listings table: listing_id as key, pets as text, the scrape as a time.
STORE_SCHEMA = T.StructType([T.StructField("listing_id" if f.name == "id" else f.name, {"aceita_pets": _S, "scraped_at": T.TimestampType()}.get(f.name, f.dataType)) for f in LISTING_SCHEMA])
CACHE_SCHEMA = T.StructType([T.StructField("address", _S), T.StructField("latitude", _D), T.StructField("longitude", _D), T.StructField("formatted_address", _S), T.StructField("place_id", _S)])
#: Columns that no later step uses.
UNUSED = ("id", "url", "moeda", "cidade", "estado", "pais", "fotos_urls", "descricao_completa")

_CLASSES = {
    "number": (T.NumericType,),
    "boolean": (T.BooleanType,),
    "string": (T.StringType,),
    "time": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def columns_by_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of the given classes: number, boolean, string, time."""
    wanted = tuple(t for k in kinds for t in _CLASSES[k])
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def keep_existing(df: DataFrame, *names: str) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*(n for n in names if n in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating-point column as null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def narrow(df: DataFrame, integers: tuple[str, ...] = ("quartos", "banheiros", "vagas")) -> DataFrame:
    """The declared output types: whole-number columns as BIGINT; missing columns are skipped."""
    return df.withColumns({c: F.col(c).try_cast("double").cast("bigint") for c in integers if c in df.columns})
