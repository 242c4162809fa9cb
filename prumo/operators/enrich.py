"""Coordinates for listings: cache lookup, ordered fallback over a gazetteer, bounding box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.functions.text import address, normalize_text
from prumo.operators.dedup import first_per
from prumo.schema import narrow

#: Bounds of the city, both ends included (fixed values).
BOUNDS = {"latitude": (-16.85, -16.55), "longitude": (-49.45, -49.15)}


def with_address(df: DataFrame, sep: str = ", ") -> DataFrame:
    """df with the column endereco: street and neighbourhood."""
    return df.withColumn("endereco", address(F.col("rua"), F.col("bairro"), sep))


def split_address(c: Column) -> tuple[Column, Column]:
    """Street and neighbourhood of an address: its first two parts between commas."""
    return F.trim(F.split_part(c, F.lit(","), F.lit(1))), F.trim(F.split_part(c, F.lit(","), F.lit(2)))


def inside_bounds(df: DataFrame, lat: str = "latitude", lon: str = "longitude", bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Rows inside the bounds; rows without coordinates are dropped."""
    return df.where(F.col(lat).between(*bounds["latitude"]) & F.col(lon).between(*bounds["longitude"]))


def lookup(df: DataFrame, cache: DataFrame, key: str = "endereco") -> DataFrame:
    """df with latitude and longitude from the cache by the normal form of the key, null where it is missing.

    The cache is reduced to one row per normal form (the smallest place_id) before the join. Each different address is
    normalised and looked up once; the join strategy is the planner's, by size.
    """
    known = first_per(cache.select(normalize_text(F.col("address")).alias("__n"), "latitude", "longitude", "place_id").where("__n <> ''"), ["__n"], F.asc("place_id"))
    asked = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__n", normalize_text(F.col(key)))
    found = asked.join(known.drop("place_id"), "__n").drop("__n")
    return df.join(found, key, "left")


def split_by_cache(df: DataFrame, cache: DataFrame, key: str = "endereco") -> DataFrame:
    """The different addresses of df with the flag no_cache: whether the cache has them."""
    known = cache.select(normalize_text(F.col("address")).alias("__n"), F.lit(True).alias("__k")).distinct()
    asked = df.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.withColumn("__n", normalize_text(F.col(key))).join(known, "__n", "left").select(key, F.col("__k").isNotNull().alias("no_cache"))


def cascade(addresses: DataFrame, gazetteer: DataFrame, key: str = "endereco", city: str | None = None) -> DataFrame:
    """Coordinates from a gazetteer (nome, latitude, longitude, place_id): street and neighbourhood, then neighbourhood, then street; the first hit counts.

    The three questions of an address are rows of one join; the first hit is an aggregate per address. Of several
    gazetteer rows of one name the smallest place_id counts. city: only gazetteer rows of this city (column cidade), or
    of none, count.
    """
    if city is not None:
        gazetteer = gazetteer.where(F.coalesce(F.trim("cidade"), F.lit("")).isin("", city))
    street, place = split_address(F.col(key))
    asked = addresses.select(key).distinct().select(key, F.posexplode(F.array(F.concat(street, F.lit(", "), place), place, street)).alias("ordem", "nome"))
    asked = asked.withColumn("nome", normalize_text(F.col("nome"))).where("nome <> '' AND nome <> ','")
    names = first_per(gazetteer.select(normalize_text(F.col("nome")).alias("nome"), "latitude", "longitude", "place_id"), ["nome"], F.asc("place_id"))
    hit = asked.join(names, "nome")
    first = hit.groupBy(key).agg(F.min_by(F.struct("latitude", "longitude", "place_id"), "ordem").alias("h"), F.min("ordem").alias("passo"))
    return addresses.select(key).distinct().join(first, key, "left").select(key, F.col("h.latitude").alias("latitude"), F.col("h.longitude").alias("longitude"), F.col("h.place_id").alias("place_id"), "passo")


def absent(new: DataFrame, cache: DataFrame, key: str = "address") -> DataFrame:
    """New cache rows whose normal address the cache lacks, one per normal address (insert if absent)."""
    keyed = new.withColumn(key, normalize_text(F.col(key))).where(F.col(key) != "")
    one = first_per(keyed, [key], F.asc("place_id"))
    return one.join(cache.select(normalize_text(F.col(key)).alias(key)).distinct(), key, "left_anti")


def enrich(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates by address, rows outside the city's bounds dropped, address columns dropped."""
    return df.transform(with_address).transform(lookup, cache).drop("endereco", "rua", "bairro").transform(inside_bounds).transform(narrow)


def pages_to_keep(pages: DataFrame, partition: list[str], page: str, items: str, known: DataFrame | None, most_pages: int = 50) -> DataFrame:
    """Pages of each partition before its first stop page, and up to most_pages.

    A page stops its partition if it has no items, or if it isn't the first and none of its items is unknown. Items are
    an array of ids; an item without id counts as known; without known ids only empty pages stop. All pages are read
    here, so the early stop is a filter.
    """
    item = pages.select(*partition, page, F.explode(items).alias("__id")).where("__id IS NOT NULL AND __id <> ''")
    stop = F.size(F.coalesce(F.col(items), F.array())) == 0
    marked = pages
    if known is not None:
        fresh = item.join(known.select(F.col(known.columns[0]).alias("__id")).distinct(), "__id", "left_anti").select(*partition, page).distinct().withColumn("__new", F.lit(True))
        marked = pages.join(fresh, [*partition, page], "left")
        stop = stop | ((F.col(page) > 1) & F.col("__new").isNull())
    first_stop = F.min(F.when(stop, F.col(page))).over(Window.partitionBy(*partition))
    kept = marked.withColumn("__stop", first_stop).where((F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))) & (F.col(page) <= most_pages))
    return kept.select(*pages.columns)
