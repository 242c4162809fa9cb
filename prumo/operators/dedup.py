"""Deduplication of listings: whole rows, physical signatures, and against a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.functions.cast import safe_float, safe_str, zero_if_missing
from prumo.functions.text import lower_key


def drop_copies(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; nulls are equal."""
    return df.dropDuplicates()


def later_copies(df: DataFrame) -> DataFrame:
    """The second and further copies of equal rows."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).where("__n > 1")
    return n.withColumn("__i", F.explode(F.sequence(F.lit(2), F.col("__n")))).drop("__n", "__i")


def signature() -> Column:
    """The physical signature of a listing.

    With a street, a size and a price: street, size, bedrooms, price. Otherwise neighbourhood, kind and all numbers.
    Size and price are rounded half to even.
    """
    street = lower_key(F.col("rua"))
    size, price = (F.bround(safe_float(F.col(c)), 0) for c in ("area_m2", "preco"))
    text = lambda c: F.coalesce(c.cast("decimal(20,0)").cast("string"), F.lit("nan"))
    rooms, baths, spaces = (zero_if_missing(F.col(c)).cast("string") for c in ("quartos", "banheiros", "vagas"))
    near = F.concat(F.lit("RUA:"), street, F.lit("|A:"), text(size), F.lit("|Q:"), rooms, F.lit("|P:"), text(price))
    far = F.concat(
        F.lit("B:"), lower_key(F.col("bairro")), F.lit("|T:"), lower_key(F.col("tipo_imovel")), F.lit("|A:"), text(size), F.lit("|Q:"), rooms, F.lit("|BNH:"), baths, F.lit("|V:"), spaces, F.lit("|P:"), text(price)
    )
    return F.when((street != "") & size.isNotNull() & price.isNotNull(), near).otherwise(far)


def richness() -> dict[str, Column]:
    """How complete a listing is: length of description, photos, whether neighbourhood and street are told."""
    photos = F.coalesce(F.col("fotos_urls"), F.lit(""))
    return {
        "desc_len": F.length(F.coalesce(F.col("descricao_completa"), F.lit(""))),
        "foto_count": F.when(photos == "", 0).otherwise(F.length(photos) - F.length(F.replace(photos, F.lit(","), F.lit(""))) + 1),
        "has_bairro": F.col("bairro").isNotNull().cast("int"),
        "has_rua": F.col("rua").isNotNull().cast("int"),
    }


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (one exchange; the group limit is applied before it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def keep_best(df: DataFrame, *ties: str) -> DataFrame:
    """The most complete listing of each physical signature.

    Order: street told, neighbourhood told, photos, length of description, all descending; then the tie columns (id, and
    scraped_at where there is one) ascending.
    """
    ties = ties or tuple(c for c in ("id", "listing_id", "scraped_at") if c in df.columns)
    scored = df.withColumns({f"__{k}": v for k, v in richness().items()} | {"__sig": signature()})
    order = [F.desc(f"__{k}") for k in ("has_rua", "has_bairro", "foto_count", "desc_len")] + [F.asc(t) for t in ties]
    return first_per(scored, ["__sig"], *order).select(*df.columns)


def dedup_counts(df: DataFrame) -> DataFrame:
    """One row: listings, duplicates removed, unique assets. The signatures are counted, no row is moved."""
    return df.agg(F.count("*").alias("inicial"), F.countDistinct(signature()).alias("unicos")).select("inicial", (F.col("inicial") - F.col("unicos")).alias("removidos"), "unicos")


def first_per_id(df: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """One row per id, blank and null ids dropped; the first in the given order."""
    clean = df.withColumn("__id", safe_str(F.col(key))).where("__id IS NOT NULL")
    return first_per(clean, ["__id"], *(F.asc(c) for c in (order or ("scraped_at",)))).drop("__id")


def only_new(df: DataFrame, known: DataFrame, key: str = "id", known_key: str = "listing_id") -> DataFrame:
    """Rows whose id the store does not have: an anti-join against its key column."""
    keys = known.select(F.col(known_key).alias("__known")).distinct()
    return df.join(keys, safe_str(F.col(key)) == F.col("__known"), "left_anti")


def known_ids(df: DataFrame, known: DataFrame, key: str = "id", known_key: str = "listing_id") -> DataFrame:
    """The distinct ids of df that the store has."""
    return df.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct().join(known.select(F.col(known_key).alias("id")), "id", "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The different non-null values of a column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def union_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both by key; where both have one, the right's."""
    both = left.withColumn("__p", F.lit(1)).unionByName(right.withColumn("__p", F.lit(0)))
    return first_per(both, [key], F.asc("__p"), *(F.asc(c) for c in left.columns if c != key)).drop("__p")
