"""Queries of the training-data problems 1, 3, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.llm.bpe import encode_corpus, spread
from prumo.llm.packing import pack
from prumo.llm.places import known_cities, linked_sides, listing_addresses, read_addresses, same_places
from prumo.llm.products import pairs, same_property
from prumo.llm.stuffing import stuffed_pages
from prumo.llm.survivors import survivors
from prumo.session import cut, table

#: Tokens a training sequence holds.
CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scrape whose value survives, for each field in which a listing's scrapes disagree."""
    return p1_survivors(spark, sf_dir).select("id", "campo", "scraped_at")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found with the surviving values."""
    return survivors(table(spark, sf_dir, "zap_dataset").select("id", "scraped_at", "data_modificacao", "cidade", "descricao_completa", "fotos_urls", "rua", "bairro"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of one property."""
    raw = table(spark, sf_dir, "zap_dataset").select("id", "titulo", "tipo_imovel", "url", "preco", "area_m2", "quartos", "banheiros", "vagas", "bairro", "cidade", "rua")
    return pairs(same_property(raw))


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "zap_dataset").select("id", "rua", "bairro", "cidade")
    cache = read_addresses(table(spark, sf_dir, "geocoding_cache"), "place_id", "address", cities=known_cities(raw))
    return cut(listing_addresses(raw)), cut(cache)


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of a listing or a cache row by level, and how it was placed: linked, inherited, ambiguous, incomplete."""
    sides = zip(linked_sides(*_addresses(spark, sf_dir)), ("zap_dataset", "geocoding_cache"))
    a, b = (x.withColumn("tabela", F.lit(name)) for x, name in sides)
    return a.unionByName(b)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings and cache rows of one place."""
    return same_places(*_addresses(spark, sf_dir)).select(F.col("esquerda").alias("id"), F.col("direita").alias("place_id"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the group of their property, those alone in theirs too: p3_found without the pairs."""
    raw = table(spark, sf_dir, "zap_dataset").select("id", "titulo", "tipo_imovel", "url", "preco", "area_m2", "quartos", "banheiros", "vagas", "bairro", "cidade", "rua")
    return same_property(raw).distinct()


def p8_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens in them and the share of their room that is used."""
    full = p8_containers(spark, sf_dir).groupBy("recipiente").agg(F.sum("tamanho").alias("t"))
    return full.agg(F.count("*").alias("recipientes"), F.sum("t").alias("tokens"), F.max("t").alias("mais_cheio"), (F.sum("t") / (F.count("*") * CAPACITY)).alias("uso"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, measured in tokens, in containers of CAPACITY tokens."""
    sizes = encode_corpus(table(spark, sf_dir, "documents"), counts_only=True)
    return pack(sizes, "doc_id", "tokens", CAPACITY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly repeated keywords, links or tags."""
    pages = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stuffed_pages(pages).distinct()


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_places": p6_places, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_waste": p8_waste, "p9_found": p9_found}
SQL: dict[str, str] = {}
