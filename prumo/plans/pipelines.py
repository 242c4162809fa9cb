"""Composite pipelines: each is one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prumo.ml.features import BinsDiscretizer, ClusterTransformer, GeodesicDistance, RatioTransformer
from prumo.operators.clean import clean, extract
from prumo.operators.dedup import first_per_id, keep_best, only_new
from prumo.operators.enrich import enrich
from prumo.sources.store import insert_if_absent, insertable


def preprocess(raw: DataFrame, cache: DataFrame) -> DataFrame:
    """Clean, extract and enrich raw listings."""
    return raw.transform(clean).transform(extract).transform(enrich, cache)


def with_distances(raw: DataFrame, cache: DataFrame, rows: int | None = None) -> DataFrame:
    """preprocess() and the distances to the points of interest, over all rows or the first few (a smoke run)."""
    return GeodesicDistance().transform(preprocess(raw.limit(rows) if rows else raw, cache))


def features(enriched: DataFrame) -> DataFrame:
    """Distances, bins and ratios of enriched listings."""
    return RatioTransformer().transform(BinsDiscretizer().transform(GeodesicDistance().transform(enriched)))


def clustered(enriched: DataFrame, k: int = 16, seed: int = 1667) -> DataFrame:
    """features() and the cluster of the coordinates."""
    df = features(enriched)
    return ClusterTransformer(k, seed).fit(df).transform(df)


def daily(scraped: DataFrame, stored: DataFrame) -> DataFrame:
    """A day's new listings in the store's form: unseen ids, one per id, best of each physical asset."""
    fresh = first_per_id(only_new(scraped, stored), "id")
    return insertable(keep_best(fresh), stored)


def bulk_load(raw: DataFrame, path: str) -> int:
    """Load raw listings into the table in a folder; the number added."""
    return insert_if_absent(raw, path)
