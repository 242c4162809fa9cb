"""Incremental ingest as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prumo.functions.cast import safe_str
from prumo.sources.store import ensure_table, insertable


def read_listings(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Listings landed as files in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def first_seen(stream: DataFrame, key: str = "id", time: str | None = None, late: str = "30 days") -> DataFrame:
    """The first record of each id; blank ids are dropped.

    Without a time column the ids are kept for ever; with one, an id is forgotten once it is late beyond the watermark,
    which bounds the state and may let a very late copy through.
    """
    clean = stream.withColumn(key, safe_str(F.col(key))).where(F.col(key).isNotNull())
    if time is None:
        return clean.dropDuplicates([key])
    return clean.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, store: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Add every batch's new listings to the table in a folder, over all that has landed, then stop.

    A batch that is run again adds nothing: its ids are stored already.
    """

    def add(batch: DataFrame, _: int) -> None:
        stored = ensure_table(batch.sparkSession, store).select("listing_id")
        insertable(batch, stored, *order).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records per time window and key, late ones within the watermark counted in."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("janela"), key).agg(F.count("*").alias("n"))
