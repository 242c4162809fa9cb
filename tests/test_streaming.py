from conftest import rows

from prumo.schema import LISTING_SCHEMA
from prumo.sources import files
from prumo.streaming import ingest


def test_streams_equal_batches(spark, tmp_path):
    base = {n: None for n in LISTING_SCHEMA.names}
    landed, store, check = (str(tmp_path / x) for x in ("landed", "store", "check"))
    one = files.from_records(spark, [base | {"id": "1", "scraped_at": "2025-01-01T00:00:00"}, base | {"id": "1", "scraped_at": "2025-01-02T00:00:00"}, base | {"id": " "}])
    two = files.from_records(spark, [base | {"id": "1"}, base | {"id": "2"}])
    one.coalesce(1).write.parquet(landed)
    read = lambda: ingest.read_listings(spark, landed, LISTING_SCHEMA, files_per_batch=1)
    ingest.append_new(read(), store, check).awaitTermination()
    assert rows(spark.read.parquet(store).select("listing_id")) == [("1",)]
    two.coalesce(1).write.mode("append").parquet(landed)
    ingest.append_new(read(), store, check).awaitTermination()
    ingest.append_new(read(), store, check).awaitTermination()
    assert rows(spark.read.parquet(store).select("listing_id")) == [("1",), ("2",)]


def test_bounded_state(spark, tmp_path):
    schema = "id string, quando timestamp"
    landed, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.sql("SELECT * FROM VALUES ('1', TIMESTAMP '2025-01-01'), ('1', TIMESTAMP '2025-01-02'), (' 2', TIMESTAMP '2025-01-01'), (NULL, TIMESTAMP '2025-01-01') t(id, quando)").coalesce(1).write.parquet(landed)
    s = ingest.first_seen(ingest.read_listings(spark, landed, spark.createDataFrame([], schema).schema), "id", "quando", "10 days")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [("1",), ("2",)]
