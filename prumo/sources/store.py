"""The store of listings and geocodes: a table folder, or a database by JDBC."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.functions.cast import safe_float, safe_int, safe_str, timestamp_or
from prumo.operators.dedup import first_per_id, only_new
from prumo.schema import LISTING_SCHEMA, STORE_SCHEMA
from prumo.session import cut


def engine_url(database_url: str | None, folder: str = "data") -> str:
    """Where the store is: the given database with its driver named, else a local file."""
    if not database_url:
        return f"sqlite:///{folder}/listings.db"
    for short in ("postgres://", "postgresql://"):
        if database_url.startswith(short):
            return "postgresql+psycopg://" + database_url[len(short) :]
    return database_url


def jdbc_options(database_url: str) -> dict[str, str]:
    """Options of Spark's JDBC source for a database address with its user and password; an address of JDBC stays as it is."""
    if database_url.startswith("jdbc:"):
        return {"url": database_url}
    u = urlsplit(database_url.replace("+psycopg", "").replace("postgres://", "postgresql://"))
    kind = "sqlite" if u.scheme == "sqlite" else u.scheme
    if kind == "sqlite":
        return {"url": f"jdbc:sqlite:{u.path.lstrip('/')}", "driver": "org.sqlite.JDBC"}
    port = f":{u.port}" if u.port else ""
    out = {"url": f"jdbc:{kind}://{u.hostname}{port}{u.path}", "driver": "org.postgresql.Driver"}
    return out | ({"user": u.username} if u.username else {}) | ({"password": u.password} if u.password else {})


def scan_jdbc(spark: SparkSession, database_url: str, query_table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table; with a numeric key and bounds (lower, upper, parts) it is read in parallel. Needs the driver's jar."""
    r = spark.read.format("jdbc").options(**jdbc_options(database_url)).option("dbtable", query_table)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return r.load()


#: Texts that a database may compare or index need a length there.
_COLUMN_TYPES = "listing_id VARCHAR(255)"


def ensure_jdbc_table(spark: SparkSession, database_url: str, name: str = "listings") -> None:
    """Make the store's table in a database if it has none. Needs the driver's jar."""
    empty = spark.createDataFrame([], STORE_SCHEMA)
    empty.write.format("jdbc").options(**jdbc_options(database_url)).option("dbtable", name).option("createTableColumnTypes", _COLUMN_TYPES).mode("ignore").save()


def jdbc_keys(spark: SparkSession, database_url: str, name: str = "listings") -> DataFrame:
    """The stored ids (listing_id) of a database; no other column is read."""
    whole = scan_jdbc(spark, database_url, name)
    return whole.select(next(c for c in whole.columns if c.lower() == "listing_id")).toDF("listing_id")


def insert_if_absent_jdbc(batch: DataFrame, database_url: str, *order: str, name: str = "listings", connections: int = 8) -> int:
    """insert_if_absent() for a table in a database: only keys are read, and new rows written by as many connections.

    A batch that is run again adds nothing, so a load that was cut short is made good by running it again.
    """
    spark = batch.sparkSession
    ensure_jdbc_table(spark, database_url, name)
    keys = jdbc_keys(spark, database_url, name)
    new = cut(insertable(batch, keys, *order))
    new.coalesce(connections).write.format("jdbc").options(**jdbc_options(database_url)).option("dbtable", name).mode("append").save()
    return new.count()


def ensure_table(spark: SparkSession, path: str, schema: T.StructType = STORE_SCHEMA) -> DataFrame:
    """The table in a folder; an empty one is made if the folder has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def to_store(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Raw listings in the store's form: id as listing_id, bad numbers and blank texts null, unreadable times now."""
    now = F.current_timestamp() if now is None else now
    key = "id" if "id" in df.columns else "listing_id"

    def form(f: T.StructField) -> Column:
        if f.name == "scraped_at":
            return timestamp_or(F.col(f.name), now)
        c = F.col(key if f.name == "listing_id" else f.name)
        return safe_float(c) if isinstance(f.dataType, T.DoubleType) else safe_int(c) if isinstance(f.dataType, T.IntegerType) else safe_str(c)

    return df.select(*(form(f).alias(f.name) for f in STORE_SCHEMA))


def insertable(batch: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """The rows a batch adds: first per id (or listing_id), blank ids dropped, stored ids left out, in the store's form."""
    key = "id" if "id" in batch.columns else "listing_id"
    return to_store(only_new(first_per_id(batch, key, *order), stored, key))


def insert_if_absent(batch: DataFrame, path: str, *order: str) -> int:
    """Add a batch's new listings to the table in a folder; the number added. Stored rows are never changed."""
    spark = batch.sparkSession
    stored = ensure_table(spark, path).select("listing_id")
    new = cut(insertable(batch, stored, *order))
    new.write.mode("append").parquet(path)
    return new.count()


def upsert(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The store after a batch whose rows replace stored ones of the same id (for stores that want changed prices)."""
    new = to_store(first_per_id(batch, "id"))
    return stored.join(new.select("listing_id"), "listing_id", "left_anti").unionByName(new)


def unknown_fields(df: DataFrame) -> list[str]:
    """Listing fields that df lacks."""
    return [n for n in LISTING_SCHEMA.names if n not in df.columns]
