import pytest
from pyspark.sql import functions as F

from prumo.schema import LISTING_SCHEMA, STORE_SCHEMA
from prumo.session import cut, cuts_dropped, shared_dir
from prumo.sources import store


def batch(spark, *ids):
    return spark.createDataFrame([tuple({"id": i, "titulo": f"t{n}", "preco": 1.5, "quartos": 2, "scraped_at": "2025-01-01T00:00:00"}.get(c) for c in LISTING_SCHEMA.names) for n, i in enumerate(ids)], LISTING_SCHEMA)


def test_a_database_takes_every_listing_once(spark):
    url = "jdbc:derby:memory:prumo;create=true"
    try:
        store.ensure_jdbc_table(spark, url)
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    assert store.insert_if_absent_jdbc(batch(spark, "a", "b", "a", " ", None), url) == 2
    assert store.insert_if_absent_jdbc(batch(spark, "b", "c"), url) == 1
    assert store.insert_if_absent_jdbc(batch(spark, "b", "c"), url) == 0
    got = store.scan_jdbc(spark, url, "listings")
    assert sorted(r[0] for r in got.select(got.columns[0]).collect()) == ["a", "b", "c"]
    assert [c.lower() for c in got.columns] == STORE_SCHEMA.names
    assert {r.titulo for r in got.toDF(*STORE_SCHEMA.names).collect()} == {"t0", "t1"}


def test_addresses():
    assert store.jdbc_options("jdbc:derby:x") == {"url": "jdbc:derby:x"}
    assert store.jdbc_options("postgres://u:p@h:5/b") == {"url": "jdbc:postgresql://h:5/b", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.conf = Conf({"spark.checkpoint.dir": "hdfs://x/y"})
    assert shared_dir(Session) == "hdfs://x/y"


def test_cuts_are_dropped_at_the_end_of_a_block(spark):
    before = cut(spark.range(3))
    with cuts_dropped():
        inner = cut(spark.range(5))
        assert inner.agg(F.count("*")).first()[0] == 5
    files = inner.inputFiles
    assert before.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(*inner.inputFiles()).count() if files else None


def test_csv_of_one_line_rows_is_read_the_same(spark, tmp_path):
    from prumo.sources import files

    path = str(tmp_path / "x.csv")
    files.write_csv(batch(spark, "a", "#N/A", "1.#IND", "b"), path)
    a, b = (sorted(map(repr, files.scan_csv(spark, path, one_line=o).select("id", "titulo", "preco").collect())) for o in (False, True))
    assert a == b and sum("id=None" in r for r in a) == 2
