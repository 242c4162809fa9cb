"""Command line: python -m prumo.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.operators.clean import coherence
from prumo.operators.dedup import dedup_counts, keep_best
from prumo.operators.stats import coverage
from prumo.plans import pipelines
from prumo.schema import STORE_SCHEMA
from prumo.session import cuts_dropped, make_session
from prumo.sources import files, pages, store


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or a folder with CSV files, else parquet; on any file system."""
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.csv")
    found = parts.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(parts)
    return files.scan_csv(spark, path) if path.rstrip("/").endswith(".csv") or found else spark.read.parquet(path)


def _write(df: DataFrame, path: str) -> None:
    (files.write_csv if path.rstrip("/").endswith(".csv") else files.write_parquet)(df, path)


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed pages to raw listings."""
    _write(pages.parse_items(pages.embedded_items(pages.scan_pages(spark, a.input))), a.output)


def deduplicate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Keep the most complete listing of each physical asset."""
    df = _read(spark, a.input)
    _write(keep_best(df), a.output)
    print(dedup_counts(df).first().asDict())


def _insert(batch: DataFrame, where: str) -> int:
    """Into a table folder, or, by an address of JDBC, a database."""
    return (store.insert_if_absent_jdbc if where.startswith("jdbc:") else store.insert_if_absent)(batch, where)


def load(spark: SparkSession, a: argparse.Namespace) -> None:
    """Add new listings of a file to the store."""
    print({"inseridos": _insert(_read(spark, a.input), a.store)})


def daily(spark: SparkSession, a: argparse.Namespace) -> None:
    """Add a day's new listings, deduplicated, to the store; with --dry-run only show how many there are."""
    if a.store.startswith("jdbc:"):
        store.ensure_jdbc_table(spark, a.store)
        stored = store.jdbc_keys(spark, a.store)
    else:
        stored = store.ensure_table(spark, a.store, STORE_SCHEMA)
    new = pipelines.daily(_read(spark, a.input), stored)
    if a.dry_run:
        print({"novos": new.count()})
    else:
        print({"inseridos": _insert(new, a.store)})


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    """Clean, extract, enrich and add distances, bins and ratios."""
    _write(pipelines.features(pipelines.preprocess(_read(spark, a.input), spark.read.parquet(a.cache))), a.output)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Coherence of titles and fields; with official totals (categoria, total) also the coverage."""
    df = _read(spark, a.input)
    coherence(df).show(truncate=False)
    if a.totals:
        official = spark.read.csv(a.totals, header=True).select("categoria", F.col("total").try_cast("long").alias("total"))
        coverage(df, official, "id", "tipo_imovel").show(1000, truncate=False)


COMMANDS = {"ingest": ingest, "deduplicate": deduplicate, "load-csv": load, "daily": daily, "preprocess": preprocess, "validate": validate}


def parser() -> argparse.ArgumentParser:
    """The command line's parser."""
    p = argparse.ArgumentParser(prog="prumo")
    p.add_argument("--master", default=None)
    p.add_argument("--shared", help="folder that all machines of the cluster share, where the session names none")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = sub.add_parser(name, help=f.__doc__)
        c.add_argument("input")
        if name in ("ingest", "deduplicate", "preprocess"):
            c.add_argument("output")
        if name in ("load-csv", "daily"):
            c.add_argument("store")
        if name == "daily":
            c.add_argument("--dry-run", action="store_true")
        if name == "preprocess":
            c.add_argument("--cache", required=True)
        if name == "validate":
            c.add_argument("--totals")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one command."""
    a = parser().parse_args(args)
    conf = {"spark.checkpoint.dir": a.shared} if a.shared else {}
    spark = spark or make_session("prumo", a.master, **conf)
    with cuts_dropped():
        COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    main()
