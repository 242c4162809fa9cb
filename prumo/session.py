"""Session set-up, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_cuts: list[tuple[SparkSession, str]] = []
_shared: dict[str, str] = {}


def make_session(app: str = "prumo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, skew handling."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python need not find it by itself."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    if package.is_dir():
        folder = tempfile.mkdtemp(prefix="prumo-code-")
        _own_dirs.append(folder)
        with zipfile.ZipFile(archive := f"{folder}/prumo.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"prumo/{f.relative_to(package)}")
        sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _shared:
        _own_dirs.append(tempfile.mkdtemp(prefix="prumo-"))
        _shared[app] = f"file://{_own_dirs[-1]}"
    return _shared[app]


def drop_cuts() -> None:
    """Delete the tables of cut() and scratch(); frames that read them are spent. Runs by itself at the end of the process."""
    while _cuts:
        spark, path = _cuts.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the application has ended already
            _cuts.clear()


@atexit.register
def _remove_own_dirs() -> None:
    drop_cuts()
    for d in _own_dirs:
        shutil.rmtree(d, ignore_errors=True)


@contextmanager
def cuts_dropped() -> Iterator[None]:
    """Delete, at the end of the block, the tables that were cut in it; what the block made must be written by then."""
    before = list(_cuts)
    del _cuts[:]
    try:
        yield
    finally:
        drop_cuts()
        _cuts.extend(before)


def scratch(spark: SparkSession) -> str:
    """A path for a table in the shared folder, deleted like those of cut()."""
    path = os.path.join(shared_dir(spark), f"prumo-{uuid.uuid4().hex}")
    _cuts.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once into the shared folder, read back.

    Columnar, computed once, and it survives the loss of executors; its file sizes give the planner true statistics.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
