"""What the plans must look like."""

import os
import re

import pytest
from pyspark.sql import functions as F

from prumo.operators.clean import amenity_flags
from prumo.operators.dedup import keep_best
from prumo.plans.reference_queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_best_moves_rows_once_and_prunes_before(spark):
    p = plan(keep_best(spark.read.parquet(f"{SF}/zap_dataset.parquet")))
    assert len(re.findall(r"\bExchange hashpartitioning", p)) == 1 and "WindowGroupLimit" in p


def test_top_errors_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["o3_top_errors"](spark, SF))


def test_scan_reads_only_its_columns(spark):
    p = QUERIES["s6_parquet_columns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<bairro:string>", p)


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "adfjmopuw" or n.startswith(("sel", "c1", "c2", "c3"))])
def test_core_operators_stay_in_the_jvm(spark, name):
    if name.startswith(("e", "l", "st", "c7")):
        return
    p = plan(QUERIES[name](spark, SF))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups", p)


def test_amenity_flags_are_one_projection(spark):
    p = plan(amenity_flags(spark.range(1).select(F.lit("Pool").alias("comodidades"), F.col("id"))).select("piscina", "pets"))
    assert p.count("Project") <= 1 and "Exchange" not in p
