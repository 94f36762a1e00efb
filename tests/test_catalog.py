import pathlib
import sys

import pytest

import __spark_entry__ as contract
from cohortal.catalog import ORACLES, QUERIES

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))
import parity  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Oracles are compared on the plans that production runs."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def con(sf_dir):
    return parity.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    good, note = parity.compare(spark, con, name, sf_dir)
    assert good, note


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(QUERIES) <= set(contract.queries())
    out = contract.entry(spark)
    assert out.count() == 7 and "rmsle" in out.columns


def test_features_of_the_information_queries(spark, sf_dir):
    """Each of the two queries on mutual information reads its own columns."""
    wanted = {"binned_mi": {"value", "hour", "wifi_ratio", "weeks_since_first_seen"}, "nearest_mi": {"hour", "weekday", "k", "cents"}}
    for name, columns in wanted.items():
        assert {r.feature for r in QUERIES[name](spark, sf_dir).collect()} == columns
