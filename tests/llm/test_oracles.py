import pathlib
import sys

import pytest

import __spark_entry__ as contract
from cohortal.llm.oracles import ORACLES
from cohortal.llm.queries import QUERIES

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))
import parity  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    mine = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    theirs = sorted(map(tuple, parity.connect(sf_dir).execute(ORACLES[name]).fetchall()))
    assert mine == theirs


def test_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()} == set(range(1, 14)) and "pipeline" in contract.queries()
    assert set(ORACLES) <= set(contract.oracle_sql())
