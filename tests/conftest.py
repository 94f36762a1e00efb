import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from cohortal.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    # Tiny inputs: compiling a stage takes longer than interpreting it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def large_paths(monkeypatch):
    """Lower every size limit, so the code for tables beyond them runs."""
    import cohortal.core  # noqa: F401

    lookup, ranks = sys.modules["cohortal.core.lookup"], sys.modules["cohortal.core.ranks"]
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 20)
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 2)
    monkeypatch.setattr(ranks, "TOP_ROWS", 0)
    monkeypatch.setattr(ranks, "EDGE_ROWS", 2)


@pytest.fixture
def many_slices(spark):
    """Keep AQE from merging the few rows of a test into one range slice."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)
