"""Every registered query against its SQL oracle on the smallest supplied tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import check_oracle  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(check_oracle.entry.queries()))
def test_query(spark, con, name):
    assert check_oracle.compare(spark, con, SF_DIR, name) == ""


def test_every_oracle_has_a_query():
    assert set(check_oracle.entry.oracle_sql()) <= set(check_oracle.entry.queries())
