"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as contract
import checks

SF_DIR = "/root/testdata/sf0.001"

# means of two or three values fall on rounding ties here, where the last bit of a float sum decides
TIES = {"preset_top_calls", "report_grouped"}


@pytest.fixture(scope="module")
def oracle():
    pytest.importorskip("duckdb")
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(checks.QUERIES) == set(checks.ORACLES)
    assert set(checks.QUERIES) <= set(contract.queries()) and set(checks.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, oracle, name):
    wrong = differences(spark, oracle, name, SF_DIR, contract.queries()[name], contract.oracle_sql()[name], 0.011 if name in TIES else 0)
    assert wrong == []


def test_entry(spark):
    made = contract.entry(spark)
    assert made.count() == 10 and made.columns[0] == "user"
