"""Every query against its oracle on the smallest tables; those without one give the same rows twice."""

import os
import subprocess
import sys

import pytest

from oracle import check
from reminisce import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_repeatable(spark, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["conversation_id", "n", "tokens", "first_seq", "last_seq"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
