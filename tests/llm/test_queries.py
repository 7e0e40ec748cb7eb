"""The registered queries against their SQL counterparts on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

import pytest

from graphloom.llm import queries

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
compare = importlib.import_module("compare")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    result = compare.connect(FOLDER).sql(queries.SQL[name])
    assert compare.rows(df.columns, df.collect()) == compare.rows(result.columns, result.fetchall())


def test_the_contract_adds_them():
    contract = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) <= set(contract.queries()) and set(queries.SQL) <= set(contract.oracle_sql())
