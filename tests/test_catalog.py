"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
compare = importlib.import_module("compare")
contract = importlib.import_module("__spark_entry__")
registry = importlib.import_module("graphloom.plans.registry")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, tables, name):
    df = registry.queries()[name](spark, FOLDER)
    got = compare.rows(df.columns, df.collect())
    result = tables.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert got == compare.rows(result.columns, result.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["seg", "n", "total"] and df.count() == 5


def test_names_are_sound():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_link_prediction_all_scores_every_linked_pair(tables, spark):
    got = registry.queries()["link_prediction_all"](spark, FOLDER).select("a", "b").collect()
    some = registry.queries()["link_prediction"](spark, FOLDER).select("a", "b").collect()
    assert len(got) == len(set(got)) > len(set(some)) and set(some) <= set(got)
    print("link_prediction pairs", len(set(some)), len(got))
