from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from graphloom.operators import durable


def session(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_shared_folder_is_the_one_the_session_names(tmp_path):
    assert durable.shared_folder(session("spark://a:1", f"file://{tmp_path}/shared/")) == f"file://{tmp_path}/shared/graphloom-app-1"
    assert durable.shared_folder(session("spark://a:1", "hdfs://x/shared")) == "hdfs://x/shared/graphloom-app-1"
    assert f"{tmp_path}/shared/graphloom-app-1" in durable._folders
    for master in ("spark://a:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            durable.shared_folder(session(master, None))
    assert os.path.isdir(durable.shared_folder(session("local[4]", None)))


def test_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_folder", lambda _: f"file://{tmp_path}/own")
    table = durable.materialize(spark.range(5))
    assert table.count() == 5 and os.listdir(tmp_path) == ["own"]
    durable.release(spark)
    assert os.listdir(tmp_path) == []


def test_types_and_empty_tables_survive(spark):
    df = spark.sql("SELECT 1 AS a, array(struct('x' AS b)) AS c, timestamp_ntz'2020-01-01' AS d").where("a = 2")
    kept = durable.materialize(df)
    assert [f.dataType.simpleString() for f in kept.schema] == [f.dataType.simpleString() for f in df.schema] and kept.count() == 0
