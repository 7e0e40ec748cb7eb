from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hot_keys
from graphloom.operators.durable import running_total

DDL = "edge_id bigint, src bigint, dst bigint, edge_type string, loaded_at timestamp_ntz, side string, node string"


def make(spark, rows):
    full = [(e, s, d, t, None, "clash", "clash") for e, s, d, t in rows]
    return spark.createDataFrame(full, DDL)


def brute(rows):
    edges = {r[0]: r for r in rows if r[0] is not None}
    counts, lists = Counter(), defaultdict(list)
    for e, s, d, t in edges.values():
        for side, node, other in (("out", s, d), ("in", d, s)):
            if node is not None:
                counts[side, t, node] += 1
                lists[side, t, node].append((other, e))
    return edges, counts, lists


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(1)
    rows = [(i, rng.randrange(50, 90), 7 if i % 3 == 0 else rng.randrange(50, 90), rng.choice("AB")) for i in range(3000)]
    rows += [(1, rows[1][1], rows[1][2], rows[1][3])] * 5  # sent again
    rows += [(None, 1, 2, "A"), (9000, 5, None, "A"), (9001, None, 5, None), (9002, 6, 6, "A"), (9003, 6, 6, "A")]
    return rows


def test_counts_and_hot_nodes(spark, rows, skewed):
    edges, counts, _ = brute(skewed)
    df = make(spark, skewed)
    got = {(r.side, r.edge_type, r.node): r.entries for r in hot_keys.entry_counts(df).collect()}
    assert got == dict(counts)
    hot = {k for k, n in counts.items() if n >= 0.01 * len(edges)}
    assert {(r.side, r.edge_type, r.node) for r in hot_keys.hot_nodes(df).collect()} == hot
    assert ("in", "A", 7) in hot


def test_adjacency_chunks(spark, skewed):
    _, _, lists = brute(skewed)
    got = defaultdict(dict)
    for r in hot_keys.sorted_adjacency(make(spark, skewed), chunk=16).collect():
        assert len(r.adj) <= 16
        got[r.side, r.edge_type, r.node][r.chunk_no] = [(e.other, e.edge_id) for e in r.adj]
    assert set(got) == set(lists)
    for key, chunks in got.items():
        assert sorted(chunks) == list(range(len(chunks)))
        joined = [e for k in sorted(chunks) for e in chunks[k]]
        assert joined == sorted(lists[key], key=lambda e: (e[0] is not None, e[0] or 0, e[1]))


def test_the_newest_row_counts(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 10, 20, 'A', timestamp_ntz'2020-01-01'), (1, 10, 30, 'A', timestamp_ntz'2021-01-01') t(edge_id, src, dst, edge_type, loaded_at)"
    )
    assert [tuple(r) for r in hot_keys.distinct_edges(df).collect()] == [(1, 10, 30, "A")]


def test_empty(spark):
    df = make(spark, [])
    assert hot_keys.hot_nodes(df).count() == hot_keys.entry_counts(df).count() == hot_keys.sorted_adjacency(df).count() == 0


def test_running_total_over_a_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"), "id", F.lit(2).alias("v"))
    got = running_total(df, ["k"], ["id"], "v", "total").collect()
    assert len(got) == 500
    for k in (None, 0, 1):
        ordered = sorted((r.id, r.total) for r in got if r.k == k)
        assert [t for _, t in ordered] == [2 * (i + 1) for i in range(len(ordered))]
