from __future__ import annotations

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from graphloom.llm import rank_fusion as rf

DDL = "request_id bigint, node bigint, distance float, scores map<string,double>, fused double, _request string"
NAMES = ("bm25", "degree")


def make(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "clash") for r in rows], DDL)


def scores():
    return {"distance": -F.col("distance").cast("double")} | {n: F.col("scores")[n] for n in NAMES}


def fused(spark, rows, **more):
    got = rf.normal_scores(make(spark, rows), "request_id", "node", scores(), **more).collect()
    return {(r.request_id, r.node): r.fused for r in got}


def brute(rows, weights=(1, 1, 1)):
    best = {}
    for q, node, d, s in rows:
        if q is None or node is None:
            continue
        own = best.setdefault((q, node), [None] * 3)
        for i, x in enumerate([None if d is None else -d, *[(s or {}).get(n) for n in NAMES]]):
            if x is not None and not math.isnan(x):
                own[i] = x if own[i] is None else max(own[i], x)
    out = {}
    for (q, node), own in best.items():
        peers = [v for (r, _), v in best.items() if r == q]
        total = 0
        for i, x in enumerate(own):
            key = lambda y: -math.inf if y is None else y
            less = sum(key(p[i]) < key(x) for p in peers)
            same = sum(key(p[i]) == key(x) for p in peers)
            total += weights[i] / sum(weights) * NormalDist().inv_cdf((less + same / 2) / len(peers))
        out[q, node] = total
    return out


def close(a, b):
    assert set(a) == set(b)
    assert all(abs(a[k] - b[k]) < 1e-7 for k in a)


def test_against_brute_force(spark):
    rng = random.Random(2)
    nan = float("nan")
    rows = []
    for n in range(300):
        q = 1 if n % 3 == 0 else rng.randrange(2, 9)  # one request has a third of all rows
        s = {k: rng.choice([rng.random() * 10 ** rng.randrange(6), 5.0, None, nan]) for k in NAMES if rng.random() < 0.8}
        rows.append((q, n, rng.choice([rng.random(), 0.5, None, nan]), s if rng.random() < 0.9 else None))
    rows += rows[:40]
    rows += [(None, 1, 0.1, {}), (1, None, 0.1, {})]
    close(fused(spark, rows), brute([(q, n, d if d is None else float(f"{d:.9g}"), s) for q, n, d, s in rows]))
    close(fused(spark, rows, weights={"distance": 2, "bm25": 1, "degree": 0.5}), brute(rows, (2, 1, 0.5)))


def test_inverse_normal(spark):
    points = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.98, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in points], "p double").select(rf.inverse_normal(F.col("p"))).collect()]
    assert all(abs(a - NormalDist().inv_cdf(p)) < 1e-7 for a, p in zip(got, points))


def test_size_and_outliers_do_not_matter(spark):
    rows = [(1, n, 0.1 * n, {"bm25": float(n), "degree": 0.0}) for n in range(1, 10)]
    wild = [(1, n, 0.1 * n, {"bm25": 10.0**n * 1e6, "degree": 0.0}) for n in range(1, 10)]
    assert fused(spark, rows) == fused(spark, wild)


def test_leading(spark):
    rows = [(1, n, 0.5, {}) for n in range(200)] + [(2, 7, 0.1, {}), (2, 3, 0.2, {})]
    table = rf.normal_scores(make(spark, rows), "request_id", "node", scores())
    requests = spark.createDataFrame([(1, 3), (2, 9), (3, 5), (4, None), (None, 2)], "request_id bigint, top_n int")
    got = sorted((r.request_id, r.position, r.node) for r in rf.leading(table, requests, "request_id", "node", "top_n").collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 7), (2, 2, 3)]


def test_empty(spark):
    assert fused(spark, []) == {}


def test_values_shared_by_most_rows_of_a_request(spark, monkeypatch):
    monkeypatch.setattr(rf, "HOT", 10)
    rng = random.Random(6)
    rows = [(1 if n < 200 else n % 7, n, rng.choice([0.5, rng.random()]), {"bm25": rng.choice([1.0, rng.random()])}) for n in range(300)]
    close(fused(spark, rows), brute([(q, n, float(f"{d:.9g}"), s) for q, n, d, s in rows]))
