from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neighbours as nb

DDL = "node_id bigint, embedding array<float>, label string, updated_at timestamp_ntz, distance string, `group` int"
DAY = dt.datetime(2030, 1, 1)


def make(spark, rows):
    return spark.createDataFrame([(n, None if v is None else [float(x) for x in v], None, at, "clash", 1) for n, v, at in rows], DDL)


def brute(ids, x, k, within=None):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - unit @ unit.T, 12) + 0.0
    zero = (x == 0).all(1)
    d[zero] = d[:, zero] = 1.0
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, n in enumerate(ids):
        order = np.lexsort((ids, d[i]))[:k]
        out[n] = [ids[j] for j in order if np.isfinite(d[i][j]) and (within is None or d[i][j] <= within)]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.35 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:140] = x[100]  # copies
    x[200:210] = x[200] * np.float32(4)
    return np.arange(1000, 1900), x


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = r.node_id
    return {n: [own[k] for k in sorted(own)] for n, own in out.items()}


def test_recall_and_copies(spark, cloud):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    got, want = lists(nb.nearest(df, 5, 16, probes=16)), brute(ids, x.astype(float), 5)
    assert set(got) == set(want)
    hits = sum(len(set(got[n]) & set(want[n])) for n in want)
    assert hits / (5 * len(want)) >= 0.9
    for n in (1100, 1101, 1139):  # a copy's nearest are the smallest other copies
        assert got[n] == want[n] == [m for m in range(1100, 1107) if m != n][:5]
    assert not any(n in own for n, own in got.items())


def test_every_list_gives_the_exact_result(spark, cloud):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids[:300], x[:300])])
    original = nb.RERANK
    nb.RERANK = 1000
    try:
        assert lists(nb.nearest(df, 4, 16, probes=10_000)) == brute(ids[:300], x[:300].astype(float), 4)
        close = brute(ids[:300], x[:300].astype(float), 4, 0.1)
        pairs = {(min(a, b), max(a, b)) for a, own in close.items() for b in own}
        assert {tuple(r) for r in nb.close_pairs(df, 4, 0.1, 16, 10_000).collect()} == pairs
    finally:
        nb.RERANK = original


def test_blocks(spark, cloud, monkeypatch):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids[:250], x[:250])])
    whole = lists(nb.nearest(df, 4, 16, probes=1000))
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nb, "RERANK", 1000)
    assert lists(nb.nearest(df, 4, 16, probes=1000)) == brute(ids[:250], x[:250].astype(float), 4)
    assert set(whole) == set(int(i) for i in ids[:250])


def test_dirt(spark):
    nan, inf = float("nan"), float("inf")
    one, two = [1, 0, 0], [1, 0.1, 0]
    rows = [(1, one, DAY), (2, two, DAY), (2, [0, 0, 1], DAY - dt.timedelta(1)), (2, two, DAY), (3, [0, 0, 0], DAY), (4, None, DAY), (5, [], DAY),
            (6, [1, 0], DAY), (7, [1, 0, 0, 0], DAY), (8, [1, nan, 0], DAY), (9, [inf, 0, 0], DAY), (None, one, DAY), (10, [0, 1, 0], DAY),
            (10, [nan, 0, 0], DAY + dt.timedelta(5)), (11, [1e30, 0, 0], None)]
    df = make(spark, rows)
    assert sorted(r.node_id for r in nb.current_vectors(df, 3).collect()) == [1, 2, 3, 10, 11]
    assert {tuple(r) for r in nb.close_pairs(df, 10, 0.1, 3).collect()} == {(1, 2), (1, 11), (2, 11)}
    got = lists(nb.nearest(df, 2, 3))
    assert got[3] == [1, 2] and got[1] == [11, 2]
    assert got[10] == [2, 1]  # at distance 1 the smaller node comes first


def test_asked_and_empty(spark, cloud):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids[:120], x[:120])])
    got = lists(nb.nearest(df, 3, 16, asked=F.col("node_id") % 20 == 0))
    assert set(got) == {i for i in range(1000, 1120) if i % 20 == 0}
    assert nb.close_pairs(make(spark, []), 10, 0.1, 16).count() == 0
    assert nb.nearest(make(spark, [(1, [0, 0], DAY), (2, [0, 0], DAY)]), 1, 2).count() == 2


def test_beam_search_beats_greedy_codes(cloud):
    _, x = cloud
    unit = nb._unit(x).astype(np.float32)
    model = nb.AdditiveQuantiser.fit(unit, len(unit))
    own, codes, norm = model.encode(unit)
    near = model.coarse[own] + sum(model.books[m][codes[:, m]] for m in range(nb.RESIDUAL_BOOKS))
    error = ((unit - near) ** 2).sum(1).mean()
    assert error < 0.7 * ((unit - model.coarse[own]) ** 2).sum(1).mean()
    assert np.allclose((near**2).sum(1), norm, atol=1e-5)
    beam, nb.BEAM = nb.BEAM, 1
    try:
        greedy = model._beam(unit - model.coarse[own])
    finally:
        nb.BEAM = beam
    other = model.coarse[own] + sum(model.books[m][greedy[:, m]] for m in range(nb.RESIDUAL_BOOKS))
    assert error <= ((unit - other) ** 2).sum(1).mean() + 1e-9


def test_one_probe_misses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    ids, x = np.arange(2000), rng.normal(size=(2000, 16)).astype(np.float32)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    monkeypatch.setattr(nb, "RERANK", 1)
    monkeypatch.setattr(nb, "HELD", 500, raising=False)
    assert lists(nb.nearest(df, 5, 16, probes=1)) == brute(ids, x.astype(float), 5)
    close = brute(ids, x.astype(float), 5, 0.3)
    pairs = {(min(a, b), max(a, b)) for a, own in close.items() for b in own}
    assert {tuple(r) for r in nb.close_pairs(df, 5, 0.3, 16, 1).collect()} == pairs


def test_scaled_copies_go_by_the_smallest_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    one = rng.integers(-9, 10, 16).astype(np.float32)
    x[::2] = one * rng.integers(1, 90, 200).astype(np.float32)[:, None]
    x[1:400:8] = x[3] * np.float32(1.1) ** np.arange(50, dtype=np.float32)[:, None]  # not exact multiples
    ids = rng.permutation(400)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(float), 5)
    assert lists(nb.nearest(df, 5, 16)) == want
    close = brute(ids, x.astype(float), 5, 0.1)
    pairs = {(min(a, b), max(a, b)) for a, own in close.items() for b in own}
    assert {tuple(r) for r in nb.close_pairs(df, 5, 0.1, 16).collect()} == pairs


def test_two_levels_of_lists(spark, monkeypatch):
    rng = np.random.default_rng(12)
    ids, x = np.arange(3000), rng.normal(size=(3000, 16)).astype(np.float32)
    x[1500:] = x[:1500] + rng.normal(scale=0.1, size=(1500, 16))
    monkeypatch.setattr(nb, "LIST_ROWS", 8)
    unit = nb._unit(x).astype(np.float32)
    model = nb.AdditiveQuantiser.fit(unit, len(unit))
    assert model.split is not None and len(model.coarse) == len(model.parents) * len(model.split)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    assert lists(nb.nearest(df, 5, 16, probes=2)) == brute(ids, x.astype(float), 5)


def test_allowed_misses_stay_few(spark):
    rng = np.random.default_rng(13)
    ids, x = np.arange(4000), rng.normal(size=(4000, 32)).astype(np.float32)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(float), 10)
    got = lists(nb.nearest(df, 10, 32, probes=4, asked=F.col("node_id") % 20 == 0, missing=0.05))
    assert set(got) == {i for i in range(4000) if i % 20 == 0} and all(len(own) == 10 for own in got.values())
    assert sum(len(set(own) & set(want[i])) for i, own in got.items()) >= 0.9 * 10 * len(got)


def test_a_vector_shared_by_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(nb, "HOT", 20)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[:100] = x[0]
    ids = rng.permutation(300)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)])
    assert lists(nb.nearest(df, 4, 8)) == brute(ids, x.astype(float), 4)


def _shuffled(spark):
    """Bytes written to shuffles by all tasks so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    time.sleep(0.3)
    spark.range(1).collect()  # the end of a task brings the figures up to date
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_disk_does_not_grow_with_the_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(15)
    ids, x = np.arange(4000), rng.normal(size=(4000, 64)).astype(np.float32)
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids, x)]).localCheckpoint()
    monkeypatch.setattr(nb, "GROUP_ROWS", 200)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 200)
    before = _shuffled(spark)
    got = nb.nearest(df, 5, 64, probes=4).collect()
    shuffled = _shuffled(spark) - before
    assert len(got) == 5 * len(ids)
    assert 0 < shuffled < 6 * x.nbytes  # each vector in every block would be 20 times


def test_full_blocks_shared_targets_and_joined_copies(spark, cloud, monkeypatch):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids[:300], x[:300])])
    monkeypatch.setattr(nb, "GROUP_ROWS", 100)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)  # fewer rows than the groups hold, which get one block each
    monkeypatch.setattr(nb, "_parts", lambda model, sample, rows: np.ones(int(model.group_of.max()) + 1, np.int64), raising=False)
    monkeypatch.setattr(nb, "TARGETS", 2, raising=False)
    monkeypatch.setattr(nb, "COPIES", 0, raising=False)
    assert lists(nb.nearest(df, 4, 16)) == brute(ids[:300], x[:300].astype(float), 4)


def test_nobody_asks(spark, cloud):
    ids, x = cloud
    df = make(spark, [(int(i), v, DAY) for i, v in zip(ids[:120], x[:120])])
    for missing in (0.0, 0.05):
        assert nb.nearest(df, 3, 16, asked=F.col("node_id") < 0, missing=missing).count() == 0
