from __future__ import annotations

import pytest

from graphloom.llm import mixing

DOCS, TARGETS = "doc_id bigint, text string, source string, tokens string, size int", "source string, weight double, max_repeats int, text string"


def mix(spark, docs, targets, **more):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], DOCS)
    t = spark.createDataFrame([(*x, "clash") for x in targets], TARGETS)
    return mixing.mix(d, t, **more)


def report(m):
    return {r.source: r for r in m.report.collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "word " * 10, "Big ") for i in range(300)] + [(1000 + i, "word " * 10, " small") for i in range(10)]
    docs += [(2000 + i, "word " * 10, None) for i in range(90)] + [(3000, None, "big"), (3001, "", "big")]
    m = mix(spark, docs, [("big", 0.5, 1), ("SMALL", 0.05, 2), ("gone", 0.05, 9), ("big2", None, None)])
    got = report(m)
    total = sum(r.size for r in got.values()) + 90 * got["small"].size / 10
    assert got["big"].size == 30 * got["small"].size
    assert [got[s].short for s in ("big", "small", "gone", "big2")] == [False, False, True, False]
    per_doc = got["small"].size / 10
    for s in ("big", "small"):
        assert got[s].demand <= got[s].used < got[s].demand + per_doc
        assert abs(got[s].demand / total - got[s].weight) < 1e-9
    assert got["gone"].size == got["gone"].used == 0
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    order = m.order.collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert all(0 <= r.position <= 1 for r in order)
    uses = {}
    for r in order:
        uses[r.source, r.doc_id] = uses.get((r.source, r.doc_id), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "big") == 1
    assert max(n for (s, _), n in uses.items() if s == "small") == 2


def test_a_cap_leaves_a_source_short(spark):
    docs = [(i, "a b c d", "x") for i in range(10)] + [(100 + i, "a b c d", "y") for i in range(90)]
    got = report(mix(spark, docs, [("x", 0.5, 2), ("y", 0.5, 1)]))
    assert got["x"].short and got["x"].used == 2 * got["x"].size
    assert not got["y"].short


def test_a_schedule_moves_a_source(spark):
    docs = [(i, "one two three", "x") for i in range(200)] + [(1000 + i, "one two three", "y") for i in range(200)]
    m = mix(spark, docs, [("x", 0.4, 1), ("y", 0.4, 1)], schedule={"x": [(0.0, 1.0), (1.0, 0.0)], "y": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]})
    rows = m.order.collect()
    mean = lambda s: sum(r.position for r in rows if r.source == s) / sum(r.source == s for r in rows)
    assert abs(mean("x") - 1 / 3) < 0.02  # a falling line
    assert abs(mean("y") - 5 / 6) < 0.02  # a rising line over the second half
    got = report(m)
    assert all(got[s].used >= got[s].demand for s in ("x", "y"))
    with pytest.raises(ValueError, match="nowhere positive"):
        mix(spark, docs, [("x", 0.4, 1)], schedule={"x": [(0.0, 0.0), (1.0, 0.0)]})


def test_tokens_of_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "hello world", "A"), (2, "x" * 200_000, None), (3, None, "b")], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in mixing.token_sizes(df).collect()}
    assert got[1] == ("a", 2) and got[3] == ("b", 0) and got[2][1] > 1000


def test_empty(spark):
    m = mix(spark, [], [("x", 1.0, 1)])
    assert m.order.count() == 0 and report(m)["x"].size == 0
    assert mix(spark, [(1, "a", "x")], []).report.count() == 0


def test_slices_keep_to_the_schedule(spark):
    docs = [(i, "one two three four", "x") for i in range(300)] + [(1000 + i, "one two", "y") for i in range(300)]
    targets = spark.createDataFrame([("x", 0.5, 1), (" Y ", 0.1, 1), ("z", 0.4, 1)], "source string, weight double, max_repeats int")
    schedule = mixing.opposing_ramps(targets)
    assert list(schedule) == ["x", "y", "z"] and schedule["x"][0][1] < schedule["x"][1][1] and schedule["y"][0][1] > schedule["y"][1][1]
    kept = mixing.adherence(mix(spark, docs, [("x", 0.5, 1), ("y", 0.1, 1), ("z", 0.4, 1)], schedule=schedule), schedule).collect()
    assert len(kept) == 20 and all(r.kept for r in kept)
    assert abs(sum(r.planned for r in kept if r.source == "x") - 1) < 1e-6
    other = {"x": [(0.0, 1.5), (1.0, 0.5)], "y": [(0.0, 0.5), (1.0, 1.5)]}
    assert not all(r.kept for r in mixing.adherence(mix(spark, docs, [("x", 0.5, 1), ("y", 0.1, 1)], schedule=schedule), other).collect())
