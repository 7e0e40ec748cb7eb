from __future__ import annotations

import json

from graphloom.operators import schema_drift as sd

DDL = "body_id bigint, feed string, file_no int, node_id bigint, label string, labels array<string>, props string, received_at timestamp_ntz, seq string, path string"


def make(spark, bodies):
    full = [(b, f, n, node, label, labels, p if p is None or isinstance(p, str) else json.dumps(p), None, "clash", "clash") for b, f, n, node, label, labels, p in bodies]
    return spark.createDataFrame(full, DDL)


def bodies(feed, file_no, props_of, first, label="Person", nodes=range(10)):
    return [(first + i, feed, file_no, n, label, None, props_of(n)) for i, n in enumerate(nodes)]


def changes(spark, rows_):
    got = sd.trace(make(spark, rows_)).changes.collect()
    return sorted((r.feed, r.file_no, r.change, r.old_name, r.new_name) for r in got)


def test_every_kind_of_change(spark):
    data = bodies("f", 1, lambda n: {"birth": n, "name": f"n{n}", "geo": {"lat": n / 2}, "old": 100 - n, "score": n}, 0)
    data += bodies("f", 5, lambda n: {"yob": n, "name": f"n{n}", "latitude": n / 2, "fresh": -n - 1, "score": n + 0.5}, 100, label="Human")
    assert changes(spark, data) == [
        ("f", 5, "added", "", "fresh"),
        ("f", 5, "relabelled", "Person", "Human"),
        ("f", 5, "removed", "old", ""),
        ("f", 5, "renamed", "birth", "yob"),
        ("f", 5, "renamed", "geo.lat", "latitude"),
        ("f", 5, "type_changed", "score", "score"),
    ]


def test_presence_and_majorities(spark):
    # One of five records is enough; one of six is not. Nulls count for presence, not for the type.
    data = bodies("f", 1, lambda n: {"a": 1}, 0, nodes=range(6))
    data += bodies("f", 2, lambda n: {"a": 1} | ({"few": 1} if n == 0 else {}) | ({"more": None} if n < 2 else {}), 10, nodes=range(6))
    assert changes(spark, data) == [("f", 2, "added", "", "more")]
    data = bodies("f", 1, lambda n: {"a": 1}, 0, nodes=range(5)) + bodies("f", 2, lambda n: {"a": "x" if n < 3 else 1}, 10, nodes=range(5))
    assert changes(spark, data) == [("f", 2, "type_changed", "a", "a")]


def test_dirt(spark):
    data = bodies("f", 1, lambda n: {"a": n}, 0)
    data += data[:4]  # the same bodies again
    data += bodies("f", 2, lambda n: {"a": n, "b": n}, 50)
    data += [(90, "f", 2, None, None, [], None), (91, "f", 2, 3, None, ["Person"], "not json"), (92, "f", 2, 3, "Person", None, "[1]"), (93, "f", 2, 3, None, None, '{"a": 1')]
    data += [(None, "f", 2, 1, "X", None, "{}"), (95, None, 2, 1, "X", None, "{}"), (96, "f", None, 1, "X", None, "{}")]
    assert changes(spark, data) == [("f", 2, "added", "", "b")]


def test_numbers_compare_by_value_and_feeds_stay_apart(spark):
    data = bodies("f", 1, lambda n: {"a": n}, 0) + bodies("f", 2, lambda n: {"b": float(n)}, 20)
    data += bodies("g", 1, lambda n: {"a": n}, 40) + bodies("g", 2, lambda n: {"b": n + 1}, 60)
    assert changes(spark, data) == [("f", 2, "renamed", "a", "b"), ("g", 2, "added", "", "b"), ("g", 2, "removed", "a", "")]


def test_a_hot_feed_and_long_values(spark):
    long = "y" * 200_000
    data = []
    for k in range(12):
        data += bodies("hot", k, lambda n, k=k: {f"p{k // 3}": f"{long}{n}", "x": n}, 1000 * k, nodes=range(6))
    assert changes(spark, data) == [("hot", k, "renamed", f"p{k // 3 - 1}", f"p{k // 3}") for k in (3, 6, 9)]


def test_empty(spark):
    drift = sd.trace(make(spark, []))
    assert drift.changes.count() == 0 and sd.consistent_table(make(spark, []), drift).count() == 0


def test_consistent_table(spark):
    data = bodies("f", 1, lambda n: {"birth": n, "note": "a"}, 0, nodes=range(3))
    data += bodies("f", 2, lambda n: {"yob": n, "note": "a"}, 10, nodes=range(3))
    data += bodies("f", 3, lambda n: {"born": n + 0.0, "note": n}, 20, nodes=range(3))
    table = {r.body_id: r.props for r in sd.consistent_table(make(spark, data)).collect()}
    assert len(table) == 9
    for n in range(3):
        for base in (0, 10, 20):
            assert set(table[base + n]) == {"born", "note"}
            assert table[base + n]["born"].kind == "float" and float(table[base + n]["born"].text) == n
        assert table[n]["note"].kind == "integer" and table[n]["note"].text is None  # "a" is no integer
        assert table[n]["note"].stray == "a" and table[20 + n]["note"].stray is None
        assert table[20 + n]["note"].text == str(n)


def test_flooding_prefers_like_structure():
    a = sd.SchemaGraph([("geo.lon", "float"), ("geo.lat", "float"), ("title", "string")])
    b = sd.SchemaGraph([("place.longitude", "float"), ("place.latitude", "float"), ("heading", "string")])
    (s,), settled = sd.flood([(a, b)])
    assert settled
    at = lambda g, n: g.names.index(("property", n))
    assert s[at(a, "geo.lon"), at(b, "place.longitude")] > s[at(a, "geo.lon"), at(b, "heading")]
    assert s[at(a, "title"), at(b, "heading")] > s[at(a, "title"), at(b, "place.latitude")]


def test_renames_between_unlike_names_with_look_alike_rivals(spark):
    same = {f"property_{i}": i for i in range(8)}
    data = bodies("f", 1, lambda n: same | {"city": f"c{n}", "home_town": n}, 0)
    data += bodies("f", 2, lambda n: same | {"hometown": f"c{n}", "city_": n}, 100)
    assert changes(spark, data) == [("f", 2, "renamed", "city", "hometown"), ("f", 2, "renamed", "home_town", "city_")]
    data = bodies("f", 1, lambda n: same | {"city": f"c{n}", "home_town": n}, 0)
    data += bodies("f", 2, lambda n: same | {"hometown": f"c{n}", "city_": -n - 1}, 100)
    data += bodies("g", 1, lambda n: same | {"city": n, "home.town": f"c{n}", "home.x": 1}, 200)
    data += bodies("g", 2, lambda n: same | {"home.towns": n / 1, "citys": f"c{n}", "home.x": 1}, 300)
    assert [c for c in changes(spark, data) if c[2] == "renamed"] == [
        ("f", 2, "renamed", "city", "hometown"),
        ("g", 2, "renamed", "city", "home.towns"),
        ("g", 2, "renamed", "home.town", "citys"),
    ]


def test_flooding_proposes_and_the_rest_is_compared(spark):
    same = {f"property_{i}": i for i in range(4)}
    data = bodies("f", 1, lambda n: same | {"city": f"c{n}", "gone": n, "flag": True}, 0, nodes=range(40))
    data += bodies("f", 2, lambda n: same | {"town": f"c{n}", "fresh": -n - 1, "on": True, "open": n != 3}, 100, nodes=range(40))
    drift = sd.trace(make(spark, data))
    pairs = {(r.old_name, r.new_name): r for r in drift.candidates.collect()}
    assert len(pairs) == 12 and all(r.settled for r in pairs.values())
    proposed = {k for k, r in pairs.items() if r.proposed}
    assert ("city", "town") in proposed and ("gone", "fresh") not in proposed and len(proposed) <= 3
    # One old flag has two successors with equal values: both count, though only one of them is a one-to-one choice.
    renamed = {(r.old_name, r.new_name) for r in drift.renames.collect()}
    assert renamed == {("city", "town"), ("flag", "on"), ("flag", "open")}


def test_exact_integers():
    assert sd._cast("string", "9007199254740993", "integer") == "9007199254740993"
    assert sd._cast("float", "2.5", "integer") is None and sd._cast("string", "2.0", "integer") == "2"
