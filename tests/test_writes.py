from __future__ import annotations

import pytest

from graphloom.operators import search
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.syntax import QueryError
from graphloom.sources import bulk


@pytest.fixture(scope="module")
def base(spark):
    return PropertyGraph(spark).execute(
        "CREATE (a:Person {name: 'Ada', age: 36})-[:KNOWS {since: 2001}]->(b:Person {name: 'Bob', age: 41}), (a)-[:LIKES]->(:Robot {name: 'Eve'})"
    ).graph


def ask(graph, query):
    return [tuple(r) for r in graph.query(query).collect()]


def names(graph, label):
    return [n for (n,) in ask(graph, f"MATCH (n:{label}) RETURN n.name AS n ORDER BY n")]


def test_create(base):
    assert names(base, "Person") == ["Ada", "Bob"]
    assert ask(base, "MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, r.since AS s, b.name AS b") == [("Ada", 2001, "Bob")]
    with pytest.raises(QueryError):
        base.execute("CREATE (a)-[:X|Y]->(b)")
    with pytest.raises(QueryError):
        base.execute("CREATE (a)-[:X]-(b)")


def test_set_and_remove(base):
    out = base.execute("MATCH (a {name: 'Ada'}) SET a.age = a.age + 1, a.city = 'oslo', a:Admin:Old RETURN a.age AS age, a.city AS c, labels(a) AS l")
    assert [tuple(r) for r in out.df.collect()] == [(37, "oslo", ["Person", "Admin", "Old"])]
    assert ask(out.graph, "MATCH (a:Admin) RETURN a.age AS age, a.city AS c") == [(37, "oslo")]
    less = out.graph.execute("MATCH (a:Admin) REMOVE a.city, a:Old SET a.age = null").graph
    assert ask(less, "MATCH (a:Admin) RETURN a.age AS age, a.city AS c, labels(a) AS l") == [(None, None, ["Person", "Admin"])]
    assert ask(base, "MATCH (a {name: 'Ada'}) RETURN a.age AS age") == [(36,)]  # the old graph is as it was
    rel = base.execute("MATCH ()-[r:KNOWS]->() SET r.since = 1999.5").graph
    assert ask(rel, "MATCH ()-[r:KNOWS]->() RETURN r.since AS s") == [(1999.5,)]


def test_merge(base):
    out = base.execute("UNWIND ['Bob', 'Cal', 'Cal'] AS x MERGE (p:Person {name: x}) ON CREATE SET p.made = true ON MATCH SET p.seen = 1 RETURN p.name AS n, p.made AS m ORDER BY n")
    assert [tuple(r) for r in out.df.collect()] == [("Bob", None), ("Cal", True), ("Cal", True)]
    assert names(out.graph, "Person") == ["Ada", "Bob", "Cal"]
    both = "MATCH (a:Person {name: 'Ada'}), (b:Person {name: 'Bob'}) MERGE (a)-[r:KNOWS]->(b)"
    assert base.execute(both).graph.edge_count() == 2
    assert base.execute(both.replace("(a)-[r:KNOWS]->(b)", "(b)-[r:KNOWS]->(a)")).graph.edge_count() == 3


def test_delete(base):
    with pytest.raises(QueryError, match="DETACH"):
        base.execute("MATCH (n:Robot) DELETE n")
    gone = base.execute("MATCH (n:Robot) DETACH DELETE n").graph
    assert (gone.node_count(), gone.edge_count()) == (2, 1)
    assert base.execute("MATCH (a)-[r]->(n:Robot) DELETE r, n").graph.node_count() == 2
    assert base.execute("MATCH (n:Nobody) DELETE n").graph.node_count() == 3


def test_foreach_and_atomicity(base):
    more = base.execute("FOREACH (x IN [1, 2, 3] | CREATE (:Num {v: x}))").graph
    assert ask(more, "MATCH (n:Num) RETURN count(*) AS n, sum(n.v) AS s") == [(3, 6)]
    ruled = more.execute("CREATE CONSTRAINT FOR (n:Num) REQUIRE n.v IS UNIQUE; CREATE CONSTRAINT FOR (n:Num) REQUIRE n.v IS NOT NULL").graph
    for bad in ("CREATE (:Num {v: 4}), (:Num {v: 1})", "CREATE (:Num)", "CREATE (:Num {v: 3.0})"):
        with pytest.raises(QueryError):
            ruled.execute(bad)
    assert ruled.execute("CREATE (:Num {v: 4})").graph.node_count() == 7
    with pytest.raises(QueryError):
        base.execute("CREATE CONSTRAINT FOR (n:Robot) REQUIRE n.age IS NOT NULL")
    dropped = ruled.execute("DROP CONSTRAINT FOR (n:Num) REQUIRE n.v IS UNIQUE").graph
    assert dropped.execute("CREATE (:Num {v: 1})").graph.node_count() == 7


def test_writes_are_seen_after_the_statement(base):
    assert base.execute("CREATE (a:Foo) WITH a MATCH (m:Foo) RETURN count(m) AS n").df.collect()[0]["n"] == 0


@pytest.mark.parametrize("form", ["jsonl", "csv", "parquet"])
def test_export_and_import(spark, base, tmp_path, form):
    graph = base.execute("CREATE (:Note {text: 'a, \"b\"'})").graph.execute("CREATE CONSTRAINT FOR (n:Person) REQUIRE n.name IS UNIQUE").graph
    graph.execute(f"EXPORT DATABASE '{tmp_path}/{form}' WITH {{format: '{form}'}}")
    back = PropertyGraph(spark).execute(f"IMPORT DATABASE '{tmp_path}/{form}'").graph
    query = "MATCH (n) OPTIONAL MATCH (n)-[r]->(m) RETURN labels(n) AS l, n.name AS n, n.age AS a, n.text AS t, type(r) AS r, m.name AS m"
    assert sorted(ask(back, query), key=str) == sorted(ask(graph, query), key=str)
    assert len(back.constraints) == 1


def test_copy(spark, tmp_path):
    (tmp_path / "p.csv").write_text('_id,name,age,tags\n10,"x, y",3,"[""a""]"\n20,,4,\n')
    (tmp_path / "e.jsonl").write_text('{"_from": 10, "_to": 20, "_etype": "K", "w": 1.5}\n{"_from": 20, "_to": 20}\n')
    (tmp_path / "bad.csv").write_text("from,to\n1,2\n")
    graph = PropertyGraph(spark)
    out = graph.execute(f"COPY Person FROM '{tmp_path}/p.csv'")
    assert [tuple(r) for r in out.df.collect()] == [("Person", "nodes", 2)]
    out = out.graph.execute(f"COPY LINK FROM '{tmp_path}/e.jsonl'")
    assert [tuple(r) for r in out.df.collect()] == [("LINK", "relationships", 2)]
    got = ask(out.graph, "MATCH (a:Person)-[r]->(b) RETURN a.name AS a, a.age AS n, a.tags AS g, type(r) AS t, r.w AS w, b.age AS b")
    assert sorted(got, key=str) == sorted([("x, y", 3, ["a"], "K", 1.5, 4), (None, 4, None, "LINK", None, 4)], key=str)
    with pytest.raises(QueryError, match="_from"):
        graph.execute(f"COPY X FROM '{tmp_path}/bad.csv'")
    (tmp_path / "broken.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match=".+"):
        graph.execute(f"COPY X FROM '{tmp_path}/broken.jsonl'")


def test_snapshot_and_search_indexes(spark, base, tmp_path):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "node_id bigint, embedding array<double>")
    graph = search.upsert_vectors(base, vectors)
    bulk.save(graph, f"{tmp_path}/s")
    back = bulk.load(spark, f"{tmp_path}/s")
    assert (back.node_count(), back.edge_count(), back.vectors.count()) == (3, 2, 2)
    with pytest.raises(Exception, match=".+"):
        bulk.save(graph, f"{tmp_path}/s")
    indexed = base.execute("CREATE INDEX FOR (n:Person) ON (n.name)").graph
    assert search.text_indexes(indexed) == [("Person", "name", "en")]
    assert [r.node for r in search.text_search(indexed, "bob").collect()] == [1]
    assert search.text_indexes(indexed.execute("DROP INDEX FOR (n:Person) ON (n.name)").graph) == []
