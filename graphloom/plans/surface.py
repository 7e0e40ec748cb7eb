"""Queries over writes, definitions, import and export, and the rest of the surface, with their SQL counterparts.

They run on the places graph: regions, nations and suppliers, small enough to be rewritten by every query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import search, traversal
from graphloom.operators.durable import shared_folder
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.syntax import QueryError
from graphloom.sources import bulk
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


@lru_cache(maxsize=8)
def places(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations and suppliers with the identifiers of the commerce graph."""
    c = F.col
    region, nation, supplier = (table(spark, folder, n) for n in ("region", "nation", "supplier"))
    big = lambda x: x.cast("bigint")
    return (
        PropertyGraph(spark)
        .with_nodes(region.select(big(c("r_regionkey")).alias("id"), c("r_name").alias("name")), "Region")
        .with_nodes(nation.select((big(c("n_nationkey")) + 1_000).alias("id"), c("n_name").alias("name")), "Nation")
        .with_nodes(supplier.select((big(c("s_suppkey")) + 10_000_000).alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("acctbal")), "Supplier")
        .with_edges(nation.select(big(c("n_nationkey")).alias("id"), (big(c("n_nationkey")) + 1_000).alias("src"), big(c("n_regionkey")).alias("dst")), "IN_REGION", "Nation", "Region")
        .with_edges(
            supplier.select((big(c("s_suppkey")) + 1_000).alias("id"), (big(c("s_suppkey")) + 10_000_000).alias("src"), (big(c("s_nationkey")) + 1_000).alias("dst")),
            "FROM_NATION",
            "Supplier",
            "Nation",
        )
    )


def _ask(name: str, text: str, sql: str, **params) -> None:
    QUERIES[name] = lambda spark, folder: places(spark, folder).query(text, **params)
    SQL[name] = sql


def _change(name: str, change: str, text: str | None, sql: str) -> None:
    """A writing query, and what the new graph then answers to `text` (or what the writing query itself returns)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = places(spark, folder).execute(change)
        return out.df if text is None else out.graph.query(text)

    QUERIES[name] = run
    SQL[name] = sql


def _call(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


# ---- writes -------------------------------------------------------------------------

_change("write_create", "MATCH (r:Region) CREATE (o:Office {name: r.name})-[:SITS_IN {since: 2000}]->(r)",
        "MATCH (o:Office)-[s:SITS_IN]->(r:Region) RETURN o.name AS o, s.since AS since, id(r) AS r", "SELECT r_name AS o, CAST(2000 AS BIGINT) AS since, CAST(r_regionkey AS BIGINT) AS r FROM region")
_change("write_create_return", "MATCH (n:Nation) CREATE (h:Hub {code: n.name + '!'}) RETURN h.code AS code, labels(h) AS l", None, "SELECT n_name || '!' AS code, ['Hub'] AS l FROM nation")
_change("write_merge", "MATCH (s:Supplier)-[:FROM_NATION]->(n:Nation) MERGE (m:Market {name: n.name}) ON CREATE SET m.made = true ON MATCH SET m.seen = true",
        "MATCH (m:Market) RETURN m.name AS name, m.made AS made, count(*) AS n", "SELECT DISTINCT n_name AS name, true AS made, CAST(1 AS BIGINT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_change("write_merge_match", "UNWIND ['AMERICA', 'ELSEWHERE'] AS x MERGE (r:Region {name: x}) ON CREATE SET r.made = 1 ON MATCH SET r.seen = 1",
        "MATCH (r:Region) RETURN r.name AS name, r.made AS made, r.seen AS seen", """
SELECT r_name AS name, CAST(NULL AS BIGINT) AS made, CASE WHEN r_name = 'AMERICA' THEN CAST(1 AS BIGINT) END AS seen FROM region
UNION ALL SELECT 'ELSEWHERE', 1, NULL UNION ALL SELECT 'AMERICA', 1, NULL WHERE NOT EXISTS (FROM region WHERE r_name = 'AMERICA')""")  # fmt: skip
_change("write_merge_relationship", "MATCH (s:Supplier)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) MERGE (r)-[:HOSTS]->(n)",
        "MATCH (r:Region)-[:HOSTS]->(n:Nation) RETURN r.name AS r, n.name AS n", "SELECT DISTINCT r_name AS r, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_change("write_set", "MATCH (s:Supplier) WHERE s.acctbal < 0 SET s.debt = -s.acctbal, s:Debtor", "MATCH (d:Debtor) RETURN id(d) AS id, d.debt AS debt, labels(d) AS l",
        "SELECT s_suppkey + 10000000 AS id, -s_acctbal AS debt, ['Supplier', 'Debtor'] AS l FROM supplier WHERE s_acctbal < 0")
_change("write_set_return", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) SET n.region = r.name RETURN n.name AS name, n.region AS region", None,
        "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_change("write_set_relationship", "MATCH (s:Supplier)-[f:FROM_NATION]->() SET f.weight = s.acctbal * 2", "MATCH ()-[f:FROM_NATION]->(n) RETURN n.name AS n, round(sum(f.weight), 4) AS w",
        "SELECT n_name AS n, round(sum(s_acctbal * 2), 4) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
_change("write_remove", "MATCH (s:Supplier) WHERE s.acctbal < 0 REMOVE s.acctbal, s:Supplier SET s:Closed", "MATCH (s) WHERE s:Supplier OR s:Closed RETURN labels(s) AS l, count(*) AS n, count(s.acctbal) AS k", """
SELECT CASE WHEN s_acctbal < 0 THEN ['Closed'] ELSE ['Supplier'] END AS l, count(*) AS n, count(CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END) AS k FROM supplier GROUP BY 1""")  # fmt: skip
_change("write_delete", "MATCH (:Supplier)-[f:FROM_NATION]->(n:Nation) WHERE id(n) < 1010 DELETE f", "MATCH (:Supplier)-[f:FROM_NATION]->(n:Nation) RETURN n.name AS n, count(*) AS k",
        "SELECT n_name AS n, count(*) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey >= 10 GROUP BY 1")
_change("write_detach_delete", "MATCH (n:Nation) WHERE id(n) < 1010 DETACH DELETE n", "MATCH (n) OPTIONAL MATCH (n)-[r]->() RETURN labels(n) AS l, count(*) AS n, count(r) AS r", """
SELECT ['Region'] AS l, count(*) AS n, CAST(0 AS BIGINT) AS r FROM region UNION ALL SELECT ['Nation'], count(*), count(*) FROM nation WHERE n_nationkey >= 10
UNION ALL SELECT ['Supplier'], count(*), count(*) FILTER (s_nationkey >= 10) FROM supplier""")  # fmt: skip
_change("write_foreach", "MATCH (r:Region) WITH collect(r.name) AS names FOREACH (x IN names | CREATE (:Tag {name: x}))", "MATCH (t:Tag) RETURN t.name AS name", "SELECT r_name AS name FROM region")
_change("write_pipeline", "CREATE (:Counter {v: 1}); MATCH (c:Counter) SET c.v = c.v + 41; MATCH (c:Counter), (r:Region) RETURN r.name AS r, c.v AS v", None, "SELECT r_name AS r, CAST(42 AS BIGINT) AS v FROM region")


@_call("write_isolation", "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM supplier")
def _isolation(spark, folder):
    old = places(spark, folder)
    new = old.execute("MATCH (s:Supplier) DETACH DELETE s").graph
    n = lambda g: g.query("MATCH (s:Supplier) RETURN count(*) AS n").first()[0]
    return spark.createDataFrame([(n(old), n(new))], "before bigint, after bigint")


# ---- definitions, validation, plans ---------------------------------------------------


@_call("ddl_constraints", """
SELECT 'unique' AS kind, 'Nation' AS label, 'name' AS prop, (SELECT count(*) > count(DISTINCT n_name) FROM nation) AS refused, true AS guards
UNION ALL SELECT 'required', 'Supplier', 'acctbal', (SELECT count(*) > count(s_acctbal) FROM supplier), true
UNION ALL SELECT 'required', 'Nation', 'capital', true, false""")
def _constraints(spark, folder):
    graph, rows = places(spark, folder), []
    for kind, label, prop, rule, breach in (
        ("unique", "Nation", "name", "IS UNIQUE", "MATCH (n:Nation) WITH n LIMIT 1 CREATE (:Nation {name: n.name})"),
        ("required", "Supplier", "acctbal", "IS NOT NULL", "CREATE (:Supplier {name: 'x'})"),
        ("required", "Nation", "capital", "IS NOT NULL", None),
    ):
        refused = guards = False
        try:
            ruled = graph.execute(f"CREATE CONSTRAINT FOR (x:{label}) REQUIRE x.{prop} {rule}").graph
            try:
                ruled.execute(breach)
            except QueryError:
                guards = len(ruled.constraints) == 1
        except QueryError:
            refused = True
        rows.append((kind, label, prop, refused, guards))
    return spark.createDataFrame(rows, "kind string, label string, prop string, refused boolean, guards boolean")


@_call("ddl_index", "SELECT r_regionkey::BIGINT AS node FROM region WHERE r_name = 'AMERICA'")
def _index(spark, folder):
    graph = places(spark, folder).execute("CREATE INDEX FOR (r:Region) ON (r.name)").graph
    if search.text_indexes(graph) != [("Region", "name", "en")] or search.text_indexes(graph.execute("DROP INDEX FOR (r:Region) ON (r.name)").graph):
        raise AssertionError("the index is not listed or not dropped")
    return search.text_search(graph, "america", 5).select("node")


_BAD = [
    "MATCH (n) RETURN m", "MATCH (n) RETURN sum(sum(1))", "MATCH (n) RETURN n.name AS a, n.name AS a", "RETURN 1 AS a UNION RETURN 1 AS b", "RETURN nothing(1)",
    "MATCH (n) WITH n.name RETURN 1 AS a", "MATCH (n) RETURN count(*) AS n SKIP -1", "CREATE (a)-[:X]-(b)",
]


@_call("static_validation", f"SELECT CAST(i AS INTEGER) AS i, true AS refused FROM range({len(_BAD)}) t(i)")
def _validation(spark, folder):
    rows = []
    for i, text in enumerate(_BAD):
        try:
            places(spark, folder).execute(text)
            rows.append((i, False))
        except QueryError:
            rows.append((i, True))
    return spark.createDataFrame(rows, "i int, refused boolean")


@_call("explain_plan", "SELECT true AS clauses, true AS scan, true AS pushed")
def _explain(spark, folder):
    text = places(spark, folder).explain("MATCH (s:Supplier) WHERE s.acctbal > 100.0 RETURN count(*) AS n")
    return spark.createDataFrame([("Match" in text and "Return" in text, "Scan parquet" in text, "GreaterThan(s_acctbal" in text)], "clauses boolean, scan boolean, pushed boolean")


# ---- import, export, snapshots ---------------------------------------------------------

_WHOLE = "MATCH (n) OPTIONAL MATCH (n)-[r]->(m) RETURN labels(n) AS l, n.name AS n, n.acctbal AS a, type(r) AS t, m.name AS m"
_WHOLE_SQL = """
SELECT ['Region'] AS l, r_name AS n, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS VARCHAR) AS m FROM region
UNION ALL SELECT ['Nation'], n_name, NULL, 'IN_REGION', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT ['Supplier'], s_name, s_acctbal, 'FROM_NATION', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _round_trip(form: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        target = _scratch(spark)
        places(spark, folder).execute(f"EXPORT DATABASE '{target}' WITH {{format: '{form}'}}")
        return PropertyGraph(spark).execute(f"IMPORT DATABASE '{target}'").graph.query(_WHOLE)

    return run


for _form in ("parquet", "jsonl", "csv"):
    QUERIES[f"export_import_{_form}"] = _round_trip(_form)
    SQL[f"export_import_{_form}"] = _WHOLE_SQL


@_call("snapshot_restore", _WHOLE_SQL)
def _snapshot(spark, folder):
    target = _scratch(spark)
    bulk.save(places(spark, folder), target)
    return bulk.load(spark, target).query(_WHOLE)


@_call("copy_relationships", "SELECT n_name AS n, r_name AS r, CAST(n_nationkey * 1.5 AS DOUBLE) AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def _copy_relationships(spark, folder):
    target, nation, region = _scratch(spark), table(spark, folder, "nation"), table(spark, folder, "region")
    region.select(F.col("r_regionkey").alias("_id"), F.lit('["Region"]').alias("_labels"), F.col("r_name").alias("name")).write.option("header", True).option("escape", '"').csv(f"{target}/regions.csv")
    nation.select((F.col("n_nationkey") + 1_000).alias("_id"), F.col("n_name").alias("name")).write.json(f"{target}/nations.jsonl")
    edge = nation.select((F.col("n_nationkey") + 1_000).alias("_from"), F.col("n_regionkey").alias("_to"), (F.col("n_nationkey") * 1.5).alias("w"))
    edge.write.option("header", True).csv(f"{target}/edges.csv")
    graph = PropertyGraph(spark)
    for name, label in (("regions.csv", "Place"), ("nations.jsonl", "Nation"), ("edges.csv", "LIES_IN")):
        graph = graph.execute(f"COPY {label} FROM '{target}/{name}'").graph
    return graph.query("MATCH (n:Nation)-[e:LIES_IN]->(r:Region) RETURN n.name AS n, r.name AS r, e.w AS w")


@_call("copy_is_atomic", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS nodes, true AS refused")
def _atomic(spark, folder):
    target = _scratch(spark)
    spark.createDataFrame([('{"name": "a"}',), ('{"name": ',)], "value string").coalesce(1).write.text(f"{target}/bad.jsonl")
    graph, refused = places(spark, folder), False
    try:
        graph.execute(f"COPY Region FROM '{target}/bad.jsonl' WITH {{format: 'jsonl'}}")
    except Exception:  # noqa: BLE001
        refused = True
    return spark.createDataFrame([(graph.node_count(), refused)], "nodes bigint, refused boolean")


# ---- expressions -----------------------------------------------------------------------

_ask("label_predicate", "MATCH (n) WHERE n:Nation OR n:Region RETURN labels(n) AS l, count(*) AS n", "SELECT ['Nation'] AS l, count(*) AS n FROM nation UNION ALL SELECT ['Region'], count(*) FROM region")
_ask("precedence", "RETURN 2 + 3 * 4 - 6 / 4 AS a, NOT false AND false AS b, true OR true AND false AS c, 2 ^ 3 * 2 AS d, 1 < 2 = true AS e, -3 + 5 AS f, 7 % 4 * 2 AS g",
     "SELECT CAST(13 AS BIGINT) AS a, false AS b, true AS c, CAST(16 AS DOUBLE) AS d, false AS e, CAST(2 AS BIGINT) AS f, CAST(6 AS BIGINT) AS g")
_ask("properties_keys", "MATCH (s:Supplier) RETURN id(s) AS id, keys(s) AS k, properties(s).name AS name, size(keys(s)) AS n",
     "SELECT s_suppkey + 10000000 AS id, ['acctbal', 'name'] AS k, s_name AS name, CAST(2 AS BIGINT) AS n FROM supplier")
_ask("relationship_ends", "MATCH (s:Supplier)-[r:FROM_NATION]->(n:Nation) RETURN startNode(r).name AS s, endNode(r).name AS e", "SELECT s_name AS s, n_name AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_ask("relationship_ends_later", "MATCH (:Supplier)-[r:FROM_NATION]->() WITH r RETURN startNode(r).name AS s, endNode(r).name AS e", "SELECT s_name AS s, n_name AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_ask("path_nodes_props", "MATCH p = (:Supplier)-[:FROM_NATION]->(:Nation)-[:IN_REGION]->(:Region) RETURN [x IN nodes(p) | x.name] AS names, [r IN relationships(p) | type(r)] AS types, length(p) AS l",
     "SELECT [s_name, n_name, r_name] AS names, ['FROM_NATION', 'IN_REGION'] AS types, CAST(2 AS BIGINT) AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_ask("path_relationship_list", "MATCH (s:Supplier)-[r*2]->(x:Region) RETURN s.name AS s, [q IN r | type(q)] AS types, x.name AS x",
     "SELECT s_name AS s, ['FROM_NATION', 'IN_REGION'] AS types, r_name AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_ask("link_functions", """MATCH (a:Supplier)-[:FROM_NATION]->(:Nation)<-[:FROM_NATION]-(b:Supplier) WHERE id(a) < id(b)
RETURN id(a) AS a, id(b) AS b, link.commonNeighbors(a, b) AS c, link.jaccard(a, b) AS j, round(link.adamicAdar(a, b), 8) AS aa, round(link.resourceAllocation(a, b), 8) AS ra, link.preferentialAttachment(id(a), id(b)) AS p""", """
WITH d AS (SELECT s_nationkey AS k, count(*) + 1 AS d FROM supplier GROUP BY 1)
SELECT x.s_suppkey + 10000000 AS a, y.s_suppkey + 10000000 AS b, 1.0::DOUBLE AS c, 1.0::DOUBLE AS j, round(1 / ln(d), 8) AS aa, round(1 / d, 8) AS ra, 1.0::DOUBLE AS p
FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey JOIN d ON k = x.s_nationkey""")  # fmt: skip
_ask("null_functions", "MATCH (s:Supplier) RETURN id(s) AS id, coalesce(null, s.name, 'x') AS c, exists(s.acctbal) AS e, isNull(s.acctbal) AS i, isNotNull(s.name) AS k, min(s.acctbal, 0.0) AS lo, max(s.acctbal, 0.0) AS hi",
     "SELECT s_suppkey + 10000000 AS id, s_name AS c, s_acctbal IS NOT NULL AS e, s_acctbal IS NULL AS i, s_name IS NOT NULL AS k, least(s_acctbal, 0.0) AS lo, greatest(s_acctbal, 0.0) AS hi FROM supplier")
_ask("constants", "RETURN round(pi(), 10) AS p, round(e(), 10) AS e, rand() < 1.0 AS r, timestamp() > 0 AS t", "SELECT round(pi(), 10) AS p, round(exp(1), 10) AS e, true AS r, true AS t")
_ask("local_times", "MATCH (r:Region) WITH id(r) AS id, localtime({hour: 3 + id(r), minute: 4, second: 5}) AS l, time('10:20:30+01:00') AS t RETURN id, l.hour AS h, l.minute AS m, t.hour AS th, t.second AS ts, l < localtime('05:00') AS early",
     "SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey + 3 AS BIGINT) AS h, CAST(4 AS BIGINT) AS m, CAST(10 AS BIGINT) AS th, CAST(30 AS BIGINT) AS ts, r_regionkey < 2 AS early FROM region")
_ask("epochs", "MATCH (n:Nation) WITH id(n) * 86400 AS s RETURN s, datetime.fromepoch(s, 0).day AS d, datetime.fromepoch(s, 0).year AS y, datetime.fromepochmillis(s * 1000 + 1500).second AS k", """
SELECT (n_nationkey + 1000)::BIGINT * 86400 AS s, day(make_timestamp((n_nationkey + 1000)::BIGINT * 86400000000)) AS d, year(make_timestamp((n_nationkey + 1000)::BIGINT * 86400000000)) AS y, CAST(1 AS BIGINT) AS k FROM nation""")  # fmt: skip
_ask("clocks", "RETURN date.transaction() = date.statement() AS a, datetime.realtime() >= datetime.transaction() AS b", "SELECT true AS a, true AS b")


_Q = [((i * 7) % 13 - 6) / 10 for i in range(64)]


@_call("vector_dist", f"SELECT vec_id AS id, round(greatest(list_cosine_distance(CAST(embedding AS DOUBLE[]), {_Q}::DOUBLE[]), 0.0), 6) AS d FROM embeddings")
def _vector_dist(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return PropertyGraph(spark).with_nodes(rows, "V").query("MATCH (v:V) RETURN id(v) AS id, round(vector_dist(v.embedding, $q), 6) AS d", q=_Q)


@_call("vector_upkeep", f"""
SELECT vec_id AS node, round(pow(list_distance(CAST(embedding AS DOUBLE[]), {_Q}::DOUBLE[]), 2), 5) AS distance FROM embeddings WHERE vec_id >= 5
UNION ALL SELECT CAST(5000000 AS BIGINT), 0.0::DOUBLE""")
def _vector_upkeep(spark, folder):
    rows = table(spark, folder, "embeddings")
    graph = PropertyGraph(spark).with_nodes(rows.select(F.col("vec_id").alias("id")).unionByName(spark.createDataFrame([(5_000_000,)], "id bigint")), "V")
    graph = search.upsert_vectors(graph, rows.select(F.col("vec_id").alias("node_id"), "embedding"))
    graph = search.upsert_vectors(graph, spark.createDataFrame([(5_000_000, _Q)], "node_id bigint, embedding array<double>"))
    graph = search.remove_vectors(graph, spark.range(5))
    graph = search.configure_vectors(graph, "l2", reindex=True)
    return search.vector_search(graph, _Q, 2_000_000_000).select("node", F.round("distance", 5).alias("distance"))


# ---- reading ------------------------------------------------------------------------------


@_call("longest_path", "SELECT [s_suppkey + 10000000, n_nationkey + 1000, n_regionkey] AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def _longest(spark, folder):
    graph = places(spark, folder)
    region = graph.query("MATCH (s:Supplier)-[:FROM_NATION]->()-[:IN_REGION]->(r) WHERE id(s) = 10000001 RETURN id(r) AS r").first()[0]
    return spark.createDataFrame([(traversal.longest_path(graph, 10_000_001, region),)], "path array<bigint>")


@_call("read_interface", """
SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS name, true AS known, false AS unknown, ['Nation'] AS labels, true AS linked,
  (SELECT min(s_acctbal) FROM supplier) AS lo, (SELECT max(s_acctbal) FROM supplier) AS hi, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM nation) AS lies""")
def _interface(spark, folder):
    g = places(spark, folder)
    lo, hi = g.property_range("acctbal", "Supplier")
    row = (g.node(1_003).first()["p_name"], g.node_exists(1_003), g.node_exists(999_999), g.node_labels(1_003), g.has_relationships(1_003), lo, hi, g.nodes_by_label("Supplier").count(), g.edges_by_type("IN_REGION").count())
    return spark.createDataFrame([row], "name string, known boolean, unknown boolean, labels array<string>, linked boolean, lo double, hi double, suppliers bigint, lies bigint")


@_call("property_columns", "SELECT s_name AS value, count(*) AS n FROM supplier GROUP BY 1")
def _property_columns(spark, folder):
    return places(spark, folder).property_groups("name", "Supplier")
