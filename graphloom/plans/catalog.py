"""Queries over the sample graphs, one or more per operator, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import centrality, search, traversal
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.procedures import table_procedure
from graphloom.sources import bulk
from graphloom.sources.sample_graphs import commerce_graph, social_graph
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- query texts over the commerce graph ------------------------------------------

_KNOWS = """knows AS (
  SELECT o_orderkey AS id, o_custkey + 20000000 AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) + 20000000 AS dst, o_totalprice AS weight FROM orders
  QUALIFY dst IS NOT NULL
)"""


def _text(name: str, query: str, sql: str | None, **params) -> None:
    QUERIES[name] = lambda spark, folder: commerce_graph(spark, folder).query(query, **params)
    if sql is not None:
        SQL[name] = sql


_text("return_literal", "RETURN 1 AS one, 'a' AS a, null AS n, true AS t", "SELECT CAST(1 AS BIGINT) AS one, 'a' AS a, CAST(NULL AS VARCHAR) AS n, true AS t")
_text("unwind_list", "UNWIND [1, 2, null, 3] AS x RETURN x, x * 2 AS y", "SELECT CAST(x AS BIGINT) AS x, CAST(x * 2 AS BIGINT) AS y FROM (VALUES (1), (2), (NULL), (3)) t(x)")
_text("label_scan", "MATCH (n:Supplier) RETURN id(n) AS id, n.name AS name", "SELECT s_suppkey + 10000000 AS id, s_name AS name FROM supplier")
_text("label_scan_all", "MATCH (n) RETURN labels(n) AS labels, count(*) AS n", """
SELECT ['Region'] AS labels, count(*) AS n FROM region UNION ALL SELECT ['Nation'], count(*) FROM nation UNION ALL SELECT ['Supplier'], count(*) FROM supplier
UNION ALL SELECT ['Customer'], count(*) FROM customer UNION ALL SELECT ['Part'], count(*) FROM part UNION ALL SELECT ['Order'], count(*) FROM orders
UNION ALL SELECT ['Document'], count(*) FROM documents""")  # fmt: skip
_text("node_by_id", "MATCH (n:Customer) WHERE id(n) = $id RETURN n.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 42", id=20_000_042)
_text("node_prop_eq", "MATCH (p:Part {size: 7}) RETURN id(p) AS id, p.brand AS brand", "SELECT p_partkey + 30000000 AS id, p_brand AS brand FROM part WHERE p_size = 7")
_text("node_prop_range", "MATCH (c:Customer) WHERE c.acctbal >= 1000 AND c.acctbal < 2000.5 RETURN id(c) AS id, c.acctbal AS bal",
      "SELECT c_custkey + 20000000 AS id, c_acctbal AS bal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000.5")
_text("unwind_lookup", "UNWIND ['NATION_3', 'NATION_7', 'nowhere'] AS x MATCH (n:Nation {name: x}) RETURN x, id(n) AS id",
      "SELECT n_name AS x, CAST(n_nationkey + 1000 AS BIGINT) AS id FROM nation WHERE n_name IN ('NATION_3', 'NATION_7')")
_text("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS seg, o.status AS status, count(*) AS n",
      "SELECT c_mktsegment AS seg, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
_text("expand_in", "MATCH (p:Part)<-[k:CONTAINS]-(o:Order) RETURN p.brand AS brand, round(sum(k.quantity), 2) AS q",
      "SELECT p_brand AS brand, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_text("expand_undirected", "MATCH (a:Customer)-[:KNOWS]-(b:Customer) RETURN id(a) AS a, count(*) AS n", f"""
WITH {_KNOWS}, w AS (SELECT src AS a FROM knows UNION ALL SELECT dst FROM knows WHERE src <> dst) SELECT a, count(*) AS n FROM w GROUP BY a""")  # fmt: skip
_text("expand_multi_type", "MATCH (x)-[r:FROM_NATION|IN_REGION]->(y) RETURN type(r) AS t, y.name AS name, count(*) AS n", """
SELECT 'FROM_NATION' AS t, n_name AS name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x JOIN nation ON k = n_nationkey GROUP BY n_name
UNION ALL SELECT 'IN_REGION', r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")  # fmt: skip
_text("expand_chain", "MATCH (s:Supplier)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n, round(sum(s.acctbal), 2) AS bal",
      "SELECT r_name AS region, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_text("filter_over_expand", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.acctbal > 5000 AND o.totalprice < c.acctbal RETURN count(*) AS n",
      "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice < c_acctbal")
_TRAILS = """h1 AS (SELECT src AS a, dst AS z, [id] AS t FROM knows),
h2 AS (SELECT a, k.dst AS z, list_append(t, k.id) AS t FROM h1 JOIN knows k ON z = k.src WHERE NOT list_contains(t, k.id)),
h3 AS (SELECT a, k.dst AS z, list_append(t, k.id) AS t FROM h2 JOIN knows k ON z = k.src WHERE NOT list_contains(t, k.id))"""
_text("var_length_1_3", "MATCH (a:Customer)-[r:KNOWS*1..3]->(b:Customer) RETURN size(r) AS hops, count(*) AS n, count(DISTINCT b) AS ends", f"""
WITH {_KNOWS}, {_TRAILS}, u AS (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3)
SELECT CAST(len(t) AS BIGINT) AS hops, count(*) AS n, count(DISTINCT z) AS ends FROM u GROUP BY 1""")  # fmt: skip
_text("var_length_zero", "MATCH (a:Customer)-[:KNOWS*0..1]->(b:Customer) RETURN id(a) AS a, count(*) AS n", f"""
WITH {_KNOWS} SELECT c_custkey + 20000000 AS a, 1 + (SELECT count(*) FROM knows WHERE src = c_custkey + 20000000) AS n FROM customer""")  # fmt: skip
_text("var_length_unbounded", "MATCH (s:Supplier)-[r:FROM_NATION|IN_REGION*]->(x) RETURN size(r) AS hops, x.name AS name, count(*) AS n", """
SELECT CAST(1 AS BIGINT) AS hops, n_name AS name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2
UNION ALL SELECT 2, r_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2""")  # fmt: skip
_text("named_path", "MATCH p = (s:Supplier)-[:FROM_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN length(p) AS l, [x IN nodes(p) | id(x)] AS ns, id(r) AS r",
      "SELECT CAST(2 AS BIGINT) AS l, [s_suppkey + 10000000, n_nationkey + 1000, n_regionkey] AS ns, CAST(n_regionkey AS BIGINT) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_text("match_comma_join", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:FROM_NATION]->(n) RETURN n.name AS nation, count(*) AS n",
      "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
_text("cross_product", "MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_text("order_skip_limit", "MATCH (c:Customer) RETURN id(c) AS id, c.acctbal AS bal ORDER BY bal DESC, id SKIP 5 LIMIT 10",
      "SELECT c_custkey + 20000000 AS id, c_acctbal AS bal FROM customer ORDER BY bal DESC, id LIMIT 10 OFFSET 5")
_text("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN id(c) AS c, count(o) AS n, sum(o.totalprice) > 0 AS some",
      "SELECT c_custkey + 20000000 AS c, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) > 0 AS some FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
_text("optional_match_outer_condition", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice < c.acctbal RETURN id(c) AS c, count(o) AS n",
      "SELECT c_custkey + 20000000 AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice < c_acctbal GROUP BY 1")
_text("return_distinct", "MATCH (o:Order) RETURN DISTINCT o.status AS s, o.priority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
_text("union_distinct", "MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (r:Region) RETURN r.name AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT r_name FROM region")
_text("union_all", "MATCH (n:Nation) RETURN n.name AS x UNION ALL MATCH (n:Nation) RETURN n.name AS x", "SELECT n_name AS x FROM nation UNION ALL SELECT n_name FROM nation")
_text("with_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, max(o.totalprice) AS top WHERE n > 10 WITH n, avg(top) AS mean RETURN n, round(mean, 4) AS mean",
      "SELECT n, round(avg(top), 4) AS mean FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) WHERE n > 10 GROUP BY n")
_text("cycle_close", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(a) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src AND y.dst = x.src AND x.id <> y.id""")  # fmt: skip
_text("triangle_pattern", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer)-[:KNOWS]->(a) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src JOIN knows z ON y.dst = z.src AND z.dst = x.src WHERE x.id <> y.id AND y.id <> z.id AND x.id <> z.id""")  # fmt: skip
_text("two_hop_count", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src AND x.id <> y.id""")  # fmt: skip
_text("two_hop_back", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)<-[:KNOWS]-(c:Customer) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.dst AND x.id <> y.id""")  # fmt: skip
_text("three_hop_count", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer)-[:KNOWS]->(d:Customer) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src JOIN knows z ON y.dst = z.src WHERE x.id <> y.id AND y.id <> z.id AND x.id <> z.id""")  # fmt: skip
_text("grouped_degree_topn", "MATCH (c:Customer)<-[:KNOWS]-(x:Customer) RETURN c.name AS name, count(*) AS n ORDER BY n DESC, name LIMIT 20", f"""
WITH {_KNOWS} SELECT c_name AS name, count(*) AS n FROM knows JOIN customer ON dst = c_custkey + 20000000 GROUP BY 1 ORDER BY n DESC, name LIMIT 20""")  # fmt: skip
_text("filter_comparison", "MATCH (c:Customer) WHERE 100 < c.acctbal <= 500 AND c.mktsegment <> 'BUILDING' RETURN id(c) AS id",
      "SELECT c_custkey + 20000000 AS id FROM customer WHERE c_acctbal > 100 AND c_acctbal <= 500 AND c_mktsegment <> 'BUILDING'")
_text("filter_boolean_3vl", "MATCH (d:Document) WHERE NOT (d.lang = 'en' OR d.source = 'wiki') XOR d.lang IS NULL RETURN id(d) AS id",
      "SELECT doc_id + 60000000 AS id FROM documents WHERE (NOT (lang = 'en' OR source = 'wiki')) <> (lang IS NULL)")
_text("arith_int", "MATCH (p:Part) RETURN id(p) AS id, p.size / 3 AS d, p.size % 7 AS m, p.size * 2 - 5 AS a, -p.size AS neg",
      "SELECT p_partkey + 30000000 AS id, CAST(p_size // 3 AS BIGINT) AS d, CAST(p_size % 7 AS BIGINT) AS m, CAST(p_size * 2 - 5 AS BIGINT) AS a, CAST(-p_size AS BIGINT) AS neg FROM part")
_text("arith_float", "MATCH (p:Part) RETURN id(p) AS id, round(p.retailprice / 7.0 + p.size ^ 2, 6) AS x, p.retailprice % 10.0 >= 5 AS big",
      "SELECT p_partkey + 30000000 AS id, round(p_retailprice / 7.0 + CAST(p_size AS DOUBLE) ** 2, 6) AS x, p_retailprice % 10.0 >= 5 AS big FROM part")
_text("filter_in_list", "MATCH (o:Order) WHERE o.priority IN ['1-URGENT', '2-HIGH', null] RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_text("string_predicates", "MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer#00000' AND c.name ENDS WITH '7' AND NOT c.name CONTAINS '99' RETURN c.name AS name",
      "SELECT c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#00000') AND c_name LIKE '%7' AND c_name NOT LIKE '%99%'")
_text("regex_match", "MATCH (c:Customer) WHERE c.name =~ 'Customer#0*[0-9]*13' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[0-9]*13')")
_text("case_when", "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 1000 THEN 'low' ELSE 'high' END AS k, CASE c.mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b, count(*) AS n",
      "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS k, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS b, count(*) AS n FROM customer GROUP BY 1, 2")
_text("list_subscript", "MATCH (n:Nation) WITH n, split(n.name, '_') AS parts RETURN parts[0] AS a, parts[-1] AS b, parts[9] AS c",
      "SELECT 'NATION' AS a, split(n_name, '_')[-1] AS b, CAST(NULL AS VARCHAR) AS c FROM nation")
_text("list_slice", "MATCH (p:Part) WITH p, range(1, 6) AS l RETURN id(p) AS id, l[1..3] AS a, l[-2..] AS b, l[..p.size] AS c",
      "SELECT p_partkey + 30000000 AS id, [2, 3]::BIGINT[] AS a, [5, 6]::BIGINT[] AS b, list_slice([1, 2, 3, 4, 5, 6]::BIGINT[], 1, p_size) AS c FROM part")
_text("list_comprehension", "MATCH (p:Part) RETURN id(p) AS id, [x IN range(1, p.size) WHERE x % 5 = 0 | x * x] AS l",
      "SELECT p_partkey + 30000000 AS id, [x * x FOR x IN range(1, CAST(p_size AS BIGINT) + 1) IF x % 5 = 0] AS l FROM part")
_text("pattern_comprehension", "MATCH (c:Customer) RETURN id(c) AS c, size([(c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 | o.totalprice]) AS n",
      "SELECT c_custkey + 20000000 AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
_text("quantifiers", "MATCH (p:Part) WITH p, range(1, p.size) AS l RETURN id(p) AS id, all(x IN l WHERE x < 40) AS al, any(x IN l WHERE x = 9) AS an, none(x IN l WHERE x > 20) AS no, single(x IN l WHERE x % 10 = 0) AS si",
      "SELECT p_partkey + 30000000 AS id, p_size < 40 AS al, p_size >= 9 AS an, p_size <= 20 AS no, p_size BETWEEN 10 AND 19 AS si FROM part")
_text("list_reduce", "MATCH (p:Part) RETURN id(p) AS id, reduce(s = 0, x IN range(1, p.size) | s + x) AS s", "SELECT p_partkey + 30000000 AS id, CAST(p_size * (p_size + 1) // 2 AS BIGINT) AS s FROM part")
_text("anti_join_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[r:PLACED]->(:Order) WITH c, r WHERE r IS NULL RETURN id(c) AS id",
      "SELECT c_custkey + 20000000 AS id FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
_text("semi_join_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN DISTINCT id(c) AS id", "SELECT DISTINCT o_custkey + 20000000 AS id FROM orders WHERE o_totalprice > 400000")
_text("theta_inequality", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer) WHERE a.acctbal < b.acctbal AND b.acctbal < c.acctbal RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src AND x.id <> y.id
JOIN customer a ON a.c_custkey + 20000000 = x.src JOIN customer b ON b.c_custkey + 20000000 = x.dst JOIN customer c ON c.c_custkey + 20000000 = y.dst
WHERE a.c_acctbal < b.c_acctbal AND b.c_acctbal < c.c_acctbal""")  # fmt: skip
_text("agg_count_star", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders")
_text("agg_count_distinct", "MATCH (o:Order) RETURN count(DISTINCT o.priority) AS a, count(o.status) AS b", "SELECT count(DISTINCT o_orderpriority) AS a, count(o_orderstatus) AS b FROM orders")
_text("agg_sum", "MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS s, sum(DISTINCT p.size) AS d", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS s, CAST(sum(DISTINCT p_size) AS BIGINT) AS d FROM part GROUP BY 1")
_text("agg_sum_empty", "MATCH (p:Part) WHERE p.size > 1000 RETURN sum(p.size) AS s, avg(p.size) AS a, collect(p.size) AS c, stDev(p.size) AS d, count(p) AS n",
      "SELECT CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST([] AS BIGINT[]) AS c, CAST(0 AS DOUBLE) AS d, CAST(0 AS BIGINT) AS n")
_text("agg_avg", "MATCH (p:Part) RETURN p.type AS t, round(avg(p.retailprice), 4) AS a", "SELECT p_type AS t, round(avg(p_retailprice), 4) AS a FROM part GROUP BY 1")
_text("agg_min_max", "MATCH (o:Order) RETURN o.status AS s, min(o.totalprice) AS lo, max(o.totalprice) AS hi, min(o.priority) AS p", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS p FROM orders GROUP BY 1")
_text("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n.name AS name ORDER BY name RETURN r.name AS r, size(collect(name)) AS k, size(collect(DISTINCT substring(name, 0, 8))) AS d",
      "SELECT r_name AS r, count(*) AS k, count(DISTINCT substr(n_name, 1, 8)) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_text("agg_stdev", "MATCH (p:Part) RETURN p.brand AS b, round(stDev(p.retailprice), 4) AS s, round(stDevP(p.retailprice), 4) AS p", "SELECT p_brand AS b, round(stddev_samp(p_retailprice), 4) AS s, round(stddev_pop(p_retailprice), 4) AS p FROM part GROUP BY 1")
_text("agg_percentile", "MATCH (p:Part) RETURN p.brand AS b, percentileDisc(p.size, 0.4) AS d, round(percentileCont(p.retailprice, 0.9), 6) AS c",
      "SELECT p_brand AS b, CAST(quantile_disc(p_size, 0.4) AS DOUBLE) AS d, round(quantile_cont(p_retailprice, 0.9), 6) AS c FROM part GROUP BY 1")
_text("agg_in_expression", "MATCH (o:Order) RETURN o.status AS s, count(*) * 2 + 1 AS x, round(sum(o.totalprice) / count(*), 4) AS m ORDER BY max(o.totalprice)",
      "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS x, round(sum(o_totalprice) / count(*), 4) AS m FROM orders GROUP BY 1")
_text("group_by_node", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n RETURN c.name AS name, n", "SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey")
_text("str_functions", "MATCH (c:Customer) RETURN substring(c.name, 9, 4) AS a, left(c.name, 3) AS b, right(c.name, 2) AS d, toUpper(c.name) AS e, toLower(c.mktsegment) AS f, replace(c.name, '#', '-') AS g, reverse(c.mktsegment) AS h, trim('  x ') AS i, size(c.name) AS j, split(c.name, '#')[0] AS k",
      "SELECT substr(c_name, 10, 4) AS a, c_name[1:3] AS b, right(c_name, 2) AS d, upper(c_name) AS e, lower(c_mktsegment) AS f, replace(c_name, '#', '-') AS g, reverse(c_mktsegment) AS h, 'x' AS i, length(c_name) AS j, 'Customer' AS k FROM customer")
_text("list_functions", "MATCH (p:Part) WITH p, range(1, p.size, 2) AS l RETURN id(p) AS id, head(l) AS h, last(l) AS t, size(tail(l)) AS n, reverse(l)[0] AS r, l + 99 AS x",
      "SELECT p_partkey + 30000000 AS id, l[1] AS h, l[-1] AS t, len(l) - 1 AS n, l[-1] AS r, list_append(l, 99) AS x FROM (SELECT p_partkey, range(1, CAST(p_size AS BIGINT) + 1, 2) AS l FROM part)")
_text("math_functions", "MATCH (p:Part) WITH id(p) AS id, p.retailprice AS x RETURN id, abs(-x) AS a, round(sqrt(x), 6) AS b, floor(x) AS c, ceil(x) AS d, round(x) AS e, sign(x) AS f, round(log(x), 8) AS g, round(log10(x), 8) AS h, round(sin(x) + cos(x), 8) AS i, round(atan2(x, 2.0), 8) AS j, round(radians(x), 8) AS k, round(exp(x / 1000.0), 8) AS l",
      "SELECT p_partkey + 30000000 AS id, x AS a, round(sqrt(x), 6) AS b, floor(x) AS c, ceil(x) AS d, round(x) AS e, CAST(sign(x) AS BIGINT) AS f, round(ln(x), 8) AS g, round(log10(x), 8) AS h, round(sin(x) + cos(x), 8) AS i, round(atan2(x, 2.0), 8) AS j, round(radians(x), 8) AS k, round(exp(x / 1000.0), 8) AS l FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
_text("type_conversion", "MATCH (p:Part) RETURN id(p) AS id, toString(p.size) AS a, toInteger('1.9') + p.size AS b, toFloat(p.size) AS c, toBoolean('TRUE') AS d, toInteger('x') AS e, 's' + p.size AS f",
      "SELECT p_partkey + 30000000 AS id, CAST(p_size AS VARCHAR) AS a, CAST(1 + p_size AS BIGINT) AS b, CAST(p_size AS DOUBLE) AS c, true AS d, CAST(NULL AS BIGINT) AS e, 's' || p_size AS f FROM part")
_text("temporal_construct", "MATCH (o:Order) WITH id(o) AS id, date(o.orderdate) AS d RETURN id, toString(d) AS s, d.year AS y, d.quarter AS q, d.week AS w, d.dayOfWeek AS k, d.ordinalDay AS n, toString(date({year: d.year, ordinalDay: d.ordinalDay})) AS s2",
      "SELECT o_orderkey + 40000000 AS id, strftime(o_orderdate, '%Y-%m-%d') AS s, year(o_orderdate) AS y, quarter(o_orderdate) AS q, week(o_orderdate) AS w, isodow(o_orderdate) AS k, dayofyear(o_orderdate) AS n, strftime(o_orderdate, '%Y-%m-%d') AS s2 FROM orders")
_text("temporal_truncate", "MATCH (o:Order) WITH id(o) AS id, o.orderdate AS d RETURN id, toString(date.truncate('month', d)) AS m, toString(date.truncate('week', d)) AS w, toString(date.truncate('decade', d)) AS c, toString(localdatetime.truncate('hour', d)) AS h",
      "SELECT o_orderkey + 40000000 AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, strftime(date_trunc('decade', o_orderdate), '%Y-%m-%d') AS c, strftime(date_trunc('hour', o_orderdate), '%Y-%m-%dT%H:%M') AS h FROM orders")
_text("duration_between", "MATCH (o:Order) WITH id(o) AS id, date(o.orderdate) AS d, date('2000-01-01') AS e RETURN id, duration.inDays(d, e).days AS n, duration.inMonths(d, e).months AS m, duration.inSeconds(d, e).hours AS h",
      "SELECT o_orderkey + 40000000 AS id, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS n, date_sub('month', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS m, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') * 24 AS h FROM orders")
_text("temporal_arith", "MATCH (o:Order) WITH id(o) AS id, date(o.orderdate) AS d RETURN id, toString(d + duration('P1M3D')) AS a, toString(d - duration({days: 40})) AS b, d < date('1995-06-01') AS c",
      "SELECT o_orderkey + 40000000 AS id, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 3 DAY, '%Y-%m-%d') AS a, strftime(CAST(o_orderdate AS DATE) - INTERVAL 40 DAY, '%Y-%m-%d') AS b, CAST(o_orderdate AS DATE) < DATE '1995-06-01' AS c FROM orders")
_text("set_similarity", "MATCH (p:Part) WITH id(p) AS id, range(1, p.size) AS a, range(5, 20) AS b RETURN id, round(similarity.jaccard(a, b), 8) AS j, round(similarity.overlap(a, b), 8) AS o",
      "SELECT p_partkey + 30000000 AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) AS j, round(len(list_intersect(a, b)) / least(len(a), 16), 8) AS o FROM (SELECT p_partkey, range(1, CAST(p_size AS BIGINT) + 1) AS a, range(5, 21) AS b FROM part)")
_text("lsqb_chain_join", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN r.name AS r, count(*) AS n",
      "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
_text("lsqb_star", "MATCH (c:Customer)-[:KNOWS]->(x:Customer), (c)-[:PLACED]->(o:Order), (c)-[:FROM_NATION]->(n:Nation) RETURN n.name AS n, count(*) AS k", f"""
WITH {_KNOWS}, k AS (SELECT src, count(*) AS a FROM knows GROUP BY 1), o AS (SELECT o_custkey, count(*) AS b FROM orders GROUP BY 1)
SELECT n_name AS n, CAST(sum(a * b) AS BIGINT) AS k FROM customer JOIN k ON src = c_custkey + 20000000 JOIN o ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")  # fmt: skip
_text("lsqb_triangle_across_matches", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) MATCH (b)-[:KNOWS]->(c:Customer) MATCH (c)-[:KNOWS]->(a) RETURN count(*) AS n", f"""
WITH {_KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.dst = y.src JOIN knows z ON y.dst = z.src AND z.dst = x.src""")  # fmt: skip
_text("lsqb_double_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'F' OPTIONAL MATCH (c)-[k:KNOWS]->(d:Customer) RETURN count(*) AS n, count(o) AS o, count(k) AS k", f"""
WITH {_KNOWS} SELECT count(*) AS n, count(o_orderkey) AS o, count(id) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' LEFT JOIN knows ON src = c_custkey + 20000000""")  # fmt: skip
_text("lsqb_negation", "MATCH (c:Customer) WHERE size([(c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' | 1]) = 0 RETURN count(*) AS n",
      "SELECT count(*) AS n FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey")
_text("agg_over_traversal", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[k:CONTAINS]->(p:Part) WHERE p.size <= 10 RETURN c.mktsegment AS seg, p.brand AS brand, round(sum(k.price * (1 - k.discount)), 2) AS revenue, count(*) AS n",
      "SELECT c_mktsegment AS seg, p_brand AS brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1, 2")
_text("call_yield_join", "CALL degree({direction: 'OUT'}) YIELD nodeId, score MATCH (n:Nation) WHERE id(n) = nodeId RETURN n.name AS name, score",
      "SELECT n_name AS name, CAST(1 AS DOUBLE) AS score FROM nation")

#: The flagship: minimum slice of the language end to end.
FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN c.mktsegment AS seg, count(*) AS n, round(sum(o.totalprice), 2) AS total ORDER BY n DESC, seg LIMIT 5"
_text("flagship", FLAGSHIP, "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY n DESC, seg LIMIT 5")


def query(name: str, sql: str | None = None):
    """Register a query that is not a plain query text."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- procedures and search over the commerce graph ---------------------------------


@query("call_custom_procedure", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey = 2")
def _custom(spark, folder):
    rows = table(spark, folder, "nation").select(F.col("n_regionkey").alias("wanted"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    graph = commerce_graph(spark, folder)
    return graph.query("CALL lookup.nations(2.0) YIELD name, region RETURN name, region", procedures={"lookup.nations": table_procedure(rows, ("wanted",))})


_QUERY_VECTOR = [((i * 7) % 13 - 6) / 10 for i in range(64)]
_VECTOR_SQL = f"""v AS (SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}::DOUBLE[]) AS d FROM embeddings)"""


@query("vector_topk", f"WITH {_VECTOR_SQL} SELECT vec_id + 60000000 AS node, round(d, 6) AS distance FROM v ORDER BY d, vec_id LIMIT 10")
def _vector_topk(spark, folder):
    return search.vector_search(commerce_graph(spark, folder), _QUERY_VECTOR, 10).select("node", F.round("distance", 6).alias("distance"))


@query("vector_topk_filtered", f"WITH {_VECTOR_SQL} SELECT vec_id + 60000000 AS node, round(d, 6) AS distance FROM v JOIN documents ON doc_id = vec_id WHERE source = 'forum' ORDER BY d, vec_id LIMIT 10")
def _vector_filtered(spark, folder):
    found = search.vector_search(commerce_graph(spark, folder), _QUERY_VECTOR, 10, "Document", {"source": "forum"})
    return found.select("node", F.round("distance", 6).alias("distance"))


@query("vector_distance", f"""SELECT vec_id AS id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}::DOUBLE[]), 6) AS c,
round(list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}::DOUBLE[]), 6) AS e FROM embeddings""")
def _vector_distance(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    graph = PropertyGraph(spark).with_nodes(rows, "V")
    return graph.query("MATCH (v:V) RETURN id(v) AS id, round(distance.cosine(v.embedding, $q), 6) AS c, round(distance.euclidean(v.embedding, $q), 6) AS e", q=_QUERY_VECTOR)


@lru_cache(maxsize=8)
def _indexed(spark, folder) -> PropertyGraph:
    """The text index is a stored table: queries read its postings, they do not tokenise the documents again."""
    return search.create_text_index(commerce_graph(spark, folder), "Document", "text")


def _tokens_sql(text: str) -> str:
    """Indexed words of the documents, and the words that have the stems of the query's terms."""
    single = [(c, base) for base, chars in search.FOLD for c in chars if len(base) == 1]
    folded = f"translate(text, '{''.join(c for c, _ in single)}', '{''.join(b for _, b in single)}')"
    for base, chars in search.FOLD:
        for c in chars if len(base) > 1 else "":
            folded = f"replace({folded}, '{c}', '{base}')"
    stops = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in sorted(search.STOP_WORDS["en"]))
    forms = [(t, t.removesuffix(cut) + end) for t in search.tokenize(text) for cut in ("", "e", "i") for end in ("", "s", "e", "es", "y", "ed", "ing", "ings", "er", "ers", "ies")]
    known = sorted({(t, f) for t, f in forms if search.stem(f) == t})
    values = ", ".join(f"('{t}', '{f}')" for t, f in known)
    return rf"""
a AS (SELECT doc_id + 60000000 AS node, unnest(regexp_extract_all({folded}, '[\p{{L}}\p{{N}}_]+(?:[.''’][\p{{L}}\p{{N}}_]+)*')) AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT node, lower(trim(w, '_')) AS w FROM a),
t AS (SELECT * FROM k WHERE w <> '' AND w NOT IN ({stops})),
lengths AS (SELECT node, count(*) AS len FROM t GROUP BY 1), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean FROM lengths),
q(term, form) AS (VALUES {values}),
h AS (SELECT node, term, count(*) AS tf FROM t JOIN q ON w = form GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)"""


_BM25 = "sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))"
_TFIDF = "sum(sqrt(tf) * greatest(ln(n / (df + 1.0)), 0.0))"


def _text_sql(text: str, score: str, limit: int, every: int = 1) -> str:
    return f"""WITH {_tokens_sql(text)}, x AS (SELECT node, {score} AS score FROM h JOIN f USING (term) JOIN lengths USING (node), s GROUP BY node HAVING count(*) >= {every})
SELECT node, round(score, 6) AS score FROM x ORDER BY x.score DESC, node LIMIT {limit}"""


def _around_sql(seeds: str, places: int) -> str:
    """Seeds (node, score) that are documents, and the documents next to them."""
    return f"""{seeds}, i AS (SELECT node FROM seed JOIN documents ON doc_id + 60000000 = node),
r AS (SELECT node FROM i UNION SELECT d.doc_id + 60000000 FROM i JOIN documents d ON d.doc_id + 60000000 = i.node + 1)
SELECT r.node, round(seed.score, {places}) AS score FROM r LEFT JOIN seed USING (node)"""


def _hybrid_sql(part: str) -> str:
    return _around_sql(f"""WITH {_tokens_sql("label scan")}, x AS (SELECT node, {_BM25} AS score FROM h JOIN f USING (term) JOIN lengths USING (node), s GROUP BY node),
words AS (SELECT node, row_number() OVER (ORDER BY score DESC, node) - 1 AS rank FROM x QUALIFY rank < 10),
{_VECTOR_SQL}, near AS (SELECT vec_id + 60000000 AS node, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM v QUALIFY rank < 10),
seed AS (SELECT node, sum({part}) AS score FROM (FROM words UNION ALL FROM near) GROUP BY 1)""", 8)


_WANTED = "edge weights of the graph index"


@query("bm25_search", _text_sql(_WANTED, _BM25, 20))
def _bm25(spark, folder):
    return search.text_search(_indexed(spark, folder), _WANTED, 20).select("node", F.round("score", 6).alias("score"))


@query("tfidf_search", _text_sql(_WANTED, _TFIDF, 20))
def _tfidf(spark, folder):
    return search.text_search(_indexed(spark, folder), _WANTED, 20, scorer=search.tf_idf()).select("node", F.round("score", 6).alias("score"))


@query("text_boolean_and", _text_sql("label scan", _BM25, 20, 2))
def _text_and(spark, folder):
    return search.text_search(_indexed(spark, folder), "label scan", 20, every_term=True).select("node", F.round("score", 6).alias("score"))


@query("retrieve_vector", _around_sql(f"WITH {_VECTOR_SQL}, seed AS (SELECT vec_id + 60000000 AS node, d AS score FROM v ORDER BY d, vec_id LIMIT 5)", 6))
def _retrieve_vector(spark, folder):
    return search.retrieve(_with_next(spark, folder), _QUERY_VECTOR, 5, 1).nodes.select("node", F.round("score", 6).alias("score"))


@query("hybrid_rrf", _hybrid_sql("1.0::DOUBLE / (61.0 + rank)"))
def _hybrid_rrf(spark, folder):
    found = search.retrieve_hybrid(_with_next(spark, folder), _QUERY_VECTOR, "label scan", hops=1)
    return found.nodes.select("node", F.round("score", 8).alias("score"))


@query("hybrid_weighted", _hybrid_sql("0.5::DOUBLE * (10.0 - rank) / 10.0"))
def _hybrid_weighted(spark, folder):
    found = search.retrieve_hybrid(_with_next(spark, folder), _QUERY_VECTOR, "label scan", hops=1, strategy="weighted", max_nodes=50)
    return found.nodes.select("node", F.round("score", 8).alias("score"))


def _with_next(spark, folder) -> PropertyGraph:
    """Documents linked to the document of the next id."""
    docs = table(spark, folder, "documents").select("doc_id")
    links = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    rows = links.select(F.col("doc_id").alias("id"), (F.col("doc_id") + 60_000_000).alias("src"), (F.col("doc_id") + 60_000_001).alias("dst"))
    return _indexed(spark, folder).with_edges(rows, "NEXT", "Document", "Document")


@query("copy_from_parquet", "SELECT 'Part' AS target, 'nodes' AS kind, count(*) AS count FROM part")
def _copy(spark, folder):
    return PropertyGraph(spark).execute(f"COPY Part FROM '{folder}/part.parquet'").df


@query("copy_then_query", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def _copy_query(spark, folder):
    graph = bulk.copy(PropertyGraph(spark), "Part", f"{folder}/part.parquet")[1]
    return graph.query("MATCH (p:Part) RETURN p.p_brand AS brand, count(*) AS n")


# ---- algorithms over the graph tables ------------------------------------------------

_SOCIAL = """e AS (
  SELECT edge_id AS id, src, dst, edge_type AS type, weight FROM edges WHERE edge_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC, src DESC NULLS LAST, dst DESC NULLS LAST, edge_type DESC NULLS LAST, weight DESC NULLS LAST) = 1
), l AS (SELECT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL),
n AS (SELECT DISTINCT node_id AS id FROM nodes WHERE node_id IS NOT NULL UNION ALL SELECT node_id FROM shared_nodes)"""


def _social(name: str, run: Callable[[PropertyGraph], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: run(social_graph(spark, folder))
    if sql is not None:
        SQL[name] = f"WITH RECURSIVE {_SOCIAL} {sql}"


def _rounded(df: DataFrame, column: str = "score", places: int = 8) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


def _ids(spark: SparkSession, *values: int) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], "id bigint")


#: Hop distances between all pairs of nodes.
_ALL_PAIRS = """
, x AS MATERIALIZED (SELECT DISTINCT src, dst FROM l WHERE src <> dst),
f(s, id, d) USING KEY (s, id) AS (
  SELECT id, id, 0 FROM n
  UNION SELECT f.s, x.dst, min(f.d + 1) FROM f JOIN x ON x.src = f.id LEFT JOIN recurring.f r ON r.s = f.s AND r.id = x.dst WHERE r.d IS NULL GROUP BY 1, 2
), far AS (SELECT s, id, d FROM f)
"""

for _way, _ends in (("out", "SELECT DISTINCT src AS id, dst AS o, 0 AS w FROM l"), ("in", "SELECT DISTINCT dst AS id, src AS o, 0 AS w FROM l"),
                    ("both", "SELECT DISTINCT src AS id, dst AS o, 0 AS w FROM l UNION ALL SELECT DISTINCT dst, src, 1 FROM l")):
    _social(f"degree_{_way}", lambda g, way=_way: centrality.degree(g, way), f", d AS ({_ends}), c AS (SELECT id, count(*) AS k FROM d GROUP BY 1) SELECT n.id, coalesce(k, 0) AS degree FROM n LEFT JOIN c USING (id)")
_social("label_counts", lambda g: g.label_counts(), """, m AS (
  SELECT labels FROM nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC, created_at DESC NULLS LAST, name DESC NULLS LAST, age DESC NULLS LAST, city DESC NULLS LAST, coalesce(labels, []) DESC) = 1
) SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM m UNION ALL SELECT label FROM shared_nodes) GROUP BY 1""")
_social("edge_type_counts", lambda g: g.edge_type_counts(), "SELECT type, count(*) AS n FROM l GROUP BY 1")
_social("neighbors", lambda g: g.neighbours(_ids(g.spark, 1_001, 1_002, 3)), """
SELECT src AS id, id AS edge_id, dst AS other, type, true AS outgoing FROM l WHERE src IN (1001, 1002, 3) UNION ALL SELECT dst, id, src, type, false FROM l WHERE dst IN (1001, 1002, 3)""")
_social("bfs_reach", lambda g: traversal.bfs(g, 1_001, 3), ", r AS (SELECT CAST(1001 AS BIGINT) AS id, 0 AS d UNION SELECT l.dst, d + 1 FROM r JOIN l ON l.src = r.id WHERE d < 3) SELECT DISTINCT id FROM r")
_social("dfs_reach", lambda g: _ids(g.spark, *traversal.dfs(g, 1_001, 3)), ", r AS (SELECT CAST(1001 AS BIGINT) AS id, 0 AS d UNION SELECT l.dst, d + 1 FROM r JOIN l ON l.src = r.id WHERE d < 3) SELECT DISTINCT id FROM r")
_social("bfs_multi_source", lambda g: traversal.reach(g, _ids(g.spark, 1_001, 1_005), 2)[0], """
, r AS (SELECT unnest([1001, 1005])::BIGINT AS id, 0 AS depth UNION SELECT l.dst, depth + 1 FROM r JOIN l ON l.src = r.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
_social("shortest_path_len", lambda g: g.spark.createDataFrame([(len(traversal.shortest_path(g, 1_001, 9) or [None]) - 1,)], "hops bigint"), """
, r AS (SELECT CAST(1001 AS BIGINT) AS id, 0 AS d UNION SELECT l.dst, d + 1 FROM r JOIN l ON l.src = r.id WHERE d < 8) SELECT coalesce(min(d), 0) AS hops FROM r WHERE id = 9""")
_social("sssp_weighted", lambda g: traversal.distances(g, 1_001).select("id", F.round("distance", 6).alias("distance")), """
, w AS MATERIALIZED (SELECT src, dst, min(coalesce(weight, 1.0)) AS w FROM l GROUP BY 1, 2),
d(id, dist) USING KEY (id) AS (
  SELECT CAST(1001 AS BIGINT), CAST(0 AS DOUBLE)
  UNION SELECT w.dst, min(d.dist + w.w) FROM d JOIN w ON w.src = d.id LEFT JOIN recurring.d r ON r.id = w.dst WHERE r.dist IS NULL OR d.dist + w.w < r.dist GROUP BY w.dst
) SELECT id, round(dist, 6) AS distance FROM d""")
_social("all_shortest_paths", lambda g: traversal.all_shortest_paths(g, 1_001, 9), """
, x AS MATERIALIZED (SELECT DISTINCT src, dst FROM l WHERE src <> dst),
z(id, d) USING KEY (id) AS (
  SELECT CAST(1001 AS BIGINT), 0 UNION SELECT x.dst, min(z.d + 1) FROM z JOIN x ON x.src = z.id LEFT JOIN recurring.z r ON r.id = x.dst WHERE r.d IS NULL GROUP BY 1
), y AS MATERIALIZED (SELECT id, d FROM z),
w AS (
  SELECT [1001::BIGINT] AS path, 1001::BIGINT AS id, 0 AS d
  UNION ALL SELECT list_append(w.path, x.dst), x.dst, w.d + 1 FROM w JOIN x ON x.src = w.id JOIN y ON y.id = x.dst AND y.d = w.d + 1 WHERE w.d < (SELECT d FROM y WHERE id = 9)
) SELECT path FROM w WHERE id = 9""")
_social("topk_paths", lambda g: g.spark.createDataFrame([(i, p, round(w, 6)) for i, (p, w) in enumerate(traversal.top_paths(g, 1_001, 9, 3))], "rank int, path array<bigint>, weight double"))
_social("detect_cycle", lambda g: g.spark.createDataFrame([(traversal.has_cycle(g),)], "cycle boolean"), _ALL_PAIRS + """
SELECT EXISTS (SELECT 1 FROM l WHERE src = dst) OR EXISTS (SELECT 1 FROM x JOIN far ON s = x.dst AND far.id = x.src) AS cycle""")
_social("wcc", centrality.wcc, """
, u AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
d(id, component) USING KEY (id) AS (
  SELECT id, id FROM n
  UNION SELECT u.b, min(d.component) FROM d JOIN u ON u.a = d.id JOIN recurring.d r ON r.id = u.b WHERE d.component < r.component GROUP BY u.b
) SELECT id, component FROM d""")
_social("scc", centrality.scc, _ALL_PAIRS + "SELECT a.s AS id, min(a.id) AS component FROM far a JOIN far b ON b.s = a.id AND b.id = a.s GROUP BY 1")
_social("clustering_coefficient", lambda g: _rounded(centrality.clustering(g)), """
, u AS (SELECT DISTINCT src AS a, dst AS b FROM l WHERE src <> dst UNION SELECT dst, src FROM l WHERE src <> dst), d AS (SELECT a, count(*) AS d FROM u GROUP BY 1),
t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT n.id, round(coalesce(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 0.0), 8) AS score FROM n LEFT JOIN d ON d.a = n.id LEFT JOIN t ON t.a = n.id""")
_social("triangle_count", centrality.triangles, """
SELECT count(*) AS count FROM l x JOIN l y ON x.dst = y.src JOIN l z ON y.dst = z.src AND z.dst = x.src WHERE x.id <> y.id AND y.id <> z.id AND x.id <> z.id""")


def _unrolled(rounds: int, first: str, step: str, places: int = 8, last: str | None = None) -> str:
    parts = [f", r0 AS MATERIALIZED ({first})"]
    parts += [f", r{i} AS MATERIALIZED ({step.replace('$PREV', f'r{i - 1}')})" for i in range(1, rounds + 1)]
    return "".join(parts) + f" SELECT id, {last or f'round(s, {places}) AS score'} FROM r{rounds}"


_social("pagerank", lambda g: _rounded(centrality.page_rank(g)), ", o AS (SELECT src, count(*) AS k FROM l GROUP BY 1)" + _unrolled(
    20, "SELECT id, 1.0 / (SELECT count(*) FROM n)::DOUBLE AS s FROM n",
    "SELECT n.id, 0.15 / (SELECT count(*) FROM n)::DOUBLE + 0.85 * coalesce(g, 0.0) AS s FROM n LEFT JOIN (SELECT l.dst, sum(s / k) AS g FROM l JOIN o ON o.src = l.src JOIN $PREV p ON p.id = l.src GROUP BY 1) q ON q.dst = n.id",
))
_social("katz", lambda g: _rounded(centrality.katz(g, 0.001, 1.0, 8, 0.0), places=11), _unrolled(
    8, "SELECT id, 1.0::DOUBLE AS s FROM n",
    "SELECT n.id, CAST(0.001 AS DOUBLE) * coalesce(g, CAST(0 AS DOUBLE)) + CAST(1 AS DOUBLE) AS s FROM n LEFT JOIN (SELECT l.dst, sum(s) AS g FROM l JOIN $PREV p ON p.id = l.src GROUP BY 1) q ON q.dst = n.id",
    11,
))
_social("eigenvector", lambda g: _rounded(centrality.eigenvector(g), places=6))
_social("eigenvector_rounds", lambda g: _rounded(centrality.eigenvector(g, 10, 0.0), places=6), _unrolled(
    10, "SELECT id, 1.0 / (SELECT count(*) FROM n)::DOUBLE AS s FROM n",
    "SELECT n.id, coalesce(g, 0.0) / sqrt(sum(coalesce(g, 0.0) * coalesce(g, 0.0)) OVER ()) AS s FROM n LEFT JOIN (SELECT l.dst, sum(s) AS g FROM l JOIN $PREV p ON p.id = l.src GROUP BY 1) q ON q.dst = n.id",
    last="round(s * (SELECT count(*) FROM n) / sum(s) OVER (), 6) AS score",
))
_social("label_propagation", lambda g: centrality.label_propagation(g), ", ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM l UNION ALL SELECT dst, src FROM l)" + _unrolled(
    20, "SELECT id, id AS s FROM n",
    "SELECT n.id, coalesce(c, p.s) AS s FROM n JOIN $PREV p USING (id) LEFT JOIN (SELECT a, c FROM (SELECT a, s AS c, count(*) AS k FROM ways JOIN $PREV q ON q.id = b GROUP BY 1, 2)"
    " QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC, c) = 1) v ON v.a = n.id",
    last="s AS community",
))
_social("louvain", centrality.louvain)
_social("communities", lambda g: centrality.communities(g, 20, 3))
_social("betweenness", lambda g: _rounded(centrality.betweenness(g), places=4))
_social("harmonic", lambda g: _rounded(centrality.harmonic(g), places=6), _ALL_PAIRS + "SELECT s AS id, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0.0 END), 6) AS score FROM far GROUP BY 1")
_social("closeness", lambda g: _rounded(centrality.closeness(g), places=6), _ALL_PAIRS + """
SELECT s AS id, round(coalesce((count(*) - 1) / nullif(sum(d), 0)::DOUBLE * ((count(*) - 1) / ((SELECT count(*) FROM n) - 1)::DOUBLE), 0.0), 6) AS score FROM far GROUP BY 1""")
_social("max_flow", lambda g: g.spark.createDataFrame([(round(traversal.max_flow(g, 1_001, 9, "weight"), 6),)], "flow double"))
_social("spanning_forest", lambda g: traversal.spanning_forest(g).agg(F.count("id").alias("edges"), F.round(F.sum("weight"), 6).alias("weight")))
_social("link_prediction", lambda g: _link_rows(g), """
, u AS (SELECT DISTINCT src AS a, dst AS b FROM l WHERE src <> dst UNION SELECT dst, src FROM l WHERE src <> dst), d AS (SELECT a, count(*) AS d FROM u GROUP BY 1),
p AS (SELECT DISTINCT src AS a, dst AS b FROM l WHERE type = 'KNOWS' AND src < dst),
c AS (SELECT p.a, p.b, count(*) AS k, sum(CASE WHEN d > 1 THEN 1.0 / ln(d) ELSE 0 END) AS aa, sum(1.0 / d) AS ra FROM p JOIN u x ON x.a = p.a JOIN u y ON y.a = p.b AND y.b = x.b JOIN d ON d.a = x.b GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(k, 0) AS common_neighbors, round(coalesce(k, 0) / (x.d + y.d - coalesce(k, 0)), 8) AS jaccard, round(coalesce(aa, 0.0), 8) AS adamic_adar,
  round(coalesce(ra, 0.0), 8) AS resource_allocation, x.d * y.d AS preferential_attachment FROM p LEFT JOIN c USING (a, b) JOIN d x ON x.a = p.a JOIN d y ON y.a = p.b""")

#: Every linked pair, whichever way its links run; link_prediction has only those from the smaller to the larger id.
_social("link_prediction_all", lambda g: _link_rows(g, turned=True))
SQL["link_prediction_all"] = SQL["link_prediction"].replace(
    "SELECT DISTINCT src AS a, dst AS b FROM l WHERE type = 'KNOWS' AND src < dst",
    "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE type = 'KNOWS' AND src <> dst",
)


def _link_rows(g: PropertyGraph, turned: bool = False) -> DataFrame:
    links = g.links(("KNOWS",))
    if turned:
        pairs = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    else:
        pairs = links.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out = centrality.link_scores(g, pairs)
    return out.select("a", "b", "common_neighbors", *[F.round(c, 8).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")], "preferential_attachment")


@query("all_paths", "SELECT [s_suppkey + 10000000, n_nationkey + 1000, n_regionkey] AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 1")
def _all_paths(spark, folder):
    graph = commerce_graph(spark, folder)
    region = table(spark, folder, "supplier").where("s_suppkey = 1").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return traversal.all_paths(graph, 10_000_001, region)
