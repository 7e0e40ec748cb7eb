"""Queries of the language-model operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leakage, mixing, neighbours, rank_fusion, text_quality
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, folder, "vectors"))


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every twentieth node, against all nodes."""
    found = neighbours.nearest(table(spark, folder, "vectors"), k=10, asked=F.col("node_id") % 20 == 0)
    return found.withColumn("distance", F.round("distance", 6))


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same with two of a hundred neighbours expected to be missed at most: work grows slower than queries times rows."""
    return neighbours.nearest(table(spark, folder, "vectors"), k=10, asked=F.col("node_id") % 20 == 0, missing=0.02)


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    scores = {"distance": -F.col("distance").cast("double")} | {
        name: F.col("scores")[name] for name in ("bm25", "pagerank", "degree", "rerank")
    }
    fused = rank_fusion.normal_scores(hits, "request_id", "node", scores)
    return rank_fusion.leading(fused, table(spark, folder, "retrievals"), "request_id", "node", "top_n")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_ranking(spark, folder).select("request_id", "node")


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id", "start_word", "end_word")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_spans(spark, folder).select("doc_id", "item_id").distinct()


def p6_removal(spark: SparkSession, folder: str) -> DataFrame:
    """The characters of each document that belong to any item."""
    return leakage.removal_spans(leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(table(spark, folder, "documents"), targets, mixing.opposing_ramps(targets))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report.where("short").select("source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).order


def p7_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every tenth of the training holds the tokens that the schedules demand."""
    return mixing.adherence(_mixture(spark, folder), mixing.opposing_ramps(table(spark, folder, "mix_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = text_quality.document_kinds(table(spark, folder, "documents"))
    return kinds.where(F.col("kind").isNotNull() & (F.col("kind") != "prose")).select("doc_id", "kind")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.document_statistics(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p3_search": p3_search,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p6_found": p6_found,
    "p6_spans": p6_spans,
    "p6_removal": p6_removal,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_order": p7_order,
    "p7_curriculum": p7_curriculum,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}


def _sql_poly(coefficients: tuple[float, ...], x: str) -> str:
    total = repr(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + ({c!r}))"
    return total


_R = rank_fusion
_P4 = f"""
WITH v AS (
  SELECT request_id, node, -max(CASE WHEN NOT isnan(distance) THEN -CAST(distance AS DOUBLE) END) AS d,
         {", ".join(f"max(CASE WHEN NOT isnan(scores['{n}']) THEN scores['{n}'] END) AS {n}" for n in ("bm25", "pagerank", "degree", "rerank"))}
  FROM hits WHERE request_id IS NOT NULL AND node IS NOT NULL GROUP BY request_id, node
), l AS (
  SELECT request_id, node, 'd' AS s, -d AS x FROM v
  {" ".join(f"UNION ALL SELECT request_id, node, '{n}', {n} FROM v" for n in ("bm25", "pagerank", "degree", "rerank"))}
), r AS (
  SELECT request_id, node, (rank() OVER (PARTITION BY request_id, s ORDER BY x NULLS FIRST) - 1
         + count(*) OVER (PARTITION BY request_id, s, x) / 2.0) / count(*) OVER (PARTITION BY request_id, s) AS p FROM l
), z AS (
  SELECT request_id, node, p, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS o FROM r
), f AS (
  SELECT request_id, node, round(sum(0.2 * CASE
      WHEN p < {_R.TAIL} THEN {_sql_poly(_R.TAIL_TOP, "o")} / ({_sql_poly(_R.TAIL_BOTTOM, "o")} * o + 1.0)
      WHEN p > 1.0 - {_R.TAIL} THEN -{_sql_poly(_R.TAIL_TOP, "o")} / ({_sql_poly(_R.TAIL_BOTTOM, "o")} * o + 1.0)
      ELSE {_sql_poly(_R.CENTRE_TOP, "r")} * q / ({_sql_poly(_R.CENTRE_BOTTOM, "r")} * r + 1.0) END), 12) AS fused
  FROM z GROUP BY request_id, node
), n AS (
  SELECT f.*, CAST(row_number() OVER (PARTITION BY request_id ORDER BY fused DESC, node) AS INTEGER) AS position FROM f
)
SELECT n.request_id, n.node, n.fused, n.position FROM n JOIN retrievals t USING (request_id) WHERE n.position <= t.top_n
"""

_VECTORS = """
WITH v AS (
  SELECT node_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors
  WHERE node_id IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC) = 1
)"""

#: Words of documents and items with their places; the words of an item that a document holds twelve of in a row.
_WORDS = r"""
WITH w AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
), v AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL
), d AS (
  SELECT DISTINCT doc_id, i - 1 AS place, array_to_string(w[i:i + 11], ' ') AS g FROM w, range(1, len(w) - 10) t(i)
), e AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM v, range(1, len(w) - 10) t(i)
)"""

SQL: dict[str, str] = {
    "p3_nearest": _VECTORS + """
, d AS (
  SELECT a.node_id AS a, b.node_id AS b, coalesce(CASE WHEN list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0 THEN greatest(round(list_cosine_distance(a.e, b.e), 12), 0.0) END, 1.0) AS d
  FROM v a JOIN v b ON a.node_id <> b.node_id WHERE a.node_id % 20 = 0
)
SELECT a AS query_id, b AS node_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY a ORDER BY d, b) AS INTEGER) AS rank FROM d QUALIFY rank <= 10
""",
    "p4_ranking": _P4,
    "p6_spans": _WORDS + """
, h AS (SELECT DISTINCT doc_id, item_id, place FROM d JOIN e USING (g)),
s AS (SELECT *, CASE WHEN place <= lag(place) OVER p + 12 THEN 0 ELSE 1 END AS fresh FROM h WINDOW p AS (PARTITION BY doc_id, item_id ORDER BY place)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY place) AS run FROM s)
SELECT doc_id, item_id, min(place) AS start_word, max(place) + 12 AS end_word FROM n GROUP BY doc_id, item_id, run
""",
    "p7_curriculum": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight, max(max_repeats) AS most FROM mix_targets GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY source) - 1) % 2 AS falling FROM t)
SELECT r.source, CAST(step AS INTEGER) AS step, round(0.1 * CASE WHEN falling = 1 THEN 1.5 - (step + 0.5) / 10 ELSE 0.5 + (step + 0.5) / 10 END, 9)::DOUBLE AS planned, true AS kept
FROM r JOIN s USING (source), range(10) x(step) WHERE n > 0 AND weight > 0 AND most > 0
""",
    "p3_found": _VECTORS + """
, u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
d AS (
  SELECT a.node_id AS a, b.node_id AS b, round(list_cosine_distance(a.e, b.e), 12) AS d FROM u a JOIN u b ON a.node_id <> b.node_id
), r AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 10
)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM r WHERE d <= 0.1
""",
    "p4_found": f"SELECT request_id, node FROM ({_P4})",
    "p6_found": _WORDS + "SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    "p7_found": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1)
SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source))
WHERE coalesce(s.n, 0) * m.max_repeats < m.weight * (SELECT sum(n) FROM s)
""",
}
