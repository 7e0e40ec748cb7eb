"""Queries of the general graph-preparation operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hot_keys, schema_drift
from graphloom.sources import raw_records
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.trace(table(spark, folder, "node_bodies")).changes


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, folder, "node_bodies"))


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.load_records(table(spark, folder, "raw_lines"), table(spark, folder, "raw_files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.rejected_records(_loaded(spark, folder)).select("file_no", "line_no", "reason")


def p2_copy_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.copy_outcomes(_loaded(spark, folder))


def p2_node_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.node_bodies(_loaded(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys.hot_nodes(table(spark, folder, "edges")).select("side", "edge_type", "node")


def p5_entry_counts(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys.entry_counts(table(spark, folder, "edges"))


def p5_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    rows = hot_keys.sorted_adjacency(table(spark, folder, "edges"))
    return rows.select("side", "edge_type", "node", "chunk_no", F.transform("adj", lambda e: e["other"]).alias("others"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_table": p1_table,
    "p2_found": p2_found,
    "p2_copy_outcomes": p2_copy_outcomes,
    "p2_node_bodies": p2_node_bodies,
    "p5_found": p5_found,
    "p5_entry_counts": p5_entry_counts,
    "p5_adjacency": p5_adjacency,
}

_ENTRIES = """
WITH e AS (
  SELECT edge_id, src, dst, edge_type FROM edges WHERE edge_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC, src DESC, dst DESC, edge_type DESC) = 1
), n AS (
  SELECT 'out' AS side, edge_type, src AS node, dst AS other, edge_id FROM e
  UNION ALL SELECT 'in', edge_type, dst, src, edge_id FROM e
), c AS (SELECT side, edge_type, node, count(*) AS entries FROM n WHERE node IS NOT NULL GROUP BY ALL)
"""

_JSON_BARE = "regexp_replace({x}, '\"(?:\\\\.|[^\"\\\\])*\"', '\"\"', 'g')"


def _strict(x: str) -> str:
    """Whether `x` is one JSON text by RFC 8259; the engine's own check also takes NaN, Infinity and trailing commas."""
    bare = _JSON_BARE.format(x=x)
    return f"(json_valid({x}) AND NOT regexp_matches({bare}, '(?i)nan|inf') AND NOT regexp_matches({bare}, ',\\s*[\\]}}]'))"


#: Records with their fields, the reason why one does not load, and the typed values.
_RAW = rf"""
WITH f AS (FROM raw_files WHERE file_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY loaded_at DESC) = 1),
r AS (
  SELECT l.file_no, l.line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS x, format, layout, coalesce(delimiter, ',') AS d
  FROM raw_lines l JOIN f USING (file_no) WHERE NOT (format = 'csv' AND coalesce(line_no = 1, false))
), c AS (
  SELECT *, '("(?:[^"]|"")*"|[^"' || d || ']*)' AS field FROM r WHERE format = 'csv'
), s AS (
  SELECT *, regexp_full_match(x, '(?s)' || field || '(?:[' || d || ']' || field || ')*') AS quoted,
         list_transform(regexp_extract_all(d || x, '(?s)[' || d || ']' || field, 1), lambda v: CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END) AS v
  FROM c
), t AS (
  SELECT *, CASE layout WHEN 'copy_outcome' THEN 5 ELSE 3 END AS width FROM s
), n AS (
  SELECT file_no, line_no, layout, x, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> width THEN 'column_count'
    WHEN layout = 'copy_outcome' AND NOT ($INT(v[1]) AND v[2] <> '' AND v[3] IN ('nodes', 'relationships') AND $INT(v[4])
      AND regexp_full_match(v[5], '\d{{4}}-\d\d-\d\dT(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\dZ') AND try_strptime(v[5], '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL) THEN 'invalid_value'
    WHEN layout = 'node_body' AND NOT ($INT(v[1]) AND v[2] <> '' AND (v[3] = '' OR coalesce(CASE WHEN {_strict("v[3]")} THEN json_type(v[3]) = 'OBJECT' END, false))) THEN 'invalid_value'
    END AS reason, v FROM t
  UNION ALL
  SELECT file_no, line_no, layout, x, CASE WHEN NOT {_strict("x")} THEN 'bad_json' WHEN NOT (CASE WHEN {_strict("x")} THEN
      json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.label'), 'NULL') IN ('NULL', 'VARCHAR') AND coalesce(x ->> '$.label', 'x') <> ''
      AND coalesce(json_type(x, '$.labels'), 'ARRAY') = 'ARRAY' AND NOT list_bool_or(coalesce(list_transform(CAST(json_extract(x, '$.labels[*]') AS JSON[]), lambda y: json_type(y) <> 'VARCHAR'), [false]) || [false])
      AND (x ->> '$.label' IS NOT NULL OR list_bool_or(coalesce(list_transform(CAST(json_extract(x, '$.labels[*]') AS JSON[]), lambda y: json_type(y) = 'VARCHAR' AND y ->> '$' <> ''), [false]) || [false]))
      AND coalesce(json_type(x, '$.props'), 'OBJECT') = 'OBJECT' ELSE false END) THEN 'invalid_value' END, NULL FROM r WHERE format = 'jsonl'
)
"""


def _raw_sql(rest: str) -> str:
    out = _RAW + rest
    while "$INT(" in out:
        head, _, tail = out.partition("$INT(")
        cell, _, tail = tail.partition(")")
        digits = f"ltrim({cell}, '0')"
        out = head + f"(regexp_full_match({cell}, '[0-9]+') AND (length({digits}) < 19 OR length({digits}) = 19 AND {digits} <= '9223372036854775807'))" + tail
    return out


SQL: dict[str, str] = {
    "p1_found": """
WITH b AS (
  SELECT body_id, feed, file_no, node_id, coalesce(label, labels[1]) AS label,
         CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN props END AS props
  FROM node_bodies WHERE body_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY body_id ORDER BY received_at DESC) = 1
), top AS (
  SELECT body_id, feed, file_no, node_id, k.key AS path, k.value AS v, k.type AS t FROM b, json_each(b.props) k
), leaf AS (
  SELECT body_id, feed, file_no, node_id, path, v, t FROM top WHERE t <> 'OBJECT'
  UNION ALL
  SELECT o.body_id, o.feed, o.file_no, o.node_id, o.path || '.' || k.key, k.value, k.type
  FROM (SELECT * FROM top WHERE t = 'OBJECT') o, json_each(o.v) k
), val AS (
  SELECT body_id, feed, file_no, node_id, path,
         CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'float'
                WHEN 'ARRAY' THEN 'list' WHEN 'NULL' THEN NULL ELSE 'integer' END AS kind,
         CASE WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR)
              WHEN t <> 'NULL' THEN CAST(v AS VARCHAR) END AS v
  FROM leaf
), files AS (SELECT feed, file_no, count(*) AS records FROM b GROUP BY ALL),
lab AS (
  SELECT feed, file_no, label FROM b WHERE label IS NOT NULL GROUP BY feed, file_no, label
  QUALIFY row_number() OVER (PARTITION BY feed, file_no ORDER BY count(*) DESC, label DESC) = 1
), held AS (
  SELECT v.feed, v.file_no, v.path FROM val v JOIN files f USING (feed, file_no)
  GROUP BY v.feed, v.file_no, v.path, f.records HAVING count(*) * 5 >= f.records
), typed AS (
  SELECT feed, file_no, path, kind FROM val WHERE kind IS NOT NULL GROUP BY feed, file_no, path, kind
  QUALIFY row_number() OVER (PARTITION BY feed, file_no, path ORDER BY count(*) DESC, kind DESC) = 1
), p AS (SELECT h.*, t.kind FROM held h LEFT JOIN typed t USING (feed, file_no, path)),
step AS (
  SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS old_file FROM files
  QUALIFY old_file IS NOT NULL
), gone AS (
  SELECT s.feed, s.old_file, s.file_no, o.path FROM step s JOIN p o ON o.feed = s.feed AND o.file_no = s.old_file
  ANTI JOIN p n ON n.feed = s.feed AND n.file_no = s.file_no AND n.path = o.path
), come AS (
  SELECT s.feed, s.old_file, s.file_no, n.path FROM step s JOIN p n ON n.feed = s.feed AND n.file_no = s.file_no
  ANTI JOIN p o ON o.feed = s.feed AND o.file_no = s.old_file AND o.path = n.path
), renamed AS (
  SELECT g.feed, g.file_no, g.path AS old_name, c.path AS new_name
  FROM gone g JOIN come c USING (feed, file_no)
  JOIN val x ON x.feed = g.feed AND x.file_no = g.old_file AND x.path = g.path
  JOIN val y ON y.feed = c.feed AND y.file_no = c.file_no AND y.path = c.path AND y.node_id = x.node_id
  WHERE x.v IS NOT NULL AND y.v IS NOT NULL
  GROUP BY ALL HAVING count(*) FILTER (x.v = y.v) * 2 > count(*)
)
SELECT feed, file_no, 'renamed' AS change, old_name, new_name FROM renamed
UNION ALL
SELECT feed, file_no, 'removed', path, '' FROM gone g
  WHERE NOT EXISTS (FROM renamed r WHERE r.feed = g.feed AND r.file_no = g.file_no AND r.old_name = g.path)
UNION ALL
SELECT feed, file_no, 'added', '', path FROM come c
  WHERE NOT EXISTS (FROM renamed r WHERE r.feed = c.feed AND r.file_no = c.file_no AND r.new_name = c.path)
UNION ALL
SELECT s.feed, s.file_no, 'type_changed', n.path, n.path FROM step s
  JOIN p o ON o.feed = s.feed AND o.file_no = s.old_file
  JOIN p n ON n.feed = s.feed AND n.file_no = s.file_no AND n.path = o.path WHERE o.kind <> n.kind
UNION ALL
SELECT s.feed, s.file_no, 'relabelled', o.label, n.label FROM step s
  JOIN lab o ON o.feed = s.feed AND o.file_no = s.old_file
  JOIN lab n ON n.feed = s.feed AND n.file_no = s.file_no WHERE o.label <> n.label
""",
    "p2_found": _raw_sql("SELECT file_no, line_no, reason FROM n WHERE reason IS NOT NULL"),
    "p2_copy_outcomes": _raw_sql("""
SELECT file_no, line_no, CAST(v[1] AS BIGINT) AS copy_id, v[2] AS target, v[3] AS kind, CAST(v[4] AS BIGINT) AS count, strptime(v[5], '%Y-%m-%dT%H:%M:%SZ') AS finished_at
FROM n WHERE reason IS NULL AND layout = 'copy_outcome'"""),
    "p5_found": _ENTRIES + "SELECT side, edge_type, node FROM c WHERE entries >= 0.01 * (SELECT count(*) FROM e)",
    "p5_entry_counts": _ENTRIES + "SELECT side, edge_type, node, CAST(entries AS BIGINT) AS entries FROM c",
    "p5_adjacency": _ENTRIES
    + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY side, edge_type, node ORDER BY other NULLS FIRST, edge_id) AS pos FROM n WHERE node IS NOT NULL
)
SELECT side, edge_type, node, CAST((pos - 1) // 4096 AS INTEGER) AS chunk_no, list(other ORDER BY pos) AS others
FROM r GROUP BY side, edge_type, node, (pos - 1) // 4096
""",
}
