"""Bulk import and export of graphs: COPY, EXPORT DATABASE, IMPORT DATABASE, snapshots.

Files are CSV, JSON lines or Parquet, single files or folders of part files. A
row with ``_from`` and ``_to`` is a relationship (its type in ``_type`` or
``_etype``, else the COPY target); any other row is a node (``_id`` and
``_labels`` optional, the target is the label where ``_labels`` is absent; an
empty ``_labels`` means no label). All other columns are properties. A bad file
raises and nothing is imported.

CSV cells are typed per column: integers, then floats, booleans, JSON lists of
strings, and else strings; an empty cell is null. Whether a cell was quoted is
not known to Spark's reader, so quoted numbers become numbers too.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from graphloom.operators.durable import materialize
from graphloom.operators.graph import Constraint, EdgeTable, NodeTable, PropertyGraph
from graphloom.plans import syntax as s
from graphloom.plans.syntax import QueryError

RESERVED = ("_id", "_labels", "_label", "_from", "_to", "_type", "_etype")


def _format(path: str, options: dict[str, Any]) -> str:
    if "format" in options:
        kind = str(options["format"]).lower()
    else:
        kind = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"
    return {"jsonl": "json", "ndjson": "json", "json": "json", "parquet": "parquet"}.get(kind, "csv")


def read(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    kind = _format(path, options)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("mode", "FAILFAST").json(path)
    header = bool(options.get("header", True))
    delimiter = options.get("delimiter", options.get("delim", ","))
    df = (
        spark.read.option("mode", "FAILFAST").option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"')
        .option("multiLine", True).option("nullValue", None).option("emptyValue", "").csv(path)
    )
    if not header:
        df = df.toDF(*[f"col{i}" for i in range(len(df.columns))])
    return _typed(df)


def _typed(df: DataFrame) -> DataFrame:
    """Give every string column the narrowest type that all its values have."""
    cells = {n: F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in df.columns}
    tests = {
        "bigint": lambda c: c.try_cast("bigint").isNotNull() & c.rlike(r"^-?\d+$"),
        "double": lambda c: c.try_cast("double").isNotNull() & c.rlike(r"^-?[\d.]+([eE][+-]?\d+)?$"),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
        "array<string>": lambda c: c.startswith("[") & F.from_json(c, "array<string>").isNotNull(),
    }
    counts = [F.sum((cells[n].isNotNull() & ~F.coalesce(t(cells[n]), F.lit(False))).cast("int")).alias(f"{i}|{k}") for i, n in enumerate(df.columns) for k, t in tests.items()]
    if not counts:
        return df
    bad = df.agg(*counts).first()
    out = []
    for i, n in enumerate(df.columns):
        kind = next((k for k in tests if not bad[f"{i}|{k}"]), "string") if bad[f"{i}|bigint"] is not None else "string"
        c = F.from_json(cells[n], kind) if kind.startswith("array") else cells[n].cast(kind)
        out.append(c.alias(n))
    return df.select(*out)


def _is_edges(columns: list[str]) -> bool:
    if "_from" in columns and "_to" in columns:
        return True
    if "from" in columns and "to" in columns and not {"_id", "_labels", "_label"} & set(columns):
        raise QueryError("rows with from and to need the names _from and _to to be relationships")
    return False


def copy(graph: PropertyGraph, target: str, path: str, options: dict[str, Any] | None = None) -> tuple[DataFrame, PropertyGraph]:
    """Import one file: the outcome row ``(target, kind, count)`` and the new graph."""
    df = read(graph.spark, path, options or {})
    add = _add_edges if _is_edges(df.columns) else _add_nodes
    graph, count = add(graph, target, df)
    kind = "relationships" if add is _add_edges else "nodes"
    return graph.spark.createDataFrame([(target, kind, count)], "target string, kind string, count bigint"), graph


def _next_id(ids: DataFrame) -> int:
    top = ids.agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1


def _properties(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in RESERVED]


def _add_nodes(graph: PropertyGraph, target: str, df: DataFrame) -> tuple[PropertyGraph, int]:
    props = _properties(df)
    base = _next_id(graph.ids())
    label = F.array(F.lit(target))
    labels = label
    if "_labels" in df.columns:
        own = F.col("_labels")
        if isinstance(df.schema["_labels"].dataType, st.StringType):
            own = F.coalesce(F.from_json(own, "array<string>"), F.when(own != "", F.split(own, ":")))
        labels = F.coalesce(own.cast("array<string>"), label)
    if "_id" in df.columns:
        if df.where(F.col("_id").isNull()).take(1) or df.groupBy("_id").count().where("count > 1").take(1):
            raise QueryError("the _id of every node must be given once")
        clash = base > 0 and df.join(graph.ids(), df["_id"] == F.col("id"), "left_semi").take(1)
        key = F.col("_id").cast("bigint") + F.lit(base if clash else 0)
        source = F.col("_id").cast("bigint")
    else:
        key, source = F.monotonically_increasing_id() + F.lit(base), F.lit(None).cast("bigint")
    rows = materialize(df.select(key.alias("id"), source.alias("_source"), labels.alias("labels"), *[F.col(f"`{p}`") for p in props]))
    known = graph.extensions.get("imported")
    fresh = rows.where(F.col("_source").isNotNull()).select(F.col("_source").alias("source"), "id")
    imported = fresh if known is None else known.join(fresh, "source", "left_anti").unionByName(fresh)
    rows = rows.drop("_source")
    sets = rows.select("labels").distinct().limit(2).collect()
    if len(sets) == 1 and sets[0]["labels"]:
        table = NodeTable(rows.drop("labels"), tuple(sets[0]["labels"]))
    else:
        table = NodeTable(rows, None)
    return replace(graph, nodes=(*graph.nodes, table), extensions=graph.extensions | {"imported": imported}), rows.count()


def _add_edges(graph: PropertyGraph, target: str, df: DataFrame) -> tuple[PropertyGraph, int]:
    props = _properties(df)
    ids = graph.extensions.get("imported")
    if ids is None:
        ids = graph.ids().select(F.col("id").alias("source"), "id")
    named = [F.col(n).cast("string") for n in ("_type", "_etype") if n in df.columns]
    base = _next_id(graph.edge_frame()[0].select("id"))
    rows = df.select(
        (F.monotonically_increasing_id() + F.lit(base)).alias("id"),
        F.col("_from").cast("bigint").alias("_from"),
        F.col("_to").cast("bigint").alias("_to"),
        F.coalesce(*named, F.lit(target)).alias("type"),
        *[F.col(f"`{p}`") for p in props],
    )
    rows = materialize(rows)
    total = rows.count()
    mapped = rows.join(ids.select(F.col("source").alias("_from"), F.col("id").alias("src")), "_from").join(
        ids.select(F.col("source").alias("_to"), F.col("id").alias("dst")), "_to"
    )
    mapped = materialize(mapped.select("id", "src", "dst", "type", *[F.col(f"`{p}`") for p in props]))
    if mapped.count() != total:
        raise QueryError("a relationship names a node that was not imported")
    kinds = mapped.select("type").distinct().limit(2).collect()
    table = EdgeTable(mapped.drop("type"), kinds[0]["type"]) if len(kinds) == 1 else EdgeTable(mapped, None)
    return replace(graph, edges=(*graph.edges, table)), total


# ---- export and import of whole graphs ----------------------------------------------


def _flat(df: DataFrame, form: str) -> DataFrame:
    """CSV has no nested values: they become JSON text."""
    if form != "csv":
        return df
    return df.select(
        *[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (st.ArrayType, st.StructType, st.MapType)) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    )


def export(graph: PropertyGraph, folder: str, form: str = "jsonl") -> None:
    """Write ``nodes.*``, ``edges.*``, ``schema.cypher`` and ``copy.cypher`` into `folder`."""
    if form not in ("jsonl", "csv", "parquet"):
        raise QueryError(f"unknown format {form}")
    nodes, node_types = graph.node_frame()
    edges, edge_types = graph.edge_frame()
    n = nodes.select(F.col("id").alias("_id"), F.col("labels").alias("_labels"), *[F.col(f"`p_{p}`").alias(p) for p in node_types])
    e = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("type").alias("_type"), *[F.col(f"`p_{p}`").alias(p) for p in edge_types])
    for name, df in (("nodes", n), ("edges", e)):
        writer = _flat(df, form).write.mode("errorifexists")
        path = f"{folder}/{name}.{form}"
        if form == "parquet":
            writer.parquet(path)
        elif form == "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        else:
            writer.json(path)
    lines = [f"COPY {kind} FROM '{folder}/{name}.{form}' WITH {{format: '{form}'}}" for kind, name in (("Node", "nodes"), ("RELATED", "edges"))]
    _text(graph.spark, f"{folder}/copy.cypher", lines)
    _text(graph.spark, f"{folder}/schema.cypher", [_ddl(c) for c in graph.constraints])


def _ddl(c: Constraint) -> str:
    where = f"(x:`{c.label}`)" if c.on == "node" else f"()-[x:`{c.label}`]-()"
    rule = {"unique": "IS UNIQUE", "required": "IS NOT NULL"}.get(c.kind)
    if rule:
        return f"CREATE CONSTRAINT FOR {where} REQUIRE x.`{c.prop}` {rule}"
    return f"CREATE INDEX FOR {where} ON (x.`{c.prop}`)"


def _text(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def import_(graph: PropertyGraph, folder: str) -> tuple[DataFrame, PropertyGraph]:
    """Apply the schema, then every COPY, of an export."""
    from graphloom.plans.engine import run

    out = None
    for name in ("copy.cypher", "schema.cypher"):
        for row in graph.spark.read.text(f"{folder}/{name}").collect():
            if row["value"].strip():
                result = run(graph, row["value"], {})
                graph, out = result.graph, result.df if result.df is not None else out
    return out, graph


def run(graph: PropertyGraph, statement) -> tuple[DataFrame | None, PropertyGraph]:
    if isinstance(statement, s.Copy):
        return copy(graph, statement.target, statement.path, statement.options)
    if isinstance(statement, s.Export):
        export(graph, statement.path, str(statement.options.get("format", "jsonl")).lower())
        return None, graph
    return import_(graph, statement.path)


# ---- snapshots -----------------------------------------------------------------------


def save(graph: PropertyGraph, folder: str) -> None:
    """A snapshot that `load` restores: one Parquet table per node and relationship table."""
    rows = []
    for kind, tables in (("node", graph.nodes), ("edge", graph.edges)):
        for t in tables:
            path = f"{folder}/{kind}-{uuid.uuid4().hex}"
            t.df.write.parquet(path)
            if kind == "node":
                rows.append((kind, path, list(t.labels) if t.labels is not None else None, None, None, None))
            else:
                rows.append((kind, path, None, t.type, t.src_label, t.dst_label))
    if graph.vectors is not None:
        graph.vectors.write.parquet(f"{folder}/vectors")
        rows.append(("vectors", f"{folder}/vectors", None, graph.metric, None, None))
    ddl = "kind string, path string, labels array<string>, type string, src_label string, dst_label string"
    graph.spark.createDataFrame(rows, ddl).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/catalog")
    done = [(c.kind, c.on, c.label, c.prop, c.name) for c in graph.constraints]
    graph.spark.createDataFrame(done, "kind string, on string, label string, prop string, name string").coalesce(1).write.parquet(f"{folder}/constraints")


def load(spark: SparkSession, folder: str) -> PropertyGraph:
    graph = PropertyGraph(spark)
    for row in spark.read.parquet(f"{folder}/catalog").collect():
        df = spark.read.parquet(row["path"])
        if row["kind"] == "node":
            graph = replace(graph, nodes=(*graph.nodes, NodeTable(df, tuple(row["labels"]) if row["labels"] is not None else None)))
        elif row["kind"] == "edge":
            graph = replace(graph, edges=(*graph.edges, EdgeTable(df, row["type"], row["src_label"], row["dst_label"])))
        else:
            graph = replace(graph, vectors=df, metric=row["type"])
    known = tuple(Constraint(r["kind"], r["on"], r["label"], r["prop"], r["name"]) for r in spark.read.parquet(f"{folder}/constraints").collect())
    return replace(graph, constraints=known)
