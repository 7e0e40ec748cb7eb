"""Property graphs as immutable sets of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import Type, Value, convert, null_of, of_spark, stored, unify

NODE_KEYS = ("id", "labels")
EDGE_KEYS = ("id", "src", "dst", "type")


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one label set: ``id`` and properties; `labels` None means a ``labels`` column."""

    df: DataFrame
    labels: tuple[str, ...] | None

    def props(self) -> dict[str, Type]:
        return {f.name: of_spark(f.dataType) for f in self.df.schema.fields if f.name not in NODE_KEYS}


@dataclass(frozen=True)
class EdgeTable:
    """Relationships: ``id, src, dst`` and properties; `type` None means a ``type`` column.

    `src_label` and `dst_label` state, where known, the label all sources or
    destinations have; they let the compiler drop impossible hops and needless joins.
    """

    df: DataFrame
    type: str | None
    src_label: str | None = None
    dst_label: str | None = None

    def props(self) -> dict[str, Type]:
        return {f.name: of_spark(f.dataType) for f in self.df.schema.fields if f.name not in EDGE_KEYS}


@dataclass(frozen=True)
class Constraint:
    kind: str  # unique / required / index / text
    on: str  # node / relationship
    label: str
    prop: str
    name: str | None = None


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    vectors: DataFrame | None = None  # node_id, embedding
    metric: str = "cosine"
    extensions: dict[str, Any] = field(default_factory=dict, compare=False)

    # ---- building ----

    def with_nodes(self, df: DataFrame, *labels: str) -> PropertyGraph:
        """A graph with more nodes; `df` has ``id`` and one column per property."""
        return replace(self, nodes=(*self.nodes, NodeTable(df, tuple(labels) if labels or "labels" not in df.columns else None)))

    def with_edges(self, df: DataFrame, type: str | None = None, src_label: str | None = None, dst_label: str | None = None) -> PropertyGraph:
        """A graph with more relationships; `df` has ``id, src, dst`` and one column per property."""
        return replace(self, edges=(*self.edges, EdgeTable(df, type, src_label, dst_label)))

    def with_vectors(self, vectors: DataFrame, metric: str = "cosine") -> PropertyGraph:
        return replace(self, vectors=vectors, metric=metric)

    # ---- relations for the compiler and the algorithms ----

    def node_tables(self, labels: tuple[str, ...] = ()) -> list[NodeTable]:
        return [t for t in self.nodes if t.labels is None or all(label in t.labels for label in labels)]

    def node_frame(self, labels: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Type]]:
        """``id, labels`` and the properties of all nodes with these labels, with the property types."""
        tables = self.node_tables(labels)
        types = _merged([t.props() for t in tables])
        parts = []
        for t in tables:
            own = t.props()
            dtypes = {f.name: f.dataType for f in t.df.schema.fields}
            names = F.col("labels") if t.labels is None else F.array(*[F.lit(x) for x in t.labels]).cast("array<string>")
            df = t.df
            if t.labels is None:
                for label in labels:
                    df = df.where(F.array_contains("labels", label))
            parts.append(df.select(F.col("id").cast("bigint").alias("id"), names.alias("labels"), *_props(own, types, dtypes)))
        return _union(self.spark, parts, "id bigint, labels array<string>"), types

    def edge_tables(self, types: tuple[str, ...] = (), src: tuple[str, ...] = (), dst: tuple[str, ...] = ()) -> list[EdgeTable]:
        """Tables that may hold such relationships between nodes of such labels."""
        out = []
        for t in self.edges:
            if types and t.type is not None and t.type not in types:
                continue
            if not self._possible(t.src_label, src) or not self._possible(t.dst_label, dst):
                continue
            out.append(t)
        return out

    def _possible(self, known: str | None, wanted: tuple[str, ...]) -> bool:
        if known is None or not wanted:
            return True
        return any(t.labels is None or known in t.labels and all(w in t.labels for w in wanted) for t in self.nodes)

    def edge_frame(self, types: tuple[str, ...] = (), tables: list[EdgeTable] | None = None) -> tuple[DataFrame, dict[str, Type]]:
        tables = self.edge_tables(types) if tables is None else tables
        props = _merged([t.props() for t in tables])
        parts = []
        for t in tables:
            dtypes = {f.name: f.dataType for f in t.df.schema.fields}
            df = t.df.where(F.col("type").isin(*types)) if t.type is None and types else t.df
            kind = F.col("type") if t.type is None else F.lit(t.type)
            keys = [F.col(k).cast("bigint").alias(k) for k in ("id", "src", "dst")]
            parts.append(df.select(*keys, kind.alias("type"), *_props(t.props(), props, dtypes)))
        return _union(self.spark, parts, "id bigint, src bigint, dst bigint, type string"), props

    def links(self, types: tuple[str, ...] = ()) -> DataFrame:
        """``src, dst`` of all relationships, parallel ones included."""
        return self.edge_frame(types)[0].select("src", "dst")

    def ids(self) -> DataFrame:
        return self.node_frame()[0].select("id")

    # ---- reading ----

    def node_count(self) -> int:
        return self.ids().count()

    def edge_count(self) -> int:
        return self.links().count()

    def label_counts(self) -> DataFrame:
        return self.node_frame()[0].select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def edge_type_counts(self) -> DataFrame:
        return self.edge_frame()[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def node(self, node_id: int) -> DataFrame:
        return self.node_frame()[0].where(F.col("id") == node_id)

    def edge(self, edge_id: int) -> DataFrame:
        return self.edge_frame()[0].where(F.col("id") == edge_id)

    def neighbours(self, ids: DataFrame, direction: str = "both", types: tuple[str, ...] = ()) -> DataFrame:
        """``(id, edge_id, other, type, outgoing)`` of every relationship at the nodes in `ids` (column ``id``)."""
        edges = self.edge_frame(types)[0]
        out = edges.select(F.col("src").alias("id"), F.col("id").alias("edge_id"), F.col("dst").alias("other"), "type", F.lit(True).alias("outgoing"))
        come = edges.select(F.col("dst").alias("id"), F.col("id").alias("edge_id"), F.col("src").alias("other"), "type", F.lit(False).alias("outgoing"))
        both = {"out": out, "in": come, "both": out.unionByName(come)}[direction]
        return both.join(ids.select("id").distinct(), "id")

    def nodes_by_label(self, label: str) -> DataFrame:
        return self.node_frame((label,))[0]

    def edges_by_type(self, type: str) -> DataFrame:
        return self.edge_frame((type,))[0]

    def node_exists(self, node_id: int) -> bool:
        return bool(self.ids().where(F.col("id") == node_id).take(1))

    def node_labels(self, node_id: int) -> list[str] | None:
        row = self.node(node_id).select("labels").first()
        return None if row is None else list(row["labels"])

    def has_relationships(self, node_id: int) -> bool:
        return bool(self.links().where((F.col("src") == node_id) | (F.col("dst") == node_id)).take(1))

    def property_values(self, name: str, label: str | None = None) -> DataFrame:
        """``(id, value)`` of all nodes that have the property."""
        df, types = self.node_frame((label,) if label else ())
        value = F.col(f"p_{name}") if name in types else F.lit(None).cast("string")
        return df.select("id", value.alias("value")).where(F.col("value").isNotNull())

    def property_range(self, name: str, label: str | None = None) -> tuple | None:
        """Smallest and largest value of a property, None if no node has it."""
        row = self.property_values(name, label).agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        return None if row["a"] is None else (row["a"], row["b"])

    def property_groups(self, name: str, label: str | None = None) -> DataFrame:
        """``(value, n)``: how many nodes have each value."""
        return self.property_values(name, label).groupBy("value").agg(F.count(F.lit(1)).alias("n"))

    # ---- queries ----

    def query(self, text: str, procedures: dict | None = None, **params: Any) -> DataFrame:
        """The result of a read query."""
        from graphloom.plans.engine import run

        return run(self, text, params, procedures).df

    def execute(self, text: str, procedures: dict | None = None, **params: Any):
        """Run a query that may write: the outcome has ``df`` and the new ``graph``."""
        from graphloom.plans.engine import run

        return run(self, text, params, procedures)

    def explain(self, text: str, **params: Any) -> str:
        from graphloom.plans.engine import explain

        return explain(self, text, params)


def _merged(all_props: list[dict[str, Type]]) -> dict[str, Type]:
    kinds: dict[str, list[Type]] = {}
    for props in all_props:
        for n, t in props.items():
            kinds.setdefault(n, []).append(t)
    return {n: unify(ts) for n, ts in kinds.items()}


def _props(own: dict[str, Type], types: dict[str, Type], dtypes: dict) -> list:
    return [
        (convert(Value(stored(F.col(f"`{n}`"), dtypes[n]), own[n]), t).col if n in own else null_of(t)).alias(f"p_{n}") for n, t in types.items()
    ]


def _union(spark: SparkSession, parts: list[DataFrame], ddl: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], ddl)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
