"""Write clauses: every statement yields a new immutable graph.

The read part of a statement becomes one frame; each write clause turns frame
rows into tables of new, changed or deleted elements. Nothing is visible until
the statement is through, and a failing check raises before the new graph
exists, so a statement applies as a whole or not at all. Later MATCH clauses of
the same statement see the old structure, while projections see new property
values of variables written before.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import values as v
from graphloom.functions.expressions import literal
from graphloom.functions.values import NULL, NodeParts, RelParts, Type, Value, convert, node_value, null_of, parts_of, rel_value, unify
from graphloom.operators.durable import materialize
from graphloom.operators.graph import Constraint, EdgeTable, NodeTable, PropertyGraph
from graphloom.plans import syntax as s
from graphloom.plans.compiler import Frame, Planner, Uses
from graphloom.plans.syntax import QueryError


@dataclass
class Changes:
    nodes: list[NodeTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)
    #: (kind, id and value rows, property): a null value removes the property
    props: list[tuple[str, DataFrame, str, Type]] = field(default_factory=list)
    #: (id rows, labels, add or remove)
    labels: list[tuple[DataFrame, tuple[str, ...], bool]] = field(default_factory=list)
    gone: list[tuple[str, DataFrame]] = field(default_factory=list)
    detach: bool = False


class Writer(Planner):
    def __init__(self, graph: PropertyGraph, params: dict, clock: dt.datetime, procedures: dict):
        super().__init__(graph, params, clock, procedures, rewrites=False)
        self.changes = Changes()
        self.next = {"node": _after(graph.ids()), "rel": _after(graph.edge_frame()[0].select("id"))}

    # ---- ids ----

    def numbered(self, df: DataFrame, kind: str, name: str) -> DataFrame:
        """Add an id column; the table is written, so the ids stay as they are."""
        base = self.next[kind]
        out = materialize(df.withColumn(name, F.monotonically_increasing_id() + F.lit(base)))
        top = out.agg(F.max(name)).first()[0]
        self.next[kind] = base if top is None else top + 1
        return out

    # ---- clauses ----

    def clause(self, frame: Frame, c) -> Frame:
        if isinstance(c, s.Create):
            for p in c.patterns:
                frame = self.create(frame, p)
            return frame
        if isinstance(c, s.Merge):
            return self.merge(frame, c)
        if isinstance(c, s.SetClause):
            return self.assign(frame, c.items)
        if isinstance(c, s.RemoveClause):
            return self.assign(frame, c.items, remove=True)
        if isinstance(c, s.Delete):
            return self.delete(frame, c)
        if isinstance(c, s.Foreach):
            return self.foreach(frame, c)
        return super().clause(frame, c)

    def frozen(self, frame: Frame) -> Frame:
        """The frame with its rows written, so that all writes see the same rows."""
        df = self.graph.spark.range(1).select(F.lit(1).alias(self.fresh("one"))) if frame.df is None else frame.df
        return Frame(materialize(df), frame.scope)

    def values_of(self, frame: Frame, props: s.Expr | None) -> dict[str, Value]:
        compile_ = self.compiler(frame)
        if props is None:
            return {}
        if isinstance(props, s.MapOf):
            out = {k: compile_(e) for k, e in props.items}
        else:
            out = {k: literal(x) for k, x in dict(self.constant(props)).items()}
        return {k: x for k, x in out.items() if x.type != NULL}

    def create(self, frame: Frame, p: s.PathPattern) -> Frame:
        frame = self.frozen(frame)
        for n in p.nodes:
            if n.var in frame.scope:
                if n.labels or n.props is not None or (not p.rels and n.named):
                    raise QueryError(f"{n.var} is already defined")
                if frame.scope[n.var].type.kind != "node":
                    raise QueryError(f"{n.var} is not a node")
                continue
            frame = self.new_node(frame, n)
        for at, r in enumerate(p.rels):
            if r.direction == "both" or len(r.types) != 1 or r.span is not None:
                raise QueryError("a created relationship needs one direction, one type and no length")
            if r.var in frame.scope:
                raise QueryError(f"{r.var} is already defined")
            a, b = p.nodes[at].var, p.nodes[at + 1].var
            frame = self.new_rel(frame, r, *((a, b) if r.direction == "out" else (b, a)))
        if p.var:
            ids = [parts_of(frame.scope[n.var]).id for n in p.nodes]
            rels = [parts_of(frame.scope[r.var]).id for r in p.rels]
            made = F.struct(F.array(*ids).alias("nodes"), F.array(*rels).cast("array<bigint>").alias("relationships"))
            frame = Frame(frame.df, frame.scope | {p.var: Value(made, v.PATH)})
        return frame

    def new_node(self, frame: Frame, n: s.NodePattern) -> Frame:
        props = self.values_of(frame, n.props)
        name = self.fresh("w")
        names = {k: self.fresh("wp") for k in props}
        df = self.numbered(frame.df.withColumns({names[k]: x.col for k, x in props.items()}) if props else frame.df, "node", name)
        labels = tuple(dict.fromkeys(n.labels))
        rows = df.select(F.col(name).alias("id"), *[F.col(names[k]).alias(k) for k in props])
        self.changes.nodes.append(NodeTable(rows if labels else rows.withColumn("labels", F.array().cast("array<string>")), labels or None))
        made = {k: Value(F.col(names[k]), x.type) for k, x in props.items()}
        parts = NodeParts(F.col(name), F.array(*[F.lit(x) for x in labels]).cast("array<string>"), made)
        return Frame(df, frame.scope | {n.var: node_value(parts)})

    def new_rel(self, frame: Frame, r: s.RelPattern, src: str, dst: str) -> Frame:
        props = self.values_of(frame, r.props)
        a, b = parts_of(frame.scope[src]).id, parts_of(frame.scope[dst]).id
        name, from_, to = self.fresh("w"), self.fresh("ws"), self.fresh("wd")
        names = {k: self.fresh("wp") for k in props}
        df = frame.df.withColumns({from_: a, to: b} | {names[k]: x.col for k, x in props.items()})
        df = self.numbered(df, "rel", name)
        if df.where(F.col(from_).isNull() | F.col(to).isNull()).take(1):
            raise QueryError("a relationship cannot be created at a null node")
        rows = df.select(F.col(name).alias("id"), F.col(from_).alias("src"), F.col(to).alias("dst"), *[F.col(names[k]).alias(k) for k in props])
        self.changes.edges.append(EdgeTable(rows, r.types[0]))
        made = {k: Value(F.col(names[k]), x.type) for k, x in props.items()}
        return Frame(df, frame.scope | {r.var: rel_value(RelParts(F.col(name), F.lit(r.types[0]), F.col(from_), F.col(to), made))})

    def merge(self, frame: Frame, c: s.Merge) -> Frame:
        """Rows whose pattern exists are matched; of the others, one per distinct pattern value creates it."""
        p = c.pattern
        if any(len(r.types) != 1 or r.span is not None for r in p.rels):
            raise QueryError("a merged relationship needs one type and no length")
        frame = self.frozen(frame)
        row = self.fresh("row")
        base = Frame(materialize(frame.df.withColumn(row, F.monotonically_increasing_id())), frame.scope)
        found = self.paths(base, [p])
        found = Frame(materialize(found.df), found.scope)
        rest = Frame(base.df.join(found.df.select(row).distinct(), row, "left_anti"), base.scope)
        # Rows that would create the same pattern create it once: they share bound nodes and property values.
        keys: dict[str, Any] = {}
        for x in (*p.nodes, *p.rels):
            if x.var in frame.scope:
                keys[self.fresh("mk")] = parts_of(frame.scope[x.var]).id
            else:
                for value in self.values_of(rest, x.props).values():
                    keys[self.fresh("mk")] = value.col
        rest_df = materialize(rest.df.withColumns(keys) if keys else rest.df)
        names = list(keys)
        first = rest_df.groupBy(*names).agg(F.min(row).alias("_first")) if names else rest_df.agg(F.min(row).alias("_first"))
        makers = Frame(rest_df.join(first.select("_first"), rest_df[row] == F.col("_first"), "left_semi"), frame.scope)
        directed = s.PathPattern(p.var, p.nodes, tuple(replace(r, direction="out") if r.direction == "both" else r for r in p.rels))
        made = self.create(makers, directed)
        made = self.assign(made, c.on_create)
        found = self.assign(found, c.on_match)
        # Back to one row per input row: created elements are looked up by the key of the pattern.
        pairs = {n: (found.scope[n], made.scope[n]) for n in found.scope if n not in frame.scope and n in made.scope}
        types = {n: unify([x.type for x in pair]) for n, pair in pairs.items()}
        column = {n: self.fresh("mv") for n in pairs}
        picked = lambda k: [convert(pair[k], types[n]).col.alias(column[n]) for n, pair in pairs.items()]
        matched = found.df.select(*base.df.columns, *picked(0))
        created = made.df.select(*[F.col(k).alias(f"j_{k}") for k in names], *picked(1))
        if names:
            same = [F.col(k).eqNullSafe(F.col(f"j_{k}")) for k in names]
            rest_rows = rest_df.join(created, same)
        else:
            rest_rows = rest_df.crossJoin(created)
        df = materialize(matched.unionByName(rest_rows.select(*matched.columns)))
        return Frame(df, frame.scope | {n: Value(F.col(column[n]), t) for n, t in types.items()})

    def assign(self, frame: Frame, items: list, remove: bool = False) -> Frame:
        if not items:
            return frame
        frame = self.frozen(frame)
        for item in items:
            if item.var not in frame.scope:
                raise QueryError(f"the variable {item.var} is not defined")
            target = frame.scope[item.var]
            if target.type == NULL:
                continue
            own = parts_of(target)
            if isinstance(item, s.SetLabels):
                if not isinstance(own, NodeParts):
                    raise QueryError("only nodes have labels")
                self.changes.labels.append((frame.df.where(own.id.isNotNull()).select(own.id.alias("id")).distinct(), item.labels, not remove))
                names = F.array(*[F.lit(x) for x in item.labels])
                new = F.array_except(own.labels, names) if remove else F.array_union(own.labels, names)
                frame = Frame(frame.df, frame.scope | {item.var: node_value(replace(own, labels=new))})
                continue
            value = self.compiler(frame)(item.value)
            if value.type.kind in ("node", "rel", "map", "path"):
                raise QueryError(f"a property cannot hold a {value.type}")
            name = self.fresh("sv")
            df = frame.df.withColumn(name, value.col)
            kind = "node" if isinstance(own, NodeParts) else "rel"
            rows = df.where(own.id.isNotNull()).groupBy(own.id.alias("id")).agg(F.last(name).alias("value"))
            self.changes.props.append((kind, materialize(rows), item.name, value.type))
            kept = own.props.get(item.name)
            t = value.type if value.type != NULL else (kept.type if kept else NULL)
            props = own.props | {item.name: convert(Value(F.col(name), value.type), t)}
            made = node_value(replace(own, props=props)) if kind == "node" else rel_value(replace(own, props=props))
            frame = Frame(df, frame.scope | {item.var: made})
        return frame

    def delete(self, frame: Frame, c: s.Delete) -> Frame:
        frame = self.frozen(frame)
        self.changes.detach |= c.detach
        for e in c.targets:
            x = self.compiler(frame)(e)
            if x.type == NULL:
                continue
            if x.type.kind == "list" and x.type.elem.kind in ("node", "rel"):
                rows = frame.df.select(F.explode(x.col).alias("x")).select(F.col("x.id").alias("id"))
                kind = x.type.elem.kind
            elif x.type.kind in ("node", "rel"):
                rows, kind = frame.df.select(parts_of(x).id.alias("id")), x.type.kind
            elif x.type.kind == "path":
                self.changes.gone.append(("rel", frame.df.select(F.explode(x.col["relationships"]).alias("id"))))
                rows, kind = frame.df.select(F.explode(x.col["nodes"]).alias("id")), "node"
            else:
                raise QueryError(f"a {x.type} cannot be deleted")
            self.changes.gone.append((kind, rows.where(F.col("id").isNotNull()).distinct()))
        return frame

    def foreach(self, frame: Frame, c: s.Foreach) -> Frame:
        frame = self.frozen(frame)
        inner = self.unwind(frame, s.Unwind(c.source, c.var))
        for clause in c.body:
            inner = self.clause(inner, clause)
        return frame

    # ---- the new graph ----

    def applied(self) -> PropertyGraph:
        c, graph = self.changes, self.graph
        nodes, edges = list(graph.nodes) + c.nodes, list(graph.edges) + c.edges
        for kind, rows, name, t in c.props:
            if kind == "node":
                nodes = [NodeTable(_with_prop(x.df, x.props(), rows, name, t), x.labels) for x in nodes]
            else:
                edges = [replace(x, df=_with_prop(x.df, x.props(), rows, name, t)) for x in edges]
        for rows, labels, add in c.labels:
            nodes = [y for x in nodes for y in _relabelled(x, rows, labels, add)]
        gone_rels = [r for k, r in c.gone if k == "rel"]
        gone_nodes = [r for k, r in c.gone if k == "node"]
        for rows in gone_rels:
            edges = [replace(x, df=x.df.join(rows, "id", "left_anti")) for x in edges]
        for rows in gone_nodes:
            for end in ("src", "dst"):
                ends = rows.select(F.col("id").alias(end))
                if c.detach:
                    edges = [replace(x, df=x.df.join(ends, end, "left_anti")) for x in edges]
                elif any(x.df.join(ends, end, "left_semi").take(1) for x in edges):
                    raise QueryError("a node that still has relationships cannot be deleted without DETACH")
            nodes = [NodeTable(x.df.join(rows, "id", "left_anti"), x.labels) for x in nodes]
        if c.props or c.labels or c.gone:
            nodes = [NodeTable(materialize(x.df), x.labels) for x in nodes]
            edges = [replace(x, df=materialize(x.df)) for x in edges]
        vectors = graph.vectors
        if vectors is not None:
            for rows in gone_nodes:
                vectors = vectors.join(rows.select(F.col("id").alias("node_id")), "node_id", "left_anti")
        out = replace(graph, nodes=tuple(nodes), edges=tuple(edges), vectors=vectors)
        for constraint in out.constraints:
            check(out, constraint)
        return out


def _after(ids: DataFrame) -> int:
    top = ids.agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1


def _with_prop(df: DataFrame, props: dict[str, Type], rows: DataFrame, name: str, t: Type) -> DataFrame:
    """`df` with the property of the rows' ids replaced; tables without such an id stay as they are."""
    new = rows.select(F.col("id"), F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    old = props.get(name)
    if old is None and t == NULL:
        return df
    if not df.join(new, "id", "left_semi").take(1):
        return df
    both = unify([x for x in (old, t) if x is not None])
    fresh = convert(Value(F.col("_new"), t), both).col
    kept = convert(Value(v.stored(F.col(f"`{name}`"), df.schema[name].dataType), old), both).col if old is not None else null_of(both)
    joined = df.join(new, "id", "left")
    return joined.withColumn(name, F.when(F.col("_hit"), fresh).otherwise(kept)).drop("_new", "_hit")


def _relabelled(x: NodeTable, rows: DataFrame, labels: tuple[str, ...], add: bool) -> list[NodeTable]:
    if x.labels is None:
        hit = x.df.join(rows.withColumn("_hit", F.lit(True)), "id", "left")
        names = F.array(*[F.lit(n) for n in labels])
        new = F.array_union("labels", names) if add else F.array_except("labels", names)
        return [NodeTable(hit.withColumn("labels", F.when(F.col("_hit"), new).otherwise(F.col("labels"))).drop("_hit"), None)]
    after = tuple(dict.fromkeys((*x.labels, *labels))) if add else tuple(n for n in x.labels if n not in labels)
    if after == x.labels:
        return [x]
    moved = x.df.join(rows, "id", "left_semi")
    if not moved.take(1):
        return [x]
    moved = moved if after else moved.withColumn("labels", F.array().cast("array<string>"))
    return [NodeTable(x.df.join(rows, "id", "left_anti"), x.labels), NodeTable(moved, after or None)]


def write(graph: PropertyGraph, statement: s.Single, params: dict, clock: dt.datetime, procedures: dict) -> tuple[DataFrame | None, PropertyGraph]:
    writer = Writer(graph, params, clock, procedures)
    writer.uses = Uses(statement.clauses)
    writer.params["  ends"] = writer.uses.ends
    frame, last = Frame(None), None
    for k, clause in enumerate(statement.clauses):
        if isinstance(clause, s.Return) and k != len(statement.clauses) - 1:
            raise QueryError("RETURN must come last")
        frame, last = writer.clause(frame, clause), clause
    result = None
    if isinstance(last, s.Return):
        result = materialize(_storable(writer.result(frame, writer.returned)[0]))
    return result, writer.applied()


def _storable(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---- constraints -----------------------------------------------------------------


def check(graph: PropertyGraph, c: Constraint) -> None:
    """Raise if the graph breaks the constraint; unique ignores nulls and takes 30 and 30.0 for equal."""
    if c.kind not in ("unique", "required"):
        return
    df, types = graph.node_frame((c.label,)) if c.on == "node" else graph.edge_frame((c.label,))
    column = F.col(f"p_{c.prop}") if c.prop in types else F.lit(None).cast("string")
    if c.kind == "required" and df.where(column.isNull()).take(1):
        raise QueryError(f"{c.label}.{c.prop} is required")
    if c.kind == "unique" and df.where(column.isNotNull()).groupBy(column.alias("x")).count().where("count > 1").take(1):
        raise QueryError(f"{c.label}.{c.prop} must be unique")


def define(graph: PropertyGraph, d: s.Ddl) -> PropertyGraph:
    """CREATE and DROP of indexes and constraints; a node index is a full-text index."""
    from graphloom.operators.search import create_text_index, drop_text_index

    if d.kind == "index" and d.on == "node" and d.label:
        return create_text_index(graph, d.label, d.prop) if d.action == "create" else drop_text_index(graph, d.label, d.prop)
    wanted = Constraint(d.kind, d.on, d.label, d.prop, d.name)
    if d.action == "create":
        check(graph, wanted)
        return replace(graph, constraints=(*graph.constraints, wanted))
    kept = tuple(c for c in graph.constraints if not (c.name == d.name if d.name and not d.label else (c.kind, c.on, c.label, c.prop) == (d.kind, d.on, d.label, d.prop)))
    return replace(graph, constraints=kept)
