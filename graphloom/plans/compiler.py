"""Compile the clauses of a query to DataFrame operations.

A frame is a DataFrame plus a scope of named values. Every scan renames its
columns to fresh names, so a frame can hold any number of nodes and
relationships without clashes and Catalyst prunes what is not used. A node that
is needed for its identity only is never joined: the end of the relationship is
the node.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import values as v
from graphloom.functions.expressions import Compiler, equals, literal, sort_key
from graphloom.functions.scalars import has_aggregate, is_aggregate
from graphloom.functions.values import FLOAT, INT, NULL, NodeParts, RelParts, Type, Value, convert, list_of, node_value, parts_of, rel_value, unify
from graphloom.operators.durable import materialize
from graphloom.operators.graph import PropertyGraph
from graphloom.plans import syntax as s
from graphloom.plans.syntax import QueryError

#: Functions over the neighbourhoods of two nodes, and the columns of `link_scores` they name.
LINK_SCORES = {
    "link.commonneighbors": "common_neighbors",
    "link.jaccard": "jaccard",
    "link.adamicadar": "adamic_adar",
    "link.resourceallocation": "resource_allocation",
    "link.preferentialattachment": "preferential_attachment",
}


@dataclass
class Frame:
    df: DataFrame | None  # None: one empty row
    scope: dict[str, Value] = field(default_factory=dict)


class Uses:
    """Which properties of which variables a statement may touch; ``*`` stands for the whole value."""

    def __init__(self, clauses: list):
        self.of: dict[str, set[str]] = {}
        self.same: list[tuple[str, str]] = []
        self.ends: dict[str, tuple[str, str]] = {}  # relationship -> the nodes of its hop
        asked: set[str] = set()
        self.asked = asked
        for clause in clauses:
            self._clause(clause)
        for r in asked & set(self.ends):
            for n in self.ends[r]:
                self._add(n, "*")
        for _ in self.same:
            for a, b in self.same:
                self.of.setdefault(a, set()).update(self.of.get(b, ()))

    def needs_row(self, var: str) -> bool:
        return bool(self.of.get(var))

    def _add(self, var: str, what: str) -> None:
        self.of.setdefault(var, set()).add(what)

    def _clause(self, c) -> None:
        if isinstance(c, s.Match):
            for p in c.patterns:
                self._pattern(p)
            self._expr(c.where)
        elif isinstance(c, s.Unwind):
            self._expr(c.expr)
        elif isinstance(c, (s.With, s.Return)):
            b = c.body
            if b.star:
                self.star()
            for item in b.items:
                if isinstance(item.expr, s.Var) and isinstance(c, s.With):
                    self.same.append((item.expr.name, item.name))
                else:
                    self._expr(item.expr)
            for e, _ in b.order:
                self._expr(e)
            self._expr(getattr(c, "where", None))
        elif isinstance(c, s.CallProcedure):
            self._expr(c.where)
        else:  # writes
            self.star()

    def star(self) -> None:
        self.of = _Everything()

    def _pattern(self, p: s.PathPattern) -> None:
        for at, r in enumerate(p.rels):
            if r.named and r.span is None:
                self.ends[r.var] = (p.nodes[at].var, p.nodes[at + 1].var)
        for x in (*p.nodes, *p.rels):
            if x.props is not None:
                if isinstance(x.props, s.MapOf):
                    for k, e in x.props.items:
                        self._add(x.var, k)
                        self._expr(e)
                else:
                    self._add(x.var, "*")

    def _expr(self, e) -> None:
        if e is None:
            return
        if isinstance(e, s.Prop) and isinstance(e.base, s.Var):
            self._add(e.base.name, e.name)
        elif isinstance(e, s.Var):
            self._add(e.name, "*")
        elif isinstance(e, s.HasLabels) and isinstance(e.x, s.Var):
            self._add(e.x.name, "  labels")
        elif isinstance(e, s.Call) and e.name.lower() in ("startnode", "endnode") and len(e.args) == 1 and isinstance(e.args[0], s.Var):
            self.asked.add(e.args[0].name)
        elif isinstance(e, s.Call) and e.name.lower() in ("id", "count") and len(e.args) == 1 and isinstance(e.args[0], s.Var):
            pass
        elif isinstance(e, s.IsNull) and isinstance(e.x, s.Var):
            pass
        elif isinstance(e, s.Binary) and e.op in ("=", "<>") and isinstance(e.a, s.Var) and isinstance(e.b, s.Var):
            pass
        else:
            if isinstance(e, s.PatternComprehension):
                self._pattern(e.pattern)
            for c in s.children(e):
                self._expr(c)


class _Everything(dict):
    def get(self, key, default=None):
        return {"*"}

    def setdefault(self, key, default=None):
        return set()


class Planner:
    """Compiles one statement over one graph."""

    def __init__(self, graph: PropertyGraph, params: dict[str, Any], clock: dt.datetime, procedures: dict[str, Callable], rewrites: bool = True):
        self.graph = graph
        self.params = dict(params) | {"  metric": graph.metric}
        self.clock = clock
        self.procedures = procedures
        self.rewrites = rewrites
        self.count = 0
        self.uses = Uses([])
        self.trails: set[str] = set()  # columns that hold the relationship ids of variable-length hops

    # ---- helpers ----

    def fresh(self, stem: str) -> str:
        self.count += 1
        return f"{stem}{self.count}"

    def compiler(self, frame: Frame, extra: dict | None = None) -> Compiler:
        return Compiler(frame.scope, self.params, self.clock, extra)

    def data(self, frame: Frame) -> DataFrame:
        return frame.df if frame.df is not None else self.graph.spark.range(1).select()

    def constant(self, e: s.Expr) -> Any:
        """The value of an expression without variables."""
        if isinstance(e, s.Lit):
            return e.value
        if isinstance(e, s.Param):
            if e.name not in self.params:
                raise QueryError(f"the parameter ${e.name} is missing")
            return self.params[e.name]
        if isinstance(e, s.ListOf):
            return [self.constant(x) for x in e.items]
        if isinstance(e, s.MapOf):
            return {k: self.constant(x) for k, x in e.items}
        if any(isinstance(x, s.Var) for x in s.walk(e)) and not any(isinstance(x, (s.Comprehension, s.Reduce, s.Quantifier)) for x in s.walk(e)):
            raise QueryError("a constant expression is needed here")
        value = self.compiler(Frame(None))(e)
        return self.graph.spark.range(1).select(value.col.alias("x")).first()["x"]

    def whole_number(self, e: s.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.constant(e)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise QueryError(f"{what} needs a non-negative integer")
        return n

    # ---- statements ----

    def read(self, statement) -> tuple[DataFrame, list[tuple[str, Type]]]:
        if isinstance(statement, s.Union):
            left, a = self.read(statement.left)
            right, b = self.read(statement.right)
            if [n for n, _ in a] != [n for n, _ in b]:
                raise QueryError("the parts of a UNION need the same column names")
            types = [unify([x, y]) for (_, x), (_, y) in zip(a, b)]
            shaped = [
                df.select(*[convert(Value(F.col(f"`{n}`"), t), to).col.alias(n) for (n, t), to in zip(cols, types)]) for df, cols in ((left, a), (right, b))
            ]
            out = shaped[0].union(shaped[1])
            return (out if statement.all else out.distinct()), [(n, t) for (n, _), t in zip(a, types)]
        self.uses = Uses(statement.clauses)
        self.params["  ends"] = self.uses.ends
        frame, last = Frame(None), None
        clauses = statement.clauses
        for k, clause in enumerate(clauses):
            if isinstance(clause, s.Return):
                if k != len(clauses) - 1:
                    raise QueryError("RETURN must come last")
                if self.rewrites and (short := self.shortcut(clauses)):
                    return short
            frame, last = self.clause(frame, clause), clause
        if isinstance(last, s.CallProcedure):
            return self.result(frame, list(frame.scope))
        if not isinstance(last, s.Return):
            raise QueryError("a read query must end with RETURN")
        return self.result(frame, self.returned)

    def result(self, frame: Frame, names: list[str]) -> tuple[DataFrame, list[tuple[str, Type]]]:
        out = [(n, frame.scope[n]) for n in names]
        return self.data(frame).select(*[x.col.alias(n) for n, x in out]), [(n, x.type) for n, x in out]

    def clause(self, frame: Frame, c) -> Frame:
        if isinstance(c, s.Match):
            return self.optional(frame, c) if c.optional else self.match(frame, c)
        if isinstance(c, s.Unwind):
            return self.unwind(frame, c)
        if isinstance(c, s.With):
            for item in c.body.items:
                if not item.aliased and not isinstance(item.expr, s.Var):
                    raise QueryError(f"{item.name} needs an alias in WITH")
            return self.project(frame, c.body, c.where)
        if isinstance(c, s.Return):
            return self.project(frame, c.body, None)
        if isinstance(c, s.CallProcedure):
            return self.call(frame, c)
        raise QueryError(f"{type(c).__name__} is not a read clause")

    # ---- UNWIND and CALL ----

    def unwind(self, frame: Frame, c: s.Unwind) -> Frame:
        frame, extra = self.lift(frame, [c.expr])
        x = self.compiler(frame, extra)(c.expr)
        if c.var in frame.scope:
            raise QueryError(f"{c.var} is already defined")
        df, name = self.data(frame), self.fresh("u")
        if x.type == NULL or x.type.kind == "list" and x.type.elem == NULL:
            if x.type == NULL:
                df = df.where(F.lit(False))
            t, col = NULL, F.explode(x.col) if x.type.kind == "list" else x.col
        elif x.type.kind == "list":
            t, col = x.type.elem, F.explode(x.col)
        else:
            t, col = x.type, F.explode(F.when(x.col.isNotNull(), F.array(x.col)))
        return Frame(df.withColumn(name, col), frame.scope | {c.var: Value(F.col(name), t)})

    def call(self, frame: Frame, c: s.CallProcedure) -> Frame:
        key = c.name.lower()
        maker = self.procedures.get(key) or self.procedures.get(key.partition(".")[2])
        if maker is None:
            raise QueryError(f"unknown procedure {c.name}")
        args = [self.constant(a) for a in c.args] if c.args is not None else None
        rows = maker(self.graph, args, self.params)
        columns = rows.columns
        wanted = [(n, n) for n in columns] if not c.yields else c.yields
        scope = dict(frame.scope)
        renamed = []
        for source, alias in wanted:
            if source not in columns:
                raise QueryError(f"{c.name} does not yield {source}")
            if alias in scope:
                raise QueryError(f"{alias} is already defined")
            name = self.fresh("y")
            dtype = rows.schema[source].dataType
            renamed.append(v.stored(F.col(f"`{source}`"), dtype).alias(name))
            scope[alias] = Value(F.col(name), v.of_spark(dtype))
        rows = rows.select(*renamed)
        out = Frame(rows if frame.df is None else frame.df.crossJoin(rows), scope)
        return self.filter(out, c.where)

    def filter(self, frame: Frame, where: s.Expr | None) -> Frame:
        if where is None:
            return frame
        frame, extra = self.lift(frame, [where])
        return Frame(self.data(frame).where(self.compiler(frame, extra).boolean(where)), frame.scope)

    # ---- pattern comprehensions ----

    def lift(self, frame: Frame, exprs: list[s.Expr]) -> tuple[Frame, dict[s.Expr, Value]]:
        """Turn what needs the graph (pattern comprehensions, members of paths, ends of relationships, link scores) into joined columns."""
        extra: dict[s.Expr, Value] = {}
        scored: dict[tuple, dict[str, Value]] = {}
        for e in exprs:
            counted = {id(a) for x in s.walk(e) if isinstance(x, s.Call) and x.name.lower() == "size" for a in x.args}  # ids will do
            for x in s.walk(e):
                if x in extra:
                    continue
                if isinstance(x, s.PatternComprehension):
                    frame, extra[x] = self.lifted(frame, x)
                elif id(x) in counted:
                    continue
                elif isinstance(x, s.Var) and x.name in frame.scope and _name(frame.scope[x.name].col) in self.trails:
                    frame, extra[x] = self.members(frame, frame.scope[x.name].col, False)
                elif isinstance(x, s.Call):
                    name, own = x.name.lower(), frame.scope.get(x.args[0].name) if len(x.args) == 1 and isinstance(x.args[0], s.Var) else None
                    if own is not None and own.type == v.PATH and name in ("nodes", "relationships", "rels"):
                        field_ = "nodes" if name == "nodes" else "relationships"
                        frame, extra[x] = self.members(frame, own.col[field_], name == "nodes")
                    elif own is not None and own.type.kind == "rel" and name in ("startnode", "endnode"):
                        ends = self.uses.ends.get(x.args[0].name)
                        if ends is None or any(n not in frame.scope for n in ends):
                            frame, extra[x] = self.member(frame, parts_of(own).src if name == "startnode" else parts_of(own).dst)
                    elif len(x.args) == 2 and (score := LINK_SCORES.get(".".join(name.split(".")[-2:]))):
                        if x.args not in scored:
                            frame, scored[x.args] = self.link_scores(frame, x.args, extra)
                        extra[x] = scored[x.args][score]
        return frame, extra

    def members(self, frame: Frame, ids: Column, nodes: bool) -> tuple[Frame, Value]:
        """The nodes or relationships of a list of ids: every distinct list is looked up once."""
        key, at, one, item, out = (self.fresh(x) for x in ("k", "p", "i", "m", "l"))
        rows, value = self.catalogue(nodes)
        df = self.data(frame)
        lists = df.select(ids.alias(key)).where(F.col(key).isNotNull()).distinct()
        each = lists.select(key, F.posexplode(key).alias(at, one)).join(rows.select(F.col("id").alias(f"{one}x"), value.col.alias(item)), F.col(one) == F.col(f"{one}x"))
        whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(item)))).alias(out))
        whole = whole.select(F.col(key).alias(f"{key}x"), F.transform(out, lambda x: x[item]).alias(out))
        t = list_of(value.type)
        joined = df.join(whole, ids == F.col(f"{key}x"), "left")
        return Frame(joined, frame.scope), Value(F.when(ids.isNotNull(), F.coalesce(F.col(out), F.array().cast(v.ddl(t)))), t)

    def member(self, frame: Frame, node_id: Column) -> tuple[Frame, Value]:
        """The node of an id."""
        key, out = self.fresh("k"), self.fresh("m")
        rows, value = self.catalogue(True)
        joined = self.data(frame).join(rows.select(F.col("id").alias(key), value.col.alias(out)), node_id == F.col(key), "left")
        return Frame(joined, frame.scope), Value(F.col(out), value.type)

    def catalogue(self, nodes: bool) -> tuple[DataFrame, Value]:
        rows, types = self.graph.node_frame() if nodes else self.graph.edge_frame()
        props = {n: Value(F.col(f"`p_{n}`"), t) for n, t in types.items()}
        if nodes:
            return rows, node_value(NodeParts(F.col("id"), F.col("labels"), props))
        return rows, rel_value(RelParts(F.col("id"), F.col("type"), F.col("src"), F.col("dst"), props))

    def link_scores(self, frame: Frame, args: tuple, extra: dict) -> tuple[Frame, dict[str, Value]]:
        """All neighbourhood scores of two nodes or node ids, computed once per distinct pair."""
        from graphloom.operators.centrality import link_scores

        ends = []
        for x in (self.compiler(frame, extra)(a) for a in args):
            if x.type.kind == "node":
                ends.append(parts_of(x).id)
            elif x.type in (INT, NULL):
                ends.append(x.col.cast("bigint"))
            else:
                raise QueryError("link scores need nodes or their ids")
        a, b = self.fresh("k"), self.fresh("k")
        df = self.data(frame).withColumns({a: ends[0], b: ends[1]})
        pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
        names = {score: self.fresh("s") for score in LINK_SCORES.values()}
        rows = link_scores(self.graph, pairs).select(F.col("a").alias(f"{a}x"), F.col("b").alias(f"{b}x"), *[F.col(n).cast("double").alias(c) for n, c in names.items()])
        joined = df.join(rows, (F.col(a) == F.col(f"{a}x")) & (F.col(b) == F.col(f"{b}x")), "left").drop(f"{a}x", f"{b}x")
        return Frame(joined, frame.scope), {n: Value(F.col(c), FLOAT) for n, c in names.items()}

    def lifted(self, frame: Frame, e: s.PatternComprehension) -> tuple[Frame, Value]:
        shared = [n.var for n in e.pattern.nodes if n.var in frame.scope]
        shared = list(dict.fromkeys(shared))
        inner = Frame(None)
        if shared:
            # The distinct outer nodes of the pattern are the seeds; other outer values travel with them.
            seeds = self.data(frame)
            outer = {n: x for n, x in frame.scope.items() if any(isinstance(y, s.Var) and y.name == n for y in s.walk(e)) or n in shared}
            keep = [c for x in outer.values() for c in _columns(x)]
            inner = Frame(seeds.select(*dict.fromkeys(keep)).distinct(), outer)
        inner = self.paths(inner, [e.pattern])
        inner = self.filter(inner, e.where)
        inner, more = self.lift(inner, [e.result])
        item = self.compiler(inner, more)(e.result)
        name = self.fresh("pc")
        if not shared:
            rows = self.data(inner).agg(F.collect_list(item.col).alias(name))
            out = self.data(frame).crossJoin(rows)
        else:
            keys = [c for n, x in frame.scope.items() if n in inner.scope and (n in shared or any(isinstance(y, s.Var) and y.name == n for y in s.walk(e))) for c in _keys(x)]
            keys = list(dict.fromkeys(keys))
            alias = {k: self.fresh("k") for k in keys}
            rows = self.data(inner).groupBy(*[F.col(k).alias(a) for k, a in alias.items()]).agg(F.collect_list(item.col).alias(name))
            condition = _all([F.col(k).eqNullSafe(F.col(a)) for k, a in alias.items()])
            out = self.data(frame).join(rows, condition, "left")
        t = list_of(item.type)
        return Frame(out, frame.scope), Value(F.coalesce(F.col(name), F.array().cast(v.ddl(t))), t)

    # ---- MATCH ----

    def match(self, frame: Frame, c: s.Match) -> Frame:
        return self.filter(self.paths(frame, c.patterns), c.where)

    def optional(self, frame: Frame, c: s.Match) -> Frame:
        """Plan the pattern on its own, then left-join it on the variables it shares."""
        names = [x.var for p in c.patterns for x in (*p.nodes, *p.rels)]
        shared = [n for n in dict.fromkeys(names) if n in frame.scope]
        inner = self.paths(Frame(None), c.patterns, outer=frame.scope)
        own, joint = [], []
        for part in _conjuncts(c.where):
            variables = {x.name for x in s.walk(part) if isinstance(x, s.Var)}
            lists = any(isinstance(x, s.PatternComprehension) for x in s.walk(part))
            (own if variables <= set(inner.scope) or lists else joint).append(part)
        for part in own:
            inner = self.filter(inner, part)
        left, right = self.data(frame), self.data(inner)
        scope = frame.scope | {n: x for n, x in inner.scope.items() if n not in frame.scope}
        conditions = [parts_of(frame.scope[n]).id == parts_of(inner.scope[n]).id for n in shared]
        both = self.compiler(Frame(None, inner.scope | frame.scope))
        conditions += [both.boolean(p) for p in joint]
        if frame.df is None:
            left = self.graph.spark.range(1).select(F.lit(1).alias(self.fresh("one")))
        out = left.join(right, _all(conditions) if conditions else F.lit(True), "left")
        return Frame(out, scope)

    def paths(self, frame: Frame, patterns: list[s.PathPattern], outer: dict[str, Value] | None = None) -> Frame:
        todo = list(patterns)
        while todo:
            linked = next((p for p in todo if any(n.var in frame.scope for n in p.nodes)), todo[0])
            todo.remove(linked)
            frame = self.path(frame, linked)
        return frame

    def path(self, frame: Frame, p: s.PathPattern) -> Frame:
        anchor = self.anchor(frame, p)
        used: list[tuple[tuple[str, ...], Value]] = []
        start = p.nodes[anchor]
        first = None  # the hop that may stand in for the scan of the anchor
        if start.var not in frame.scope and not start.props and p.rels and not self.uses.needs_row(start.var):
            at = anchor if anchor < len(p.rels) else anchor - 1
            if p.rels[at].span is None and self.implied(p, at, anchor):
                first = at
        if first is None:
            frame = self.node(frame, start)
        trail = {}  # per relationship position: (nodes array between, relationship array)
        order = [(i, i, i + 1) for i in range(anchor, len(p.rels))] + [(i - 1, i, i - 1) for i in range(anchor, 0, -1)]
        if first == anchor - 1:
            order = [(i - 1, i, i - 1) for i in range(anchor, 0, -1)]
        for at, near, far in order:
            frame, trail[at] = self.hop(frame, p, at, near, far, used)
        if p.var is not None:
            if p.var in frame.scope:
                raise QueryError(f"{p.var} is already defined")
            frame = Frame(frame.df, frame.scope | {p.var: self.path_value(frame, p, trail)})
        return frame

    def path_value(self, frame: Frame, p: s.PathPattern, trail: dict) -> Value:
        ids = [parts_of(frame.scope[n.var]).id for n in p.nodes]
        nodes, rels = F.array(ids[0]), F.array().cast("array<bigint>")
        for at in range(len(p.rels)):
            between, own = trail[at]
            nodes = F.concat(nodes, between, F.array(ids[at + 1])) if between is not None else F.concat(nodes, F.array(ids[at + 1]))
            rels = F.concat(rels, own)
        if any(r.span is not None for r in p.rels):  # a hop of length 0 repeats its node
            nodes = F.slice(nodes, F.lit(1), F.size(rels) + 1) if len(p.rels) == 1 else nodes
        present = _all([i.isNotNull() for i in ids])
        return Value(F.when(present, F.struct(nodes.alias("nodes"), rels.alias("relationships"))), v.PATH)

    def anchor(self, frame: Frame, p: s.PathPattern) -> int:
        """Where to start: a bound node, else one with property conditions, else a labelled one."""

        def rank(i: int) -> tuple:
            n = p.nodes[i]
            return (n.var in frame.scope, n.props is not None, bool(n.labels) and i in (0, len(p.nodes) - 1), -i)

        return max(range(len(p.nodes)), key=rank)

    def implied(self, p: s.PathPattern, at: int, node: int) -> bool:
        """Whether the relationship at `at` alone guarantees the labels of the pattern node."""
        wanted = p.nodes[node].labels
        rel = p.rels[at]
        if not wanted:
            return True
        if rel.direction == "both":
            return False
        left, right = p.nodes[at].labels, p.nodes[at + 1].labels
        src, dst = (left, right) if rel.direction == "out" else (right, left)
        source = (node == at) == (rel.direction == "out")
        tables = self.graph.edge_tables(rel.types, src, dst)
        known = [(t.src_label if source else t.dst_label) for t in tables]
        return bool(tables) and all(k is not None and self._always(k, wanted) for k in known)

    def _always(self, known: str, wanted: tuple[str, ...]) -> bool:
        tables = self.graph.node_tables((known,))
        return bool(tables) and all(t.labels is not None and all(w in t.labels for w in wanted) for t in tables)

    def scan(self, n: s.NodePattern) -> tuple[DataFrame, Value]:
        df, types = self.graph.node_frame(n.labels)
        stem = self.fresh("n")
        names = {"id": f"{stem}_id", "labels": f"{stem}_labels"} | {f"p_{k}": f"{stem}_p{i}" for i, k in enumerate(types)}
        df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
        props = {k: Value(F.col(names[f"p_{k}"]), t) for k, t in types.items()}
        return df, node_value(NodeParts(F.col(names["id"]), F.col(names["labels"]), props))

    def node(self, frame: Frame, n: s.NodePattern) -> Frame:
        """Bind a pattern node, or check the conditions on one that is bound."""
        if n.var in frame.scope:
            bound = frame.scope[n.var]
            if bound.type == NULL:
                return Frame(self.data(frame).where(F.lit(False)), frame.scope)
            if bound.type.kind != "node":
                raise QueryError(f"{n.var} is not a node")
            df = self.data(frame)
            if frame.scope[n.var].parts is None or n.labels or n.props is not None:
                own = parts_of(bound)
                tests = [F.array_contains(own.labels, label) for label in n.labels]
                df = df.where(_all([own.id.isNotNull(), *tests]))
            return self.with_props(Frame(df, frame.scope), n.var, n.props)
        df, value = self.scan(n)
        joined = df if frame.df is None else frame.df.crossJoin(df)
        return self.with_props(Frame(joined, frame.scope | {n.var: value}), n.var, n.props)

    def with_props(self, frame: Frame, var: str, props: s.Expr | None) -> Frame:
        if props is None:
            return frame
        tests = self.prop_tests(frame, parts_of(frame.scope[var]).props, props)
        return Frame(self.data(frame).where(_all(tests)), frame.scope) if tests else frame

    def prop_tests(self, frame: Frame, own: dict[str, Value], props: s.Expr) -> list[Column]:
        compile_ = self.compiler(frame)
        if isinstance(props, s.MapOf):
            wanted = {k: compile_(e) for k, e in props.items}
        else:
            wanted = {k: literal(x) for k, x in dict(self.constant(props)).items()}
        return [equals(own.get(k) or literal(None), x) for k, x in wanted.items()]

    def relation(self, frame: Frame, p: s.PathPattern, at: int) -> tuple[DataFrame, RelParts, str, str]:
        """The relationships of one hop, with the columns of its left and right end."""
        rel = p.rels[at]
        left, right = p.nodes[at].labels, p.nodes[at + 1].labels
        if rel.direction == "both":
            tables = list({id(t): t for t in (*self.graph.edge_tables(rel.types, left, right), *self.graph.edge_tables(rel.types, right, left))}.values())
        else:
            tables = self.graph.edge_tables(rel.types, *((left, right) if rel.direction == "out" else (right, left)))
        df, types = self.graph.edge_frame(rel.types, tables)
        stem = self.fresh("r")
        names = {k: f"{stem}_{k}" for k in ("id", "src", "dst", "type")} | {f"p_{k}": f"{stem}_p{i}" for i, k in enumerate(types)}
        df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
        props = {k: Value(F.col(names[f"p_{k}"]), t) for k, t in types.items()}
        parts = RelParts(F.col(names["id"]), F.col(names["type"]), F.col(names["src"]), F.col(names["dst"]), props)
        if rel.direction == "out":
            return df, parts, names["src"], names["dst"]
        if rel.direction == "in":
            return df, parts, names["dst"], names["src"]
        a, b = f"{stem}_a", f"{stem}_b"
        ways = F.when(parts.src == parts.dst, F.array(F.struct(parts.src.alias(a), parts.dst.alias(b)))).otherwise(
            F.array(F.struct(parts.src.alias(a), parts.dst.alias(b)), F.struct(parts.dst.alias(a), parts.src.alias(b)))
        )
        return df.select("*", F.inline(ways)), parts, a, b

    def hop(self, frame: Frame, p: s.PathPattern, at: int, near: int, far: int, used: list) -> tuple[Frame, tuple]:
        rel, target = p.rels[at], p.nodes[far]
        if rel.span is not None:
            return self.stretch(frame, p, at, near, far, used)
        edges, parts, left, right = self.relation(frame, p, at)
        close, end = (left, right) if near < far else (right, left)
        bound_rel = frame.scope.get(rel.var)
        if near_var := frame.scope.get(p.nodes[near].var):
            condition = F.col(close) == parts_of(near_var).id
            conditions = [condition]
            if target.var in frame.scope:
                conditions.append(F.col(end) == parts_of(frame.scope[target.var]).id)
            if bound_rel is not None:
                conditions.append(parts.id == parts_of(bound_rel).id)
            df = self.data(frame).join(edges, _all(conditions))
            scope = dict(frame.scope)
        else:  # the relationship is the scan of its first node
            df = edges if frame.df is None else frame.df.crossJoin(edges)
            scope = frame.scope | {p.nodes[near].var: node_value(NodeParts(F.col(close), _labels(p.nodes[near].labels), {}))}
        if bound_rel is None:
            scope[rel.var] = rel_value(parts)
        frame = Frame(df, scope)
        tests = [F.col(close) == F.col(end)] if p.nodes[near].var == target.var else []
        if rel.props is not None:
            tests += self.prop_tests(frame, parts.props, rel.props)
        for types, other in used:
            if not types or not rel.types or set(types) & set(rel.types):
                tests.append(~F.array_contains(other.col, parts.id) if other.type.kind == "list" else other.col != parts.id)
        if tests:
            frame = Frame(frame.df.where(_all(tests)), frame.scope)
        used.append((rel.types, Value(parts.id, INT)))
        return self.arrive(frame, p, at, far, end), (None, F.array(parts.id))

    def arrive(self, frame: Frame, p: s.PathPattern, at: int, far: int, end: str) -> Frame:
        """Bind the node at the end of a hop."""
        target = p.nodes[far]
        if target.var in frame.scope:
            return self.node(frame, target) if target.labels or target.props is not None else frame
        single = p.rels[at].span is None and self.implied(p, at, far)
        if not self.uses.needs_row(target.var) and target.props is None and (not target.labels or single):
            value = node_value(NodeParts(F.col(end), _labels(target.labels), {}))
            return Frame(frame.df, frame.scope | {target.var: value})
        df, value = self.scan(target)
        joined = frame.df.join(df, F.col(end) == parts_of(value).id)
        return self.with_props(Frame(joined, frame.scope | {target.var: value}), target.var, target.props)

    def stretch(self, frame: Frame, p: s.PathPattern, at: int, near: int, far: int, used: list) -> tuple[Frame, tuple]:
        """A variable-length hop: all trails (no relationship twice) of the wanted lengths."""
        rel, target = p.rels[at], p.nodes[far]
        low, high = rel.span
        if rel.var in frame.scope:
            raise QueryError(f"{rel.var} is already defined")
        trail, ends, between = self.fresh("t"), self.fresh("e"), self.fresh("b")
        empty = F.array().cast("array<bigint>")
        start = parts_of(frame.scope[p.nodes[near].var]).id
        state = self.data(frame).select("*", empty.alias(trail), start.alias(ends), empty.alias(between))
        rows = [state] if low == 0 else []
        # The labels at the ends hold for the ends only, not for every hop.
        loose = s.PathPattern(None, (s.NodePattern("", False), s.NodePattern("", False)), (rel,))
        length = 0
        while high is None or length < high:
            length += 1
            edges, parts, left, right = self.relation(frame, loose, 0)
            close, end = (left, right) if near < far else (right, left)
            tests = [~F.array_contains(F.col(trail), parts.id)]
            if rel.props is not None:
                tests += self.prop_tests(frame, parts.props, rel.props)
            for types, other in used:
                if not types or not rel.types or set(types) & set(rel.types):
                    tests.append(~F.array_contains(other.col, parts.id) if other.type.kind == "list" else other.col != parts.id)
            grown = state.join(edges, F.col(close) == F.col(ends)).where(_all(tests))
            keep = [c for c in state.columns if c not in (trail, ends, between)]
            way = F.array_append(F.col(trail), parts.id) if near < far else F.array_prepend(F.col(trail), parts.id)
            passed = F.when(F.size(trail) == 0, F.col(between)).otherwise(
                F.array_append(F.col(between), F.col(ends)) if near < far else F.array_prepend(F.col(between), F.col(ends))
            )
            state = grown.select(*keep, way.alias(trail), F.col(end).alias(ends), passed.alias(between))
            if high is None:
                state = materialize(state)
                if not state.take(1):
                    break
            if length >= low:
                rows.append(state)
        if not rows:
            rows = [state.where(F.lit(False))]
        df = rows[0]
        for more in rows[1:]:
            df = df.unionByName(more)
        value = Value(F.col(trail), list_of(INT))
        self.trails.add(trail)
        frame = Frame(df, frame.scope | {rel.var: value})
        if target.var in frame.scope:
            frame = Frame(frame.df.where(F.col(ends) == parts_of(frame.scope[target.var]).id), frame.scope)
        used.append((rel.types, value))
        return self.arrive(frame, p, at, far, ends), (F.col(between), F.col(trail))

    # ---- projections ----

    def project(self, frame: Frame, body: s.Projection, where: s.Expr | None) -> Frame:
        items = list(body.items)
        if body.star:
            own = sorted(n for n in frame.scope if not n.startswith("  "))
            if not own and not items:
                raise QueryError("there is nothing to return for *")
            items = [s.Item(s.Var(n), n, False) for n in own] + items
        names = [i.name for i in items]
        if len(set(names)) != len(names):
            raise QueryError("two columns have the same name")
        frame, extra = self.lift(frame, [i.expr for i in items] + [e for e, _ in body.order])
        grouped = any(has_aggregate(i.expr) for i in items)
        if grouped or any(has_aggregate(e) for e, _ in body.order):
            if not grouped:
                raise QueryError("ORDER BY cannot aggregate where the projection does not")
            out, order_scope, known = self.aggregate(frame, items, body.order, extra)
        else:
            out, known = self.plain(frame, items, extra), dict(extra)
            order_scope = frame.scope | out.scope
        if body.distinct:
            out = self.distinct(out)
            order_scope = dict(out.scope)
        for item in items:  # the projected form of an expression stands for the expression
            known[item.expr] = out.scope[item.name]
        df = self.data(out)
        if body.order:
            compile_ = Compiler(order_scope, self.params, self.clock, known)
            keys = []
            for e, ascending in body.order:
                key = sort_key(compile_(e))
                keys.append(key.asc_nulls_last() if ascending else key.desc_nulls_first())
            df = df.orderBy(*keys)
        skip, limit = self.whole_number(body.skip, "SKIP"), self.whole_number(body.limit, "LIMIT")
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        self.returned = names
        return self.filter(Frame(df, out.scope), where)

    def plain(self, frame: Frame, items: list[s.Item], extra: dict) -> Frame:
        compile_ = self.compiler(frame, extra)
        df, scope, new = self.data(frame), {}, {}
        for item in items:
            value = compile_(item.expr)
            if value.parts is None and not (isinstance(item.expr, s.Var)):
                name = self.fresh("c")
                new[name] = value.col
                value = Value(F.col(name), value.type, None, value.constant)
            scope[item.name] = value
        return Frame(df.withColumns(new) if new else df, scope)

    def distinct(self, frame: Frame) -> Frame:
        keys = [c for x in frame.scope.values() for c in _keys(x)]
        keep = [c for x in frame.scope.values() for c in _columns(x)]
        df = self.data(frame).select(*dict.fromkeys(keep))
        return Frame(df.dropDuplicates(list(dict.fromkeys(keys))) if keys else df.limit(1), frame.scope)

    def aggregate(self, frame: Frame, items: list[s.Item], order: list, extra: dict) -> tuple[Frame, dict, dict]:
        compile_ = self.compiler(frame, extra)
        calls: dict[s.Expr, tuple[str, Column, Type]] = {}
        before: dict[str, Column] = {}
        for e in [i.expr for i in items] + [x for x, _ in order]:
            for x in s.walk(e):
                if is_aggregate(x) and x not in calls:
                    if any(has_aggregate(a) for a in x.args):
                        raise QueryError("aggregates cannot be nested")
                    if any(isinstance(y, s.Call) and y.name.lower() == "rand" for a in x.args for y in s.walk(a)):
                        raise QueryError("rand() is not allowed inside an aggregate")
                    calls[x] = self.aggregate_call(compile_, x, before)
        keys: list[Column] = []
        carried: dict[str, Column] = {}
        known: dict[s.Expr, Value] = {}
        scope: dict[str, Value] = {}
        for item in items:
            if has_aggregate(item.expr):
                continue
            value = compile_(item.expr)
            if value.parts is not None:
                own, new = value.parts, {}
                rename = lambda c: new.setdefault(_name(c), self.fresh("g"))
                keys.append(own.id.alias(rename(own.id)))
                rest = [own.labels] if isinstance(own, NodeParts) else [own.type, own.src, own.dst]
                for c in (*rest, *(q.col for q in own.props.values())):
                    if _name(c) is not None and _name(c) not in new:
                        carried[rename(c)] = F.first(c)
                again = lambda c: F.col(new[_name(c)]) if _name(c) in new else c
                props = {k: Value(again(q.col), q.type) for k, q in own.props.items()}
                if isinstance(own, NodeParts):
                    value = node_value(NodeParts(again(own.id), again(own.labels), props))
                else:
                    value = rel_value(RelParts(again(own.id), again(own.type), again(own.src), again(own.dst), props))
            else:
                name = self.fresh("g")
                keys.append((value.col + 0.0 if value.type == FLOAT else value.col).alias(name))
                value = Value(F.col(name), value.type)
            known[item.expr] = value
            scope[item.name] = value
        columns = [c.alias(n) for n, c, _ in calls.values()] + [c.alias(n) for n, c in carried.items()]
        rows = self.data(frame).withColumns(before) if before else self.data(frame)
        df = rows.groupBy(*keys).agg(*columns) if columns else rows.select(*keys).distinct()
        known |= {e: Value(F.col(n), t) for e, (n, _, t) in calls.items()}
        # Only what is grouped by may appear beside aggregates.
        visible = scope | {i.expr.name: known[i.expr] for i in items if isinstance(i.expr, s.Var) and i.expr in known}
        after = Compiler(visible, self.params, self.clock, known)
        new: dict[str, Column] = {}
        for item in items:
            if item.name in scope:
                continue
            value = after(item.expr)
            name = self.fresh("c")
            new[name] = value.col
            scope[item.name] = Value(F.col(name), value.type)
        scope = {i.name: scope[i.name] for i in items}
        return Frame(df.withColumns(new) if new else df, scope), visible | scope, known

    def aggregate_call(self, compile_: Compiler, e: s.Call, before: dict[str, Column]) -> tuple[str, Column, Type]:
        """Name, column and type of an aggregate; `before` collects the columns it needs to exist first."""
        name, kind = self.fresh("a"), e.name.lower()
        if kind == "count" and e.star:
            return name, F.count(F.lit(1)), INT
        if not 1 <= len(e.args) <= 2 or (len(e.args) == 2) != kind.startswith("percentile"):
            raise QueryError(f"wrong number of arguments of {e.name}")
        x = compile_(e.args[0])
        c = parts_of(x).id if x.type.kind in ("node", "rel") and kind in ("count", "min", "max") else x.col
        if kind == "count":
            return name, (F.count_distinct(c) if e.distinct else F.count(c)), INT
        if kind == "collect":
            t = list_of(x.type)
            return name, (F.collect_set(x.col) if e.distinct else F.collect_list(x.col)), t
        if kind in ("min", "max"):
            return name, (F.min(c) if kind == "min" else F.max(c)), x.type
        if x.type == NULL:
            x = Value(F.lit(None).cast("bigint"), INT)
            c = x.col
        if x.type == v.DURATION and kind in ("sum", "avg"):
            fields = [F.sum(c[n]) for n in ("months", "days", "seconds", "nanos")]
            from graphloom.functions.temporal import make_duration, scale

            total = make_duration(*fields)
            return name, (total if kind == "sum" else scale(Value(total, v.DURATION), F.lit(1.0) / F.count(c["days"])).col), v.DURATION
        if not x.type.numeric:
            raise QueryError(f"{e.name} needs numbers, not {x.type}")
        if kind == "sum":
            total = F.sum_distinct(c) if e.distinct else F.sum(c)
            return name, F.coalesce(total, F.lit(0).cast(v.ddl(x.type))), x.type
        if kind == "avg":
            return name, _average(c, e.distinct), FLOAT
        if kind in ("stdev", "stdevp"):
            spread = F.stddev_samp if kind == "stdev" else F.stddev_pop
            if e.distinct:  # over the distinct values: their set is exploded inside the aggregate
                values = F.collect_set(c.cast("double"))
                return name, _spread_of(values, kind == "stdev"), FLOAT
            return name, F.coalesce(spread(c.cast("double")), F.lit(0.0)), FLOAT
        share = self.constant(e.args[1])
        if not isinstance(share, (int, float)) or isinstance(share, bool) or not 0 <= share <= 1:
            raise QueryError("a percentile must lie between 0 and 1")
        if kind == "percentilecont":
            return name, F.percentile(c.cast("double"), F.lit(float(share))), FLOAT
        # A histogram of the distinct values, never a list of all of them.
        argument = self.fresh("x")
        before[argument] = c.cast("double")
        return name, F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY {argument})"), FLOAT

    # ---- rewrites ----

    def shortcut(self, clauses: list) -> tuple[DataFrame, list[tuple[str, Type]]] | None:
        return self.two_hop_count(clauses) or self.grouped_degree(clauses)

    def grouped_degree(self, clauses: list) -> tuple[DataFrame, list[tuple[str, Type]]] | None:
        """Counts of one hop grouped by its other end: relationships are counted per node before the node is joined."""
        if len(clauses) != 2 or not isinstance(clauses[0], s.Match):
            return None
        m, body = clauses[0], clauses[1].body
        p = m.patterns[0]
        if m.optional or len(m.patterns) != 1 or len(p.rels) != 1 or p.var or body.star or p.rels[0].span or p.rels[0].props is not None:
            return None
        exprs = [i.expr for i in body.items] + [e for e, _ in body.order] + ([m.where] if m.where is not None else [])
        seen = {x.name for e in exprs for x in s.walk(e) if isinstance(x, s.Var)} - {i.name for i in body.items if i.aliased}
        kept = next((i for i in (0, 1) if seen == {p.nodes[i].var}), None)
        aggregates = [x for e in exprs for x in s.walk(e) if is_aggregate(x)]
        special = any(isinstance(x, s.PatternComprehension) for e in exprs for x in s.walk(e))
        if kept is None or special or not aggregates or any(not x.star for x in aggregates) or m.where is not None and has_aggregate(m.where):
            return None
        other = 1 - kept
        if p.nodes[other].props is not None or p.nodes[0].var == p.nodes[1].var or not self.implied(p, 0, other):
            return None
        edges, _, left, right = self.relation(Frame(None), p, 0)
        end, number = (left, right)[kept], self.fresh("n")
        counted = edges.groupBy(F.col(end)).agg(F.count(F.lit(1)).alias(number))
        nodes = self.node(Frame(None), p.nodes[kept])
        joined = nodes.df.join(counted, F.col(end) == parts_of(nodes.scope[p.nodes[kept].var]).id)
        frame = self.filter(Frame(joined, nodes.scope | {"  n": Value(F.col(number), INT)}), m.where)
        total = s.Call("sum", (s.Var("  n"),))
        swap = lambda e: _replaced(e, lambda x: total if is_aggregate(x) else None)
        items = [s.Item(swap(i.expr), i.name, i.aliased) for i in body.items]
        out = self.project(frame, replace(body, items=items, order=[(swap(e), up) for e, up in body.order]), None)
        return self.result(out, self.returned)

    def two_hop_count(self, clauses: list) -> tuple[DataFrame, list[tuple[str, Type]]] | None:
        """Two-hop path counts from degrees: one row per middle node instead of one per path."""
        if len(clauses) != 2 or not isinstance(clauses[0], s.Match):
            return None
        m, body = clauses[0], clauses[1].body
        if m.optional or m.where is not None or len(m.patterns) != 1 or body.order or body.skip or body.limit or body.star:
            return None
        p = m.patterns[0]
        if len(p.rels) != 2 or p.var or any(r.span or r.props or r.direction == "both" for r in p.rels) or any(n.props for n in p.nodes):
            return None
        if len({n.var for n in p.nodes}) != 3 or len(body.items) != 1 or body.distinct:
            return None
        item = body.items[0]
        if not (isinstance(item.expr, s.Call) and item.expr.star and item.expr.name.lower() == "count"):
            return None
        if not all(self.implied(p, at, node) for at, node in ((0, 0), (0, 1), (1, 1), (1, 2))):
            return None
        sides = []
        for at, end in ((0, 1), (1, 0)):
            edges, parts, left, right = self.relation(Frame(None), p, at)
            middle = F.col(right if end else left)
            sides.append((edges, parts, middle, F.col(left), F.col(right)))
        a = sides[0][0].groupBy(sides[0][2].alias("m")).agg(F.count(F.lit(1)).alias("x"))
        b = sides[1][0].groupBy(sides[1][2].alias("m")).agg(F.count(F.lit(1)).alias("y"))
        total = a.join(b, "m").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n"))
        shared = not p.rels[0].types or not p.rels[1].types or set(p.rels[0].types) & set(p.rels[1].types)
        reuse = None
        if shared:
            # A relationship that could serve as both hops must not: loops if the hops run alike, every one if they turn back.
            edges, parts, _, _ = self.relation(Frame(None), p, 0)
            common = tuple(set(p.rels[0].types) & set(p.rels[1].types)) if p.rels[0].types and p.rels[1].types else p.rels[0].types or p.rels[1].types
            own = edges.where(parts.type.isin(*common)) if common else edges
            if p.rels[0].direction == p.rels[1].direction:
                own = own.where(parts.src == parts.dst)
            reuse = own.agg(F.count(F.lit(1)).alias("k"))
        out = total.select((F.col("n") - (reuse.scalar() if reuse is not None else 0)).alias(item.name))
        return out, [(item.name, INT)]


# ---- small helpers ---------------------------------------------------------------


def _labels(labels: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in labels]).cast("array<string>")


def _replaced(e, change: Callable):
    """The expression with every part for which `change` gives something else replaced."""
    new = change(e)
    if new is not None:
        return new
    if isinstance(e, tuple):
        return tuple(_replaced(x, change) for x in e)
    if isinstance(e, s.Expr) and not isinstance(e, s.Lit):
        return replace(e, **{k: _replaced(x, change) for k, x in vars(e).items() if isinstance(x, (s.Expr, tuple))})
    return e


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _average(c: Column, distinct: bool) -> Column:
    if not distinct:
        return F.avg(c)
    return F.sum_distinct(c) / F.nullif(F.count_distinct(c), F.lit(0))


def _spread_of(values: Column, sample: bool) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / n
    squares = F.aggregate(values, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
    return F.when(n > (1 if sample else 0), F.sqrt(squares / (n - (1 if sample else 0)))).otherwise(0.0)


def _name(c: Column) -> str | None:
    """The column name if `c` is a plain column, else None."""
    text = c._jc.toString() if hasattr(c, "_jc") else str(c)
    return text if text and text.replace("_", "").isalnum() and not text[0].isdigit() and text not in ("NULL", "true", "false") else None


def _columns(x: Value) -> list[str]:
    """Names of all columns that make up a bound value."""
    if x.parts is not None:
        p = x.parts
        own = [p.id, p.labels] if isinstance(p, NodeParts) else [p.id, p.type, p.src, p.dst]
        return [n for c in (*own, *(q.col for q in p.props.values())) if (n := _name(c))]
    if isinstance(n := _name(x.col), str):
        return [n]
    raise QueryError("internal: a value without a column")


def _keys(x: Value) -> list[str]:
    """Names of the columns that identify a bound value."""
    if x.parts is not None:
        return [n for c in ([x.parts.id] if isinstance(x.parts, NodeParts) else [x.parts.id, x.parts.type]) if (n := _name(c))]
    return _columns(x)


def _conjuncts(e: s.Expr | None) -> list[s.Expr]:
    if e is None:
        return []
    if isinstance(e, s.Binary) and e.op == "AND":
        return _conjuncts(e.a) + _conjuncts(e.b)
    return [e]
