"""Compile query expressions to Spark columns with the query language's semantics.

Every expression gets a static type, so that three-valued logic, integer
division, NaN comparison and the like are chosen when the plan is built and stay
inside generated code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import values as v
from graphloom.functions.values import BOOL, FLOAT, INT, NULL, STRING, Type, Value, convert, let, list_of, null_of, parts_of, unify
from graphloom.plans import syntax as s
from graphloom.plans.syntax import QueryError

NAN, INF = float("nan"), float("inf")



def literal(x: object) -> Value:
    """A typed column for a Python value."""
    if x is None:
        return Value(F.lit(None).cast("string"), NULL)
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, constant=x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), INT, constant=x)
    if isinstance(x, float):
        return Value(F.lit(x), FLOAT, constant=x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, constant=x)
    if isinstance(x, (list, tuple)):
        return make_list([literal(i) for i in x])
    if isinstance(x, dict):
        return make_map({k: literal(i) for k, i in x.items()})
    if isinstance(x, dt.datetime):
        return Value(F.lit(x.isoformat()).cast("timestamp_ntz"), v.LOCALDATETIME)
    if isinstance(x, dt.date):
        return Value(F.lit(x.isoformat()).cast("date"), v.DATE)
    if hasattr(x, "tolist"):
        return literal(x.tolist())
    raise QueryError(f"a parameter of type {type(x).__name__} is not supported")


def make_list(items: list[Value]) -> Value:
    if not items:
        return Value(F.array().cast("array<string>"), list_of(NULL))
    t = unify([i.type for i in items])
    return Value(F.array(*[convert(i, t).col for i in items]), list_of(t))


def make_map(items: dict[str, Value]) -> Value:
    if not items:
        return Value(F.struct(F.lit(None).cast("string").alias("_")), v.map_of({"_": NULL}))
    return Value(F.struct(*[i.col.alias(k) for k, i in items.items()]), v.map_of({k: i.type for k, i in items.items()}))


# ---- equality and order -------------------------------------------------------


def equals(a: Value, b: Value) -> Column:
    """Three-valued equality: unlike kinds differ, NaN equals nothing, lists compare element by element."""
    if NULL in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if a.type.numeric and b.type.numeric:
        t = unify([a.type, b.type])
        x, y = convert(a, t).col, convert(b, t).col
        if t == FLOAT and a.constant is None and b.constant is None:
            return (x == y) & ~F.isnan(x)
        return x == y  # a constant other than NaN needs no guard
    if a.type.kind != b.type.kind:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if a.type.kind in ("node", "rel"):
        return parts_of(a).id == parts_of(b).id
    if a.type.kind == "list":
        return _list_equals(a, b)
    if a.type.kind == "map":
        x, y = dict(a.type.fields), dict(b.type.fields)
        if set(x) != set(y):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        out = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(True))
        for n in x:
            p, q = Value(a.col[n], x[n]), Value(b.col[n], y[n])
            out = out & F.when(p.col.isNull() & q.col.isNull(), F.lit(True)).when(p.col.isNull() | q.col.isNull(), F.lit(False)).otherwise(equals(p, q))
        return out
    return sort_key(a) == sort_key(b)


def _list_equals(a: Value, b: Value) -> Column:
    if a.type.elem == NULL and b.type.elem == NULL:
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).when(F.size(a.col) == 0, F.lit(True))
    return let(a.col, lambda x: let(b.col, lambda y: _same_lists(Value(x, a.type), Value(y, b.type))))


def _same_lists(a: Value, b: Value) -> Column:
    pairs = F.zip_with(a.col, b.col, lambda x, y: F.coalesce(equals(Value(x, a.type.elem), Value(y, b.type.elem)).cast("int"), F.lit(2)))
    return let(
        pairs,
        lambda flags: F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean"))
        .when(F.size(a.col) != F.size(b.col), F.lit(False))
        .when(F.array_contains(flags, 0), F.lit(False))
        .when(F.array_contains(flags, 2), F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)),
    )


def sort_key(a: Value) -> Column:
    """A column that Spark orders as the query language orders the value."""
    k = a.type.kind
    if k == "datetime":
        return a.col["at"]
    if k == "time":
        return let(a.col, lambda c: c["nanos"] - c["offset"].cast("bigint") * 1_000_000_000)
    if k == "duration":  # an average month and day, as for comparing lengths
        return let(a.col, _seconds)
    if k in ("node", "rel"):
        return parts_of(a).id
    if k == "bool":
        return a.col.cast("int")
    return a.col


def _seconds(c: Column) -> Column:
    return c["months"].cast("double") * 2_629_746.0 + c["days"].cast("double") * 86_400.0 + c["seconds"].cast("double") + c["nanos"] / 1e9


_FLIP = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "=":
        return equals(a, b)
    if op == "<>":
        return ~equals(a, b)
    nothing = F.lit(None).cast("boolean")
    if NULL in (a.type, b.type):
        return nothing
    if a.type.numeric and b.type.numeric:
        t = unify([a.type, b.type])
        x, y = convert(a, t).col, convert(b, t).col
        if t == FLOAT and not (isinstance(a.constant, (int, float)) and isinstance(b.constant, (int, float))):
            # Spark puts NaN above all numbers; here it compares to nothing. A constant side needs no guard.
            out = _FLIP[op](x, y)
            if a.type == FLOAT and a.constant is None:
                out = out & ~F.isnan(x)
            if b.type == FLOAT and b.constant is None:
                out = out & ~F.isnan(y)
            return out
        return _FLIP[op](x, y)
    if a.type.kind != b.type.kind or a.type.kind in ("map", "node", "rel", "path", "duration"):
        return nothing
    if a.type.kind == "list":
        t = unify([a.type, b.type])
        a, b = convert(a, t), convert(b, t)
    return _FLIP[op](sort_key(a), sort_key(b))


def contains(x: Value, items: Value) -> Column:
    """Three-valued x IN items."""
    if items.type == NULL:
        return F.lit(None).cast("boolean")
    if items.type.kind != "list":
        raise QueryError(f"IN needs a list, not a {items.type}")
    if items.type.elem == NULL:
        return F.when(F.size(items.col) == 0, F.lit(False))
    hits = F.transform(items.col, lambda i: F.coalesce(equals(x, Value(i, items.type.elem)).cast("int"), F.lit(2)))
    # The flags are null or empty exactly where the list is.
    return let(
        hits,
        lambda flags: F.when(flags.isNull(), F.lit(None).cast("boolean"))
        .when(F.size(flags) == 0, F.lit(False))
        .when(F.array_contains(flags, 1), F.lit(True))
        .when(F.array_contains(flags, 2), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False)),
    )


# ---- text of values -------------------------------------------------------------


def text_of(a: Value) -> Column:
    """The text a value has in string concatenation and toString."""
    if a.type == FLOAT:
        return let(a.col, lambda c: _float_text(Value(c, FLOAT)))
    if a.type.kind in (*v.TEMPORAL, "duration"):
        from graphloom.functions.temporal import iso_text

        return iso_text(a)
    if a.type.kind in ("int", "bool", "string", "null"):
        return a.col.cast("string")
    raise QueryError(f"a {a.type} has no text form")


def _float_text(a: Value) -> Column:
    plain = F.format_string("%.1f", a.col)
    whole = (a.col == F.floor(a.col)) & (F.abs(a.col) < 1e15)
    return (
        F.when(F.isnan(a.col), F.lit("NaN"))
        .when(F.abs(a.col) == INF, F.when(a.col > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(whole, plain)
        .otherwise(F.regexp_replace(F.lower(a.col.cast("string")), r"\.0e", "e"))
    )


# ---- the compiler ------------------------------------------------------------------


class Compiler:
    """Compiles expressions over a scope of named values."""

    def __init__(self, scope: dict[str, Value], params: dict, clock: dt.datetime, extra: dict[s.Expr, Value] | None = None):
        self.scope = scope
        self.params = params
        self.clock = clock
        self.extra = extra or {}  # expressions that are columns already (aggregates, pattern comprehensions)

    def inner(self, **names: Value) -> Compiler:
        return Compiler(self.scope | names, self.params, self.clock, self.extra)

    def __call__(self, e: s.Expr) -> Value:
        if e in self.extra:
            return self.extra[e]
        return getattr(self, "on_" + type(e).__name__.lower())(e)

    def boolean(self, e: s.Expr) -> Column:
        a = self(e)
        if a.type == NULL:
            return F.lit(None).cast("boolean")
        if a.type != BOOL:
            raise QueryError(f"a boolean is needed, not a {a.type}")
        return a.col

    # leaves

    def on_lit(self, e: s.Lit) -> Value:
        return literal(e.value)

    def on_param(self, e: s.Param) -> Value:
        if e.name not in self.params:
            raise QueryError(f"the parameter ${e.name} is missing")
        return literal(self.params[e.name])

    def on_var(self, e: s.Var) -> Value:
        if e.name not in self.scope:
            raise QueryError(f"the variable {e.name} is not defined")
        return self.scope[e.name]

    def on_listof(self, e: s.ListOf) -> Value:
        return make_list([self(x) for x in e.items])

    def on_mapof(self, e: s.MapOf) -> Value:
        return make_map({k: self(x) for k, x in e.items})

    # access

    def on_prop(self, e: s.Prop) -> Value:
        base = self(e.base)
        return self.member(base, e.name)

    def member(self, base: Value, name: str) -> Value:
        k = base.type.kind
        if k == "null":
            return literal(None)
        if k in ("node", "rel"):
            return parts_of(base).props.get(name) or literal(None)
        if k == "map":
            t = dict(base.type.fields).get(name)
            return Value(base.col[name], t) if t else literal(None)
        if k in (*v.TEMPORAL, "duration"):
            from graphloom.functions.temporal import accessor

            return accessor(base, name)
        raise QueryError(f"a {base.type} has no property {name}")

    def on_index(self, e: s.Index) -> Value:
        base, at = self(e.base), self(e.at)
        if base.type == NULL or at.type == NULL:
            return literal(None)
        if base.type.kind == "list":
            if at.type != INT:
                raise QueryError("a list index must be an integer")
            if base.type.elem == NULL:
                return literal(None)
            place = F.when(at.col >= 0, at.col + 1).otherwise(at.col).cast("int")
            return Value(F.try_element_at(base.col, place), base.type.elem)
        if base.type.kind in ("map", "node", "rel"):
            if isinstance(at.constant, str):
                return self.member(base, at.constant)
            fields = {n: x.type for n, x in parts_of(base).props.items()} if base.type.kind != "map" else dict(base.type.fields)
            same = {n: t for n, t in fields.items() if t == next(iter(fields.values()))}
            if len(same) != len(fields) or at.type != STRING:
                raise QueryError("a dynamic key needs a string and values of one type")
            out = null_of(next(iter(fields.values())))
            for n in fields:
                out = F.when(at.col == n, self.member(base, n).col).otherwise(out)
            return Value(out, next(iter(fields.values())))
        raise QueryError(f"a {base.type} cannot be indexed")

    def on_slice(self, e: s.Slice) -> Value:
        base = self(e.base)
        if base.type == NULL:
            return literal(None)
        if base.type.kind != "list":
            raise QueryError("only lists can be sliced")
        size = F.size(base.col).cast("bigint")

        def bound(x: s.Expr | None, default: Column) -> Column:
            if x is None:
                return default
            b = self(x)
            if b.type not in (INT, NULL):
                raise QueryError("slice bounds must be integers")
            c = b.col.cast("bigint")
            return F.when(c.isNotNull(), F.least(F.greatest(F.when(c < 0, c + size).otherwise(c), F.lit(0)), size))

        low, high = bound(e.low, F.lit(0).cast("bigint")), bound(e.high, size)
        part = F.slice(base.col, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        return Value(F.when(low.isNotNull() & high.isNotNull(), part), base.type)

    # operators

    def on_unary(self, e: s.Unary) -> Value:
        if e.op == "NOT":
            return Value(~self.boolean(e.x), BOOL)
        x = self(e.x)
        if x.type == NULL:
            return x
        if x.type.kind == "duration":
            from graphloom.functions.temporal import scale

            return scale(x, F.lit(-1.0))
        if not x.type.numeric:
            raise QueryError(f"a {x.type} cannot be negated")
        return Value(-x.col, x.type)

    def on_isnull(self, e: s.IsNull) -> Value:
        x = self(e.x)
        c = parts_of(x).id if x.type.kind in ("node", "rel") else x.col
        if x.type == NULL:
            return literal(not e.negated)
        return Value(c.isNotNull() if e.negated else c.isNull(), BOOL)

    def on_haslabels(self, e: s.HasLabels) -> Value:
        x = self(e.x)
        if x.type == NULL:
            return Value(F.lit(None).cast("boolean"), BOOL)
        if x.type.kind == "rel":
            p = parts_of(x)
            return Value(p.type == e.labels[0] if len(e.labels) == 1 else F.lit(False), BOOL)
        if x.type.kind != "node":
            raise QueryError(f"a {x.type} has no labels")
        own = parts_of(x)
        out = F.lit(True)
        for label in e.labels:
            out = out & F.array_contains(own.labels, label)
        return Value(F.when(own.id.isNotNull(), out), BOOL)

    def on_chain(self, e: s.Chain) -> Value:
        terms = [self(e.first), *[self(x) for _, x in e.rest]]
        out = None
        for (op, _), a, b in zip(e.rest, terms, terms[1:]):
            c = compare(op, a, b)
            out = c if out is None else out & c
        return Value(out, BOOL)

    def on_binary(self, e: s.Binary) -> Value:
        if e.op in ("AND", "OR"):
            a, b = self.boolean(e.a), self.boolean(e.b)
            if _risky(e.a) or _risky(e.b):  # the side that decides must keep the other one from raising
                decided = F.lit(e.op == "OR")
                if _risky(e.b):
                    return Value(F.when(a == decided, decided).otherwise(a & b if e.op == "AND" else a | b), BOOL)
                return Value(F.when(b == decided, decided).otherwise(a & b if e.op == "AND" else a | b), BOOL)
            return Value(a & b if e.op == "AND" else a | b, BOOL)
        if e.op == "XOR":
            return Value(self.boolean(e.a) != self.boolean(e.b), BOOL)
        a, b = self(e.a), self(e.b)
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            return Value(compare(e.op, a, b), BOOL)
        if e.op == "IN":
            return Value(contains(a, b), BOOL)
        if e.op in ("STARTS", "ENDS", "CONTAINS", "=~"):
            if a.type != STRING or b.type != STRING:
                return Value(F.lit(None).cast("boolean"), BOOL)
            if e.op == "=~":
                return Value(F.rlike(a.col, F.concat(F.lit(r"\A(?:"), b.col, F.lit(r")\z"))), BOOL)
            return Value({"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[e.op](a.col, b.col), BOOL)
        return arithmetic(e.op, a, b)

    # conditionals and lists

    def on_case(self, e: s.Case) -> Value:
        results = [self(r) for _, r in e.whens] + ([self(e.otherwise)] if e.otherwise is not None else [])
        t = unify([r.type for r in results])
        subject = self(e.subject) if e.subject is not None else None
        out = None
        for (when, _), result in zip(e.whens, results):
            condition = self.boolean(when) if subject is None else equals(subject, self(when))
            out = (F.when if out is None else out.when)(condition, convert(result, t).col)
        if e.otherwise is not None:
            out = out.otherwise(convert(results[-1], t).col)
        return Value(out, t)

    def _each(self, source: Value, var: str, body: Callable[[Compiler], Column]) -> Callable[[Column], Column]:
        return lambda x: body(self.inner(**{var: Value(x, source.type.elem)}))

    def _list(self, e: s.Expr) -> Value:
        source = self(e)
        if source.type == NULL:
            return Value(null_of(list_of(NULL)), list_of(NULL))
        if source.type.kind != "list":
            raise QueryError(f"a list is needed, not a {source.type}")
        return source

    def on_comprehension(self, e: s.Comprehension) -> Value:
        source = self._list(e.source)
        col = source.col
        if e.where is not None:
            col = F.filter(col, self._each(source, e.var, lambda c: c.boolean(e.where)))
        if e.result is None:
            return Value(col, source.type)
        t = self.inner(**{e.var: Value(F.lit(None).cast(v.ddl(source.type.elem)), source.type.elem)})(e.result).type
        return Value(F.transform(col, self._each(source, e.var, lambda c: c(e.result).col)), list_of(t))

    def on_quantifier(self, e: s.Quantifier) -> Value:
        source = self._list(e.source)
        flags = F.transform(source.col, self._each(source, e.var, lambda c: F.coalesce(c.boolean(e.where).cast("int"), F.lit(2))))
        count = lambda k: F.size(F.filter(flags, lambda f: f == k))
        yes, no, unknown = count(1), count(0), count(2)
        none = F.lit(None).cast("boolean")
        out = {
            "all": F.when(no > 0, F.lit(False)).when(unknown > 0, none).otherwise(F.lit(True)),
            "any": F.when(yes > 0, F.lit(True)).when(unknown > 0, none).otherwise(F.lit(False)),
            "none": F.when(yes > 0, F.lit(False)).when(unknown > 0, none).otherwise(F.lit(True)),
            "single": F.when(yes > 1, F.lit(False)).when(unknown > 0, none).otherwise(yes == 1),
        }[e.kind]
        return Value(F.when(source.col.isNotNull(), out), BOOL)

    def on_reduce(self, e: s.Reduce) -> Value:
        source, start = self._list(e.source), self(e.start)
        if source.type.elem == NULL:
            return start
        sample = Value(F.lit(None).cast(v.ddl(source.type.elem)), source.type.elem)
        for _ in range(3):  # the accumulator may widen
            step = self.inner(**{e.acc: Value(null_of(start.type), start.type), e.var: sample})(e.step)
            t = unify([start.type, step.type])
            if t == start.type:
                break
            start = convert(start, t)
        merge = lambda acc, x: convert(
            self.inner(**{e.acc: Value(acc, start.type), e.var: Value(x, source.type.elem)})(e.step), start.type
        ).col
        return Value(F.aggregate(source.col, start.col, merge), start.type)

    def on_patterncomprehension(self, e: s.PatternComprehension) -> Value:
        raise QueryError("a pattern comprehension is not allowed here")

    def on_call(self, e: s.Call) -> Value:
        from graphloom.functions.scalars import call

        return call(self, e)


def _risky(e: s.Expr) -> bool:
    """Whether evaluating the expression may raise an error at run time."""
    for x in s.walk(e):
        if isinstance(x, s.Binary) and x.op in ("+", "-", "*", "/", "%"):
            return True
        if isinstance(x, s.Call) and x.name.lower() in ("range", "left", "right", "abs", "toboolean", "tointeger", "date", "datetime", "duration"):
            return True
    return False


def arithmetic(op: str, a: Value, b: Value) -> Value:
    kinds = (a.type.kind, b.type.kind)
    if op == "+" and "list" in kinds:
        return _append(a, b)
    if any(k in (*v.TEMPORAL, "duration") for k in kinds):
        from graphloom.functions.temporal import combine

        return combine(op, a, b)
    if NULL in (a.type, b.type):
        other = a.type if b.type == NULL else b.type
        return Value(null_of(other), other) if other != NULL else literal(None)
    if op == "+" and "string" in kinds and set(kinds) <= {"string", "int", "float"}:
        return Value(F.concat(text_of(a), text_of(b)), STRING)
    if not (a.type.numeric and b.type.numeric):
        raise QueryError(f"{a.type} {op} {b.type} is not defined")
    if op == "^":
        return Value(F.pow(a.col.cast("double"), b.col.cast("double")), FLOAT)
    t = unify([a.type, b.type])
    x, y = convert(a, t).col, convert(b, t).col
    if t == INT:
        if op == "/":
            return Value(F.call_function("div", x, y), INT)  # truncates, raises on a zero divisor
        return Value({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], INT)
    if op in "/%":
        return Value(let(x, lambda p: let(y, lambda q: _ieee(op, p, q))), FLOAT)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], FLOAT)


def _ieee(op: str, x: Column, y: Column) -> Column:
    """IEEE 754 instead of an error for a zero divisor."""
    sign = F.when(F.lit(1.0) / F.when(y == 0, F.lit(1.0)).otherwise(y) < 0, -1.0).otherwise(1.0)
    negative_zero = F.when((y == 0) & y.cast("string").startswith("-"), -1.0).otherwise(sign)
    whole = F.when(F.isnan(x) | (x == 0) | F.lit(op == "%"), F.lit(NAN)).otherwise(F.signum(x) * negative_zero * F.lit(INF))
    safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
    return F.when(y == 0, whole).otherwise(x / safe if op == "/" else x % safe)


def _append(a: Value, b: Value) -> Value:
    if a.type.kind == b.type.kind == "list":
        t = unify([a.type, b.type])
        return Value(F.concat(convert(a, t).col, convert(b, t).col), t)
    if a.type.kind == "list":
        t = list_of(unify([a.type.elem, b.type]))
        return Value(F.concat(convert(a, t).col, F.array(convert(b, t.elem).col)), t)
    t = list_of(unify([b.type.elem, a.type]))
    return Value(F.concat(F.array(convert(a, t.elem).col), convert(b, t).col), t)
