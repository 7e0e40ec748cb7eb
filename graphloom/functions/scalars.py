"""Scalar functions of the query language; names are case-insensitive.

A leading namespace is not significant: ``x.distance.cosine`` and
``distance.cosine`` name the same function.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import temporal
from graphloom.functions.expressions import INF, NAN, literal, text_of
from graphloom.functions.values import BOOL, FLOAT, INT, NULL, STRING, NodeParts, Value, convert, list_of, map_of, parts_of, struct_of, unify
from graphloom.plans import syntax as s
from graphloom.plans.syntax import QueryError

AGGREGATES = frozenset("count sum avg min max collect stdev stdevp percentiledisc percentilecont".split())
# Fixed value: Unicode white space as a character class.
WHITE = r"[\s\u0085   -     　]"

_TABLE: dict[str, tuple[tuple[int, int], Callable]] = {}


def function(name: str, least: int, most: int | None = None):
    """Register a function with its allowed number of arguments."""

    def add(f: Callable) -> Callable:
        for n in name.split():
            _TABLE[n] = ((least, least if most is None else most), f)
        return f

    return add


def resolve(name: str) -> str:
    low = name.lower()
    if low in _TABLE or low in AGGREGATES:
        return low
    tail = low.partition(".")[2]
    if tail in _TABLE:
        return tail
    raise QueryError(f"unknown function {name}")


def is_aggregate(e: s.Expr) -> bool:
    if not isinstance(e, s.Call) or e.name.lower() not in AGGREGATES:
        return False
    return not (e.name.lower() in ("min", "max") and len(e.args) > 1)


def has_aggregate(e: s.Expr) -> bool:
    return any(is_aggregate(x) for x in s.walk(e))


def call(compiler, e: s.Call) -> Value:
    name = resolve(e.name)
    if name in AGGREGATES and name not in _TABLE:
        raise QueryError(f"the aggregate {e.name} is not allowed here")
    (least, most), f = _TABLE[name]
    if not least <= len(e.args) <= most:
        raise QueryError(f"{e.name} takes {least} to {most} arguments, not {len(e.args)}")
    if getattr(f, "lazy", False):
        return f(compiler, e.args)
    args = [compiler(a) for a in e.args]
    return f(*args)


def lazy(f: Callable) -> Callable:
    f.lazy = True
    return f


def _null(*args: Value) -> bool:
    return any(a.type == NULL for a in args)


def _number(a: Value) -> Column:
    if a.type == NULL:
        return F.lit(None).cast("double")
    if not a.type.numeric:
        raise QueryError(f"a number is needed, not a {a.type}")
    return a.col.cast("double")


def _integer(a: Value) -> Column:
    if a.type not in (INT, NULL):
        raise QueryError(f"an integer is needed, not a {a.type}")
    return a.col.cast("bigint")


# ---- graph ------------------------------------------------------------------


@function("id", 1)
def _id(x):
    return literal(None) if _null(x) else Value(parts_of(x).id, INT)


@function("type", 1)
def _type(r):
    if _null(r):
        return literal(None)
    if r.type.kind != "rel":
        raise QueryError("type() needs a relationship")
    return Value(parts_of(r).type, STRING)


@function("labels", 1)
def _labels(n):
    if _null(n):
        return literal(None)
    if n.type.kind != "node":
        raise QueryError("labels() needs a node")
    p = parts_of(n)
    return Value(F.when(p.id.isNotNull(), p.labels), list_of(STRING))


@function("properties", 1)
def _properties(x):
    if _null(x) or x.type.kind == "map":
        return x
    p = parts_of(x)
    return Value(F.when(p.id.isNotNull(), struct_of(p.props)), map_of({n: q.type for n, q in p.props.items()} or {"_": NULL}))


@function("keys", 1)
def _keys(x):
    if _null(x):
        return Value(F.lit(None).cast("array<string>"), list_of(STRING))
    if x.type.kind == "map":
        return Value(F.when(x.col.isNotNull(), F.array(*[F.lit(n) for n, _ in sorted(x.type.fields) if n != "_"]).cast("array<string>")), list_of(STRING))
    p = parts_of(x)
    names = F.array(*[F.when(q.col.isNotNull(), F.lit(n)) for n, q in sorted(p.props.items())]).cast("array<string>")
    return Value(F.when(p.id.isNotNull(), F.array_compact(names)), list_of(STRING))


def _end(which: str):
    @lazy
    def f(compiler, args):
        r = compiler(args[0])
        if _null(r):
            return literal(None)
        if r.type.kind != "rel":
            raise QueryError("startNode() and endNode() need a relationship")
        p = parts_of(r)
        ends = compiler.params.get("  ends", {}).get(args[0].name) if isinstance(args[0], s.Var) else None
        if ends is None or any(n not in compiler.scope for n in ends):
            return Value(getattr(p, which), INT)  # a relationship on its own knows the ids of its ends only
        left, right = (compiler.scope[n] for n in ends)
        t = unify([left.type, right.type])
        here = getattr(p, which) == parts_of(left).id
        return Value(F.when(here, convert(left, t).col).otherwise(convert(right, t).col), t)

    return f


function("startnode", 1)(_end("src"))
function("endnode", 1)(_end("dst"))


@function("nodes", 1)
def _nodes(p):
    return literal(None) if _null(p) else Value(p.col["nodes"], list_of(INT))


@function("relationships rels", 1)
def _relationships(p):
    return literal(None) if _null(p) else Value(p.col["relationships"], list_of(INT))


@function("length", 1)
def _length(p):
    if _null(p):
        return literal(None)
    if p.type.kind != "path":
        raise QueryError("length() needs a path; use size() for lists and strings")
    return Value(F.when(p.col.isNotNull(), F.size(p.col["relationships"]).cast("bigint")), INT)


@function("size", 1)
def _size(x):
    if _null(x):
        return literal(None)
    if x.type.kind == "list":
        return Value(F.when(x.col.isNotNull(), F.size(x.col).cast("bigint")), INT)
    if x.type == STRING:
        return Value(F.char_length(x.col).cast("bigint"), INT)
    raise QueryError(f"a {x.type} has no size")


@function("coalesce", 1, 99)
def _coalesce(*args):
    t = unify([a.type for a in args])
    return Value(F.coalesce(*[convert(a, t).col for a in args]), t)


@function("exists isnotnull", 1)
def _exists(x):
    if _null(x):
        return literal(False)
    return Value((parts_of(x).id if x.type.kind in ("node", "rel") else x.col).isNotNull(), BOOL)


@function("isnull", 1)
def _isnull(x):
    return Value(~_exists(x).col, BOOL)


@function("timestamp", 0)
@lazy
def _timestamp(compiler, args):
    return literal(int(compiler.clock.timestamp() * 1000))


def _pick(best: Callable):
    def f(*args):
        t = unify([a.type for a in args])
        return Value(best(*[convert(a, t).col for a in args]) if len(args) > 1 else convert(args[0], t).col, t)

    return f


function("min", 2, 99)(_pick(F.least))
function("max", 2, 99)(_pick(F.greatest))


# ---- strings ------------------------------------------------------------------


def _string(f: Callable) -> Callable:
    """For a value that is no string the result is null."""
    return lambda x, *rest: f(x, *rest) if x.type == STRING else Value(F.lit(None).cast("string"), STRING)


@function("substring", 2, 3)
def _substring(x, start, length=None):
    if x.type != STRING:
        return Value(F.lit(None).cast("string"), STRING)
    at = F.greatest(_integer(start), F.lit(0)) + 1
    n = F.greatest(_integer(length), F.lit(0)) if length is not None else F.char_length(x.col)
    return Value(F.substring(x.col, at.cast("int"), n.cast("int")), STRING)


def _side(cut: Callable, name: str):
    def f(x, n):
        if _null(x, n):
            return Value(F.lit(None).cast("string"), STRING)
        count = _integer(n)
        kept = F.when(count < 0, F.raise_error(F.lit(f"{name}() needs a length of at least 0")).cast("string")).otherwise(cut(x.col, count.cast("int")))
        return Value(kept, STRING)

    return f


function("left", 2)(_side(lambda c, n: F.left(c, n), "left"))
function("right", 2)(_side(lambda c, n: F.right(c, n), "right"))
function("trim", 1)(_string(lambda x: Value(F.regexp_replace(x.col, f"^{WHITE}+|{WHITE}+$", ""), STRING)))
function("ltrim", 1)(_string(lambda x: Value(F.regexp_replace(x.col, f"^{WHITE}+", ""), STRING)))
function("rtrim", 1)(_string(lambda x: Value(F.regexp_replace(x.col, f"{WHITE}+$", ""), STRING)))
function("toupper", 1)(_string(lambda x: Value(F.upper(x.col), STRING)))
function("tolower", 1)(_string(lambda x: Value(F.lower(x.col), STRING)))
function("replace", 3)(_string(lambda x, a, b: Value(F.replace(x.col, a.col.cast("string"), b.col.cast("string")), STRING)))


@function("split", 2)
def _split(x, d):
    if x.type != STRING or d.type != STRING:
        return Value(F.lit(None).cast("array<string>"), list_of(STRING))
    if isinstance(d.constant, str) and d.constant:
        return Value(F.split(x.col, re.sub(r"([^\w\s])", r"\\\1", d.constant), -1), list_of(STRING))
    letters = F.filter(F.split(x.col, ""), lambda c: c != "")
    framed = F.concat(F.array(F.lit("")), letters, F.array(F.lit("")))
    parts = F.split(x.col, F.concat(F.lit(r"\Q"), d.col, F.lit(r"\E")), -1)
    return Value(F.when(d.col == "", framed).otherwise(parts), list_of(STRING))


@function("reverse", 1)
def _reverse(x):
    if x.type.kind == "list" or x.type == STRING:
        return Value(F.reverse(x.col), x.type)
    return Value(F.lit(None).cast("string"), STRING)


# ---- lists ----------------------------------------------------------------------


def _of_list(f: Callable):
    def g(x):
        if _null(x) or x.type.kind == "list" and x.type.elem == NULL:
            return literal(None)
        if x.type.kind != "list":
            raise QueryError(f"a list is needed, not a {x.type}")
        return f(x)

    return g


function("head", 1)(_of_list(lambda x: Value(F.try_element_at(x.col, F.lit(1)), x.type.elem)))
function("last", 1)(_of_list(lambda x: Value(F.try_element_at(x.col, F.lit(-1)), x.type.elem)))
function("tail", 1)(_of_list(lambda x: Value(F.slice(x.col, F.lit(2), F.greatest(F.size(x.col) - 1, F.lit(0))), x.type)))


@function("range", 2, 3)
def _range(a, b, step=None):
    if _null(a, b) or step is not None and _null(step):
        return Value(F.lit(None).cast("array<bigint>"), list_of(INT))
    low, high = _integer(a), _integer(b)
    by = _integer(step) if step is not None else F.lit(1).cast("bigint")
    if step is not None and step.constant == 0:
        raise QueryError("the step of range() must not be 0")
    fits = ((by > 0) & (low <= high)) | ((by < 0) & (low >= high))
    full = F.sequence(low, high, by)
    safe = F.when(by == 0, F.raise_error(F.lit("the step of range() must not be 0")).cast("array<bigint>")).when(fits, full)
    return Value(F.when(low.isNotNull() & high.isNotNull(), F.coalesce(safe, F.array().cast("array<bigint>"))), list_of(INT))


# ---- numbers ----------------------------------------------------------------------


@function("abs", 1)
def _abs(x):
    return literal(None) if _null(x) else Value(F.abs(x.col if x.type.numeric else _number(x)), x.type)


def _float(f: Callable) -> Callable:
    return lambda *xs: Value(f(*[_number(x) for x in xs]), FLOAT)


def _log(f: Callable) -> Callable:
    return lambda c: F.when(c == 0, -INF).when(c < 0, NAN).otherwise(f(F.when(c > 0, c).when(F.isnan(c), c)))


function("sqrt", 1)(_float(lambda c: F.sqrt(c)))
function("floor", 1)(_float(lambda c: F.floor(c).cast("double")))
function("ceil ceiling", 1)(_float(lambda c: F.ceil(c).cast("double")))
function("sign", 1)(lambda x: Value(F.signum(_number(x)).cast("bigint"), INT))
function("log", 1)(_float(_log(F.ln)))
function("log10", 1)(_float(_log(F.log10)))
function("exp", 1)(_float(F.exp))
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians"):
    function(_name, 1)(_float(getattr(F, _name)))
function("atan2", 2)(_float(F.atan2))
function("haversin", 1)(_float(lambda c: (1.0 - F.cos(c)) / 2.0))
function("pi", 0)(lambda: literal(math.pi))
function("e", 0)(lambda: literal(math.e))
function("rand", 0)(lambda: Value(F.rand(), FLOAT))


@function("round", 1, 2)
def _round(x, places=None):
    if places is None:
        return Value(F.round(_number(x)), FLOAT)
    if not isinstance(places.constant, int):
        raise QueryError("the precision of round() must be a constant integer")
    return Value(F.round(_number(x), places.constant), FLOAT)


# ---- conversion ---------------------------------------------------------------------


@function("tostring", 1)
def _tostring(x):
    return Value(text_of(x), STRING)


@function("tointeger toint", 1)
def _tointeger(x):
    if _null(x):
        return Value(F.lit(None).cast("bigint"), INT)
    if x.type == BOOL:
        raise QueryError("a boolean is no integer")
    if x.type == STRING:
        bare = F.regexp_replace(x.col, f"^{WHITE}+|{WHITE}+$", "")
        number = bare.try_cast("double")
        return Value(F.coalesce(bare.try_cast("bigint"), F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number.cast("bigint"))), INT)
    if not x.type.numeric:
        return Value(F.lit(None).cast("bigint"), INT)
    return Value(x.col.cast("bigint"), INT)


@function("tofloat", 1)
def _tofloat(x):
    if x.type == STRING:
        return Value(F.regexp_replace(x.col, f"^{WHITE}+|{WHITE}+$", "").try_cast("double"), FLOAT)
    return Value(_number(x), FLOAT) if x.type.numeric else Value(F.lit(None).cast("double"), FLOAT)


@function("toboolean", 1)
def _toboolean(x):
    if x.type == BOOL:
        return x
    if x.type == STRING:
        low = F.lower(F.regexp_replace(x.col, f"^{WHITE}+|{WHITE}+$", ""))
        return Value(F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)), BOOL)
    if x.type == FLOAT:
        raise QueryError("a float is no boolean")
    return Value(F.lit(None).cast("boolean"), BOOL)


# ---- vectors and sets -----------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def _vector(x: Value) -> Column:
    if x.type.kind == "node":
        parts = parts_of(x)
        if not isinstance(parts, NodeParts) or "embedding" not in parts.props:
            raise QueryError("the node has no embedding")
        return parts.props["embedding"].col.cast("array<double>")
    if x.type.kind != "list" or not (x.type.elem.numeric or x.type.elem == NULL):
        raise QueryError(f"a vector is needed, not a {x.type}")
    return x.col.cast("array<double>")


def cosine_distance(a: Column, b: Column, of_zero: Column) -> Column:
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.when(norms > 0, 1.0 - _dot(a, b) / norms).otherwise(of_zero))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": lambda a, b: F.greatest(cosine_distance(a, b, F.lit(1.0)), F.lit(0.0)),
    "l2": squared_distance,
    "dot": lambda a, b: F.when(F.size(a) == F.size(b), 1.0 - _dot(a, b)),
}


@function("vector_dist", 2)
@lazy
def _vector_dist(compiler, args):
    a, b = (compiler(x) for x in args)
    if _null(a, b):
        return Value(F.lit(None).cast("double"), FLOAT)
    return Value(METRICS[compiler.params.get("  metric", "cosine")](_vector(a), _vector(b)), FLOAT)


def _pairwise(f: Callable) -> Callable:
    return lambda a, b: Value(F.lit(None).cast("double") if _null(a, b) else f(a, b), FLOAT)


function("distance.cosine", 2)(_pairwise(lambda a, b: cosine_distance(_vector(a), _vector(b), F.lit(None).cast("double"))))
function("distance.euclidean", 2)(_pairwise(lambda a, b: F.sqrt(squared_distance(_vector(a), _vector(b)))))


def _as_set(x: Value, other: Value) -> Column:
    if x.type.kind != "list":
        raise QueryError("lists are needed")
    # Raw values are compared: 1 and 1.0 differ, so unlike element types share nothing.
    return F.array_distinct(x.col if x.type == other.type else F.transform(x.col, lambda i: F.concat(F.lit(x.type.elem.kind + ":"), i.cast("string"))))


def _jaccard(a: Value, b: Value) -> Column:
    x, y = _as_set(a, b), _as_set(b, a)
    both = F.size(F.array_union(x, y))
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0))


def _overlap(a: Value, b: Value) -> Column:
    x, y = _as_set(a, b), _as_set(b, a)
    least = F.least(F.size(x), F.size(y))
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0))


function("similarity.jaccard", 2)(_pairwise(_jaccard))
function("similarity.overlap", 2)(_pairwise(_overlap))


# ---- temporal ---------------------------------------------------------------------------

for _name, (_least, _most, _f) in temporal.FUNCTIONS.items():
    function(_name, _least, _most)(lazy(_f))
