"""Static types of query values and typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as st

from graphloom.plans.syntax import QueryError


@dataclass(frozen=True)
class Type:
    kind: str
    elem: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()

    def __str__(self) -> str:
        return f"list<{self.elem}>" if self.kind == "list" else self.kind

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


INT, FLOAT, STRING, BOOL, NULL = (Type(k) for k in ("int", "float", "string", "bool", "null"))
DATE, LOCALTIME, TIME, LOCALDATETIME, DATETIME, DURATION = (
    Type(k) for k in ("date", "localtime", "time", "localdatetime", "datetime", "duration")
)
PATH = Type("path")
TEMPORAL = ("date", "localtime", "time", "localdatetime", "datetime")


def list_of(t: Type) -> Type:
    return Type("list", t)


def map_of(fields: dict[str, Type]) -> Type:
    return Type("map", None, tuple(fields.items()))


DURATION_DDL = "struct<months: bigint, days: bigint, seconds: bigint, nanos: int>"
ZONED_DDL = "struct<at: timestamp, zone: string>"
TIME_DDL = "struct<nanos: bigint, offset: int>"
PATH_DDL = "struct<nodes: array<bigint>, relationships: array<bigint>>"


def ddl(t: Type) -> str:
    simple = {
        "int": "bigint",
        "float": "double",
        "string": "string",
        "bool": "boolean",
        "null": "string",
        "date": "date",
        "localtime": "bigint",
        "time": TIME_DDL,
        "localdatetime": "timestamp_ntz",
        "datetime": ZONED_DDL,
        "duration": DURATION_DDL,
        "path": PATH_DDL,
    }
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "list":
        return f"array<{ddl(t.elem)}>"
    inner = ", ".join(f"`{n}`: {ddl(x)}" for n, x in t.fields)
    if t.kind == "map":
        return f"struct<{inner}>"
    if t.kind == "node":
        return f"struct<id: bigint, labels: array<string>, properties: struct<{inner}>>"
    if t.kind == "rel":
        return f"struct<id: bigint, type: string, src: bigint, dst: bigint, properties: struct<{inner}>>"
    raise QueryError(f"no storage for {t}")


def of_spark(dt: st.DataType) -> Type:
    """The query type of a column of Spark type `dt`."""
    if isinstance(dt, (st.ByteType, st.ShortType, st.IntegerType, st.LongType)):
        return INT
    if isinstance(dt, (st.FloatType, st.DoubleType, st.DecimalType)):
        return FLOAT
    if isinstance(dt, st.BooleanType):
        return BOOL
    if isinstance(dt, st.DateType):
        return DATE
    if isinstance(dt, (st.TimestampNTZType, st.TimestampType)):
        return LOCALDATETIME
    if isinstance(dt, st.ArrayType):
        return list_of(of_spark(dt.elementType))
    if isinstance(dt, st.StructType):
        return map_of({f.name: of_spark(f.dataType) for f in dt.fields})
    if isinstance(dt, st.NullType):
        return NULL
    return STRING


def stored(c: Column, dt: st.DataType) -> Column:
    """`c` in the representation its query type has."""
    t = of_spark(dt)
    if t.kind in ("int", "float", "list") or isinstance(dt, st.TimestampType):
        return c.cast(ddl(t))
    return c


def let(c: Column, body) -> Column:
    """`body(c)` with `c` evaluated once: expressions that use an operand often would otherwise grow exponentially when nested."""
    text = c._jc.toString() if hasattr(c, "_jc") else ""
    if text and len(text) <= 60 and "(" not in text:  # a column, a variable or a short literal
        return body(c)
    return F.element_at(F.transform(F.array(c), lambda x: body(x)), 1)


@dataclass
class Value:
    """A typed column; `parts` holds the flattened form of a bound node or relationship."""

    col: Column
    type: Type
    parts: Any = None
    constant: Any = field(default=None, compare=False)


@dataclass
class NodeParts:
    id: Column
    labels: Column
    props: dict[str, Value]


@dataclass
class RelParts:
    id: Column
    type: Column
    src: Column
    dst: Column
    props: dict[str, Value]


def null_of(t: Type) -> Column:
    return F.lit(None).cast(ddl(t))


def struct_of(props: dict[str, Value]) -> Column:
    return F.struct(*[v.col.alias(n) for n, v in props.items()]) if props else F.struct(F.lit(None).cast("string").alias("_"))


def node_value(parts: NodeParts) -> Value:
    fields = {n: v.type for n, v in parts.props.items()} or {"_": NULL}
    whole = F.when(parts.id.isNotNull(), F.struct(parts.id.alias("id"), parts.labels.alias("labels"), struct_of(parts.props).alias("properties")))
    return Value(whole, Type("node", None, tuple(fields.items())), parts)


def rel_value(parts: RelParts) -> Value:
    fields = {n: v.type for n, v in parts.props.items()} or {"_": NULL}
    whole = F.when(
        parts.id.isNotNull(),
        F.struct(
            parts.id.alias("id"),
            parts.type.alias("type"),
            parts.src.alias("src"),
            parts.dst.alias("dst"),
            struct_of(parts.props).alias("properties"),
        ),
    )
    return Value(whole, Type("rel", None, tuple(fields.items())), parts)


def parts_of(v: Value) -> NodeParts | RelParts:
    """Flattened form of a node or relationship, also of one held in a struct column."""
    if v.parts is not None:
        return v.parts
    inner = v.col["properties"]
    props = {n: Value(inner[n], t) for n, t in v.type.fields if n != "_"}
    if v.type.kind == "node":
        return NodeParts(v.col["id"], v.col["labels"], props)
    return RelParts(v.col["id"], v.col["type"], v.col["src"], v.col["dst"], props)


def unify(types: list[Type]) -> Type:
    """The common type of several values; nulls fit everywhere and int widens to float."""
    real = [t for t in types if t != NULL]
    if not real:
        return NULL
    first = real[0]
    for t in real[1:]:
        if t == first:
            continue
        if t.numeric and first.numeric:
            first = FLOAT
        elif t.kind == first.kind == "list":
            first = list_of(unify([first.elem, t.elem]))
        elif t.kind == first.kind and t.kind in ("map", "node", "rel"):
            merged = dict(first.fields)
            for n, x in t.fields:
                merged[n] = unify([merged[n], x]) if n in merged else x
            first = Type(t.kind, None, tuple(merged.items()))
        else:
            raise QueryError(f"values of the types {first} and {t} cannot share one column")
    return first


def convert(v: Value, t: Type) -> Value:
    """`v` as a value of the wider type `t`."""
    if v.type == t:
        return v
    if v.type == NULL:
        return Value(null_of(t), t)
    if t == FLOAT and v.type == INT:
        return Value(v.col.cast("double"), FLOAT)
    if t.kind == v.type.kind == "list":
        if v.type.elem == NULL:
            return Value(F.transform(v.col, lambda _: null_of(t.elem)).cast(ddl(t)), t)
        return Value(F.transform(v.col, lambda x: convert(Value(x, v.type.elem), t.elem).col), t)
    if t.kind == v.type.kind == "map":
        own = dict(v.type.fields)
        cols = [(convert(Value(v.col[n], own[n]), x).col if n in own else null_of(x)).alias(n) for n, x in t.fields]
        return Value(F.when(v.col.isNotNull(), F.struct(*cols)), t)
    if t.kind == v.type.kind and t.kind in ("node", "rel"):
        p = parts_of(v)
        props = {n: convert(p.props[n], x) if n in p.props else Value(null_of(x), x) for n, x in t.fields if n != "_" or len(t.fields) == 1}
        props.pop("_", None)
        if t.kind == "node":
            return node_value(NodeParts(p.id, p.labels, props))
        return rel_value(RelParts(p.id, p.type, p.src, p.dst, props))
    raise QueryError(f"{v.type} is not a {t}")
