"""Temporal values: constructors, accessors, truncation, arithmetic and text.

Representation: a date is a Spark DATE, a local date-time a TIMESTAMP_NTZ, a
date-time a timestamp with its zone, a local time the nanoseconds since
midnight, a time these with an offset in seconds, and a duration four numbers
(months, days, seconds, nanos) that never carry into each other. Seconds are
kept to the microsecond, Spark's precision, except in local times, times and
durations, which keep nanoseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import values as v
from graphloom.functions.values import INT, NULL, STRING, Value, let
from graphloom.plans import syntax as s
from graphloom.plans.syntax import QueryError

DAY = 86_400_000_000_000
SECOND = 1_000_000_000
# Nanoseconds of the units of a time.
UNITS = {"hour": 3_600 * SECOND, "minute": 60 * SECOND, "second": SECOND, "millisecond": 1_000_000, "microsecond": 1_000, "nanosecond": 1}
MONTH_SECONDS = 2_629_746


def _lit(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _fields(x: Value) -> dict[str, Value]:
    return {n.lower(): Value(x.col[n], t) for n, t in x.type.fields}


def _int(fields: dict[str, Value], name: str, default: Column | int) -> Column:
    if name.lower() in fields:
        return fields[name.lower()].col.cast("bigint")
    return default if isinstance(default, Column) else _lit(default)


# ---- pieces of a moment ------------------------------------------------------


def wall(x: Value) -> Column:
    """The local date and time of a value as TIMESTAMP_NTZ (for a date: midnight)."""
    if x.type == v.DATE:
        return x.col.cast("timestamp_ntz")
    if x.type == v.LOCALDATETIME:
        return x.col
    if x.type == v.DATETIME:
        return let(x.col, lambda c: F.from_utc_timestamp(c["at"], c["zone"]).cast("timestamp_ntz"))
    raise QueryError(f"a {x.type} has no date")


def nanos_of_day(x: Value) -> Column:
    if x.type == v.LOCALTIME:
        return x.col
    if x.type == v.TIME:
        return x.col["nanos"]
    return let(wall(x), _nanos_of_wall)


def _nanos_of_wall(w: Column) -> Column:
    return (F.hour(w).cast("bigint") * 3600 + F.minute(w) * 60) * SECOND + (F.extract(F.lit("SECOND"), w) * 1_000_000).cast("bigint") * 1_000


def offset_seconds(x: Value) -> Column:
    if x.type == v.TIME:
        return x.col["offset"]
    if x.type == v.DATETIME:
        return let(x.col, lambda c: (_micros(wall(Value(c, v.DATETIME))) - F.unix_micros(c["at"])).cast("bigint") / 1_000_000)
    raise QueryError(f"a {x.type} has no offset")


def _micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time."""
    return F.unix_micros(F.to_utc_timestamp(ntz.cast("string").cast("timestamp"), "UTC"))


def _from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _at_zone(ntz: Column, zone: Column) -> Column:
    return let(zone, lambda z: F.struct(F.to_utc_timestamp(ntz.cast("timestamp"), z).alias("at"), z.alias("zone")))


def _text2(c: Column, width: int = 2) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _fraction(nanos: Column) -> Column:
    """``.5`` for 500000000, empty for 0."""
    digits = F.regexp_replace(_text2(nanos, 9), "0+$", "")
    return F.when(nanos == 0, F.lit("")).otherwise(F.concat(F.lit("."), digits))


def _time_text(nanos: Column) -> Column:
    return let(nanos, _clock_text)


def _clock_text(nanos: Column) -> Column:
    at = lambda unit, size: F.call_function("div", nanos, _lit(unit)) % size
    seconds = at(SECOND, 60)
    rest = nanos % SECOND
    head = F.concat(_text2(at(3_600 * SECOND, 24)), F.lit(":"), _text2(at(60 * SECOND, 60)))
    return F.when((seconds == 0) & (rest == 0), head).otherwise(F.concat(head, F.lit(":"), _text2(seconds), _fraction(rest)))


def _offset_text(seconds: Column) -> Column:
    return let(seconds, _shift_text)


def _shift_text(seconds: Column) -> Column:
    size = F.abs(seconds).cast("bigint")
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+"))
    text = F.concat(sign, _text2(F.call_function("div", size, _lit(3600))), F.lit(":"), _text2(F.call_function("div", size, _lit(60)) % 60))
    return F.when(seconds == 0, F.lit("Z")).otherwise(text)


def iso_text(x: Value) -> Column:
    return let(x.col, lambda c: _text(Value(c, x.type)))


def _text(x: Value) -> Column:
    if x.type == v.DATE:
        return F.date_format(x.col, "yyyy-MM-dd")
    if x.type == v.LOCALTIME:
        return _time_text(x.col)
    if x.type == v.TIME:
        return F.concat(_time_text(x.col["nanos"]), _offset_text(x.col["offset"]))
    if x.type == v.DURATION:
        return _duration_text(x.col)
    text = let(wall(x), lambda w: F.concat(F.date_format(w, "yyyy-MM-dd"), F.lit("T"), _time_text(_nanos_of_wall(w))))
    if x.type == v.DATETIME:
        zone = x.col["zone"]
        named = F.when(zone.rlike("^[A-Za-z]+/"), F.concat(F.lit("["), zone, F.lit("]"))).otherwise(F.lit(""))
        text = F.concat(text, _offset_text(offset_seconds(x)), named)
    return text


def _duration_text(d: Column) -> Column:
    years, months = F.call_function("div", d["months"], _lit(12)), d["months"] % 12
    return let(
        F.concat(_amount(years, "Y"), _amount(months, "M"), _amount(d["days"], "D")),
        lambda date: let(_clock_part(d), lambda time: _joined(d, date, time)),
    )


def _amount(n: Column, unit: str) -> Column:
    return F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))


def _joined(d: Column, date: Column, time: Column) -> Column:
    full = F.concat(F.lit("P"), date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(d.isNull(), F.lit(None).cast("string")).when((date == "") & (time == ""), F.lit("PT0S")).otherwise(full)


def _clock_part(d: Column) -> Column:
    total = d["seconds"]
    hours, minutes = F.call_function("div", total, _lit(3600)), F.call_function("div", total, _lit(60)) % 60
    # Seconds with a fraction are written as one signed decimal.
    nanos = let(total % 60 * SECOND + d["nanos"], _signed_seconds)
    return F.concat(_amount(hours, "H"), _amount(minutes, "M"), nanos)


def _signed_seconds(nanos: Column) -> Column:
    sign, size = F.when(nanos < 0, F.lit("-")).otherwise(F.lit("")), F.abs(nanos)
    text = F.concat(sign, F.call_function("div", size, _lit(SECOND)).cast("string"), _fraction(size % SECOND), F.lit("S"))
    return F.when(nanos != 0, text).otherwise(F.lit(""))


# ---- construction ---------------------------------------------------------------


def _date_from(fields: dict[str, Value], base: Column | None = None) -> Column:
    """A DATE from year/month/day, ISO week, quarter or ordinal fields; `base` fills the rest."""
    default = lambda f, least: f(base).cast("bigint") if base is not None else _lit(least)
    if "week" in fields:
        iso_year = F.extract(F.lit("YEAROFWEEK"), base).cast("bigint") if base is not None else _lit(1)
        year = _int(fields, "year", iso_year)
        january = F.make_date(year.cast("int"), F.lit(1), F.lit(4))
        monday = F.date_sub(january, F.weekday(january))
        day = _int(fields, "dayofweek", (F.weekday(base) + 1).cast("bigint") if base is not None else 1)
        return F.date_add(monday, ((_int(fields, "week", 1) - 1) * 7 + day - 1).cast("int"))
    year = _int(fields, "year", default(F.year, 1))
    if "ordinalday" in fields:
        return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (_int(fields, "ordinalday", 1) - 1).cast("int"))
    if "quarter" in fields:
        first = F.make_date(year.cast("int"), ((_int(fields, "quarter", 1) - 1) * 3 + 1).cast("int"), F.lit(1))
        if base is not None:
            start = F.trunc(base, "quarter")
            kept = F.datediff(base, start) + 1
        else:
            kept = F.lit(1)
        return F.date_add(first, (_int(fields, "dayofquarter", kept.cast("bigint")) - 1).cast("int"))
    month = _int(fields, "month", default(F.month, 1))
    day = _int(fields, "day", default(F.dayofmonth, 1))
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def _time_from(fields: dict[str, Value], base: Column | None = None) -> Column:
    """Nanoseconds of the day; given sub-second fields add up."""
    total = _lit(0)
    rest = base
    for unit in ("hour", "minute", "second"):
        size = UNITS[unit]
        if unit in fields:
            total = total + _int(fields, unit, 0) * size
        elif rest is not None:
            total = total + F.call_function("div", base % (DAY if unit == "hour" else UNITS["hour"] if unit == "minute" else UNITS["minute"]), _lit(size)) * size
    sub = [u for u in ("millisecond", "microsecond", "nanosecond") if u in fields]
    for unit in sub:
        total = total + _int(fields, unit, 0) * UNITS[unit]
    if not sub and base is not None:
        total = total + base % SECOND
    return total


def _zone(fields: dict[str, Value], default: Column | None = None) -> Column:
    if "timezone" in fields:
        return fields["timezone"].col
    return default if default is not None else F.lit("Z")


_ZONE_SPLIT = r"^(.*?)(Z|[+-]\d{2}(?::?\d{2})?)?(?:\[([^\]]+)\])?$"


def _zone_of_text(c: Column) -> Column:
    named, offset = F.regexp_extract(c, _ZONE_SPLIT, 3), F.regexp_extract(c, _ZONE_SPLIT, 2)
    return F.when(named != "", named).when(offset.isin("", "Z"), F.lit("Z")).otherwise(_colon(offset))


def _colon(offset: Column) -> Column:
    digits = F.rpad(F.regexp_replace(F.substring(offset, 2, 9), ":", ""), 4, "0")
    return F.concat(F.substring(offset, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))


def _offset_of_text(offset: Column) -> Column:
    full = _colon(offset)
    sign = F.when(F.substring(full, 1, 1) == "-", -1).otherwise(1)
    return F.when(offset.isin("", "Z"), F.lit(0)).otherwise(sign * (F.substring(full, 2, 2).cast("int") * 3600 + F.substring(full, 5, 2).cast("int") * 60))


def _date_of_text(c: Column) -> Column:
    """ISO dates: extended or basic, week (2015-W30-2), ordinal (2015-202), month and year only."""
    return let(F.regexp_replace(c, "-", ""), lambda digits: _date_of_digits(c, digits))


def _date_of_digits(c: Column, digits: Column) -> Column:
    year = F.substring(digits, 1, 4).cast("int")
    january = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(january, F.weekday(january))
    week = F.substring(digits, 6, 2).cast("int")
    weekday = F.when(F.length(digits) > 7, F.substring(digits, 8, 1)).otherwise(F.lit("1")).cast("int")
    return (
        F.when(c.contains("W"), F.date_add(monday, (week - 1) * 7 + weekday - 1))
        .when(F.length(digits) == 7, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.substring(digits, 5, 3).cast("int") - 1))
        .when(F.length(digits) == 8, F.make_date(year, F.substring(digits, 5, 2).cast("int"), F.substring(digits, 7, 2).cast("int")))
        .when(F.length(digits) == 6, F.make_date(year, F.substring(digits, 5, 2).cast("int"), F.lit(1)))
        .when(F.length(digits) == 4, F.make_date(year, F.lit(1), F.lit(1)))
        .otherwise(F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no date: "), c)).cast("date")))
    )


def _time_of_text(c: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(c, r"^([0-9:]*)", 1), ":", "")
    piece = lambda at: F.coalesce(F.substring(digits, at, 2).try_cast("bigint"), _lit(0))
    fraction = F.rpad(F.regexp_extract(c, r"[.,](\d+)", 1), 9, "0").cast("bigint")
    return (piece(1) * 3600 + piece(3) * 60 + piece(5)) * SECOND + F.coalesce(fraction, _lit(0))


def _join(date: Column, nanos: Column) -> Column:
    return _from_micros(_micros(date.cast("timestamp_ntz")) + F.call_function("div", nanos, _lit(1000)))


def _base_date(fields: dict[str, Value]) -> Column | None:
    for name in ("date", "datetime", "localdatetime"):
        if name in fields and fields[name].type.kind in ("date", "datetime", "localdatetime"):
            return wall(fields[name]).cast("date")
    return None


def _base_time(fields: dict[str, Value]) -> Column | None:
    for name in ("time", "localtime", "datetime", "localdatetime"):
        if name in fields and fields[name].type.kind in v.TEMPORAL and fields[name].type != v.DATE:
            return nanos_of_day(fields[name])
    return None


def build(kind: str, x: Value) -> Value:
    """A temporal value of `kind` from a map, a string or another temporal value."""
    t = v.Type(kind)
    if x.type == NULL:
        return Value(v.null_of(t), t)
    return Value(let(x.col, lambda c: _built(kind, t, Value(c, x.type))), t)


def _built(kind: str, t: v.Type, x: Value) -> Column:
    if x.type.kind == "map":
        fields = _fields(x)
        zone_from = next((q.col["zone"] for q in fields.values() if q.type == v.DATETIME), None)
        date = lambda: _date_from(fields, _base_date(fields))
        nanos = lambda: _time_from(fields, _base_time(fields))
        if kind == "date":
            out = date()
        elif kind == "localtime":
            out = nanos()
        elif kind == "time":
            out = F.struct(nanos().alias("nanos"), _offset_of_text(_zone(fields)).cast("int").alias("offset"))
        elif kind == "localdatetime":
            out = _join(date(), nanos())
        elif "epochseconds" in fields or "epochmillis" in fields:
            ms = _int(fields, "epochMillis", 0) + _int(fields, "epochSeconds", 0) * 1000
            out = F.struct(F.timestamp_millis(ms).alias("at"), _zone(fields).alias("zone"))
        else:
            out = _at_zone(_join(date(), nanos()), _zone(fields, zone_from))
        return F.when(x.col.isNotNull(), out)
    if x.type == STRING:
        c = x.col
        stem = F.regexp_extract(c, _ZONE_SPLIT, 1)
        day, clock = F.regexp_extract(c, r"^([^T]*)", 1), F.regexp_extract(c, r"T(.*)$", 1)
        if kind == "date":
            out = _date_of_text(c)
        elif kind == "localtime":
            out = _time_of_text(c)
        elif kind == "time":
            out = F.struct(_time_of_text(stem).alias("nanos"), _offset_of_text(F.regexp_extract(c, _ZONE_SPLIT, 2)).cast("int").alias("offset"))
        elif kind == "localdatetime":
            out = _join(_date_of_text(day), _time_of_text(clock))
        else:
            clock_stem = F.regexp_extract(clock, _ZONE_SPLIT, 1)
            out = _at_zone(_join(_date_of_text(day), _time_of_text(clock_stem)), F.when(clock == "", F.lit("Z")).otherwise(_zone_of_text(clock)))
        return F.when(c.isNotNull(), out)
    if x.type.kind in v.TEMPORAL:
        if kind == "date":
            out = wall(x).cast("date")
        elif kind == "localtime":
            out = nanos_of_day(x)
        elif kind == "time":
            offset = offset_seconds(x) if x.type in (v.TIME, v.DATETIME) else F.lit(0)
            out = F.struct(nanos_of_day(x).alias("nanos"), offset.cast("int").alias("offset"))
        elif kind == "localdatetime":
            out = wall(x)
        else:
            out = x.col if x.type == v.DATETIME else _at_zone(wall(x), F.lit("Z"))
        return F.when(x.col.isNotNull(), out)
    raise QueryError(f"{kind}() cannot take a {x.type}")


def _now(kind: str, compiler) -> Value:
    clock = compiler.clock
    if clock.tzinfo is not None:
        import datetime as dt

        clock = clock.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return build(kind, Value(F.lit(clock.isoformat()).cast("timestamp_ntz"), v.LOCALDATETIME))


def _constructor(kind: str) -> Callable:
    def f(compiler, args):
        return build(kind, compiler(args[0])) if args else _now(kind, compiler)

    return f


def _clock(kind: str) -> Callable:
    return lambda compiler, args: _now(kind, compiler)


# ---- durations ---------------------------------------------------------------------


def make_duration(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    """Normalised so that 0 <= nanos < 1e9 with the sign in the seconds."""
    return let(
        seconds.cast("bigint") * SECOND + nanos.cast("bigint"),
        lambda total: F.struct(
            months.cast("bigint").alias("months"),
            days.cast("bigint").alias("days"),
            F.call_function("div", total, _lit(SECOND)).alias("seconds"),
            (total % SECOND).cast("int").alias("nanos"),
        ),
    )


def _from_amounts(years, months, weeks, days, hours, minutes, seconds, nanos) -> Column:
    """A duration from possibly fractional amounts; fractions carry downwards only."""
    whole = lambda c: F.floor(F.abs(c)) * F.signum(c)
    # Below a day everything is counted in nanoseconds.
    clock = (hours * 3600 + minutes * 60) * 1e9 + F.round(seconds * 1e9) + nanos

    def split(all_months: Column) -> Column:
        all_days = weeks * 7 + days + (all_months - whole(all_months)) * (MONTH_SECONDS / 86_400.0)
        return let(all_days, lambda d: make_duration(whole(all_months), whole(d), F.lit(0), F.round(clock + F.round((d - whole(d)) * 86_400.0 * 1e9))))

    return let(years * 12 + months, split)


def _duration(compiler, args) -> Value:
    x = compiler(args[0])
    if x.type == NULL:
        return Value(v.null_of(v.DURATION), v.DURATION)
    if x.type.kind == "map":
        fields = _fields(x)
        get = lambda n: fields[n].col.cast("double") if n in fields else F.lit(0.0)
        sub = get("milliseconds") * 1e6 + get("microseconds") * 1e3 + get("nanoseconds")
        months = get("months") + get("quarters") * 3
        out = _from_amounts(get("years"), months, get("weeks"), get("days"), get("hours"), get("minutes"), get("seconds"), sub)
        return Value(F.when(x.col.isNotNull(), out), v.DURATION)
    if x.type != STRING:
        raise QueryError(f"duration() cannot take a {x.type}")
    day, clock = F.regexp_extract(x.col, r"^(-?P[^T]*)", 1), F.regexp_extract(x.col, r"T(.*)$", 1)
    amount = lambda c, unit: F.coalesce(F.regexp_extract(c, rf"(-?\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    out = _from_amounts(
        amount(day, "Y"), amount(day, "M"), amount(day, "W"), amount(day, "D"), amount(clock, "H"), amount(clock, "M"), amount(clock, "S"), F.lit(0.0)
    )
    return Value(F.when(x.col.isNotNull(), out), v.DURATION)


def scale(x: Value, by: Column) -> Value:
    zero = F.lit(0.0)

    def scaled(d: Column, k: Column) -> Column:
        return F.when(d.isNotNull(), _from_amounts(zero, d["months"] * k, zero, d["days"] * k, zero, zero, d["seconds"] * k, d["nanos"] * k))

    return Value(let(x.col, lambda d: let(by, lambda k: scaled(d, k))), v.DURATION)


def _shift(x: Value, d: Column, sign: int) -> Value:
    """A temporal value moved by a duration; month ends are clamped."""
    months, days, seconds, nanos = (d[n] * sign for n in ("months", "days", "seconds", "nanos"))
    if x.type == v.TIME:
        moved = F.pmod(nanos_of_day(x) + seconds * SECOND + nanos, _lit(DAY))
        return Value(F.struct(moved.alias("nanos"), x.col["offset"].alias("offset")), v.TIME)
    if x.type == v.LOCALTIME:
        moved = F.pmod(nanos_of_day(x) + seconds * SECOND + nanos, _lit(DAY))
        return Value(moved, v.LOCALTIME)
    date = F.date_add(F.add_months(wall(x).cast("date"), months.cast("int")), days.cast("int"))
    if x.type == v.DATE:
        return Value(F.date_add(date, F.call_function("div", seconds, _lit(86_400)).cast("int")), v.DATE)
    moved = _from_micros(_micros(_join(date, nanos_of_day(x))) + seconds * 1_000_000 + F.call_function("div", nanos, _lit(1000)))
    if x.type == v.LOCALDATETIME:
        return Value(moved, v.LOCALDATETIME)
    return Value(_at_zone(moved, x.col["zone"]), v.DATETIME)


def combine(op: str, a: Value, b: Value) -> Value:
    if NULL in (a.type, b.type):
        t = a.type if b.type == NULL else b.type
        return Value(v.null_of(t), t)
    if a.type == b.type == v.DURATION and op in "+-":
        sign = 1 if op == "+" else -1

        def total(x: Column, y: Column) -> Column:
            return F.when(x.isNotNull() & y.isNotNull(), make_duration(*[x[n] + y[n] * sign for n in ("months", "days", "seconds", "nanos")]))

        return Value(let(a.col, lambda x: let(b.col, lambda y: total(x, y))), v.DURATION)
    if a.type.kind in v.TEMPORAL and b.type == v.DURATION and op in "+-":
        sign = 1 if op == "+" else -1

        def moved(x: Column, d: Column) -> Column:
            return F.when(x.isNotNull() & d.isNotNull(), _shift(Value(x, a.type), d, sign).col)

        return Value(let(a.col, lambda x: let(b.col, lambda d: moved(x, d))), a.type)
    if a.type == v.DURATION and b.type.kind in v.TEMPORAL and op == "+":
        return combine(op, b, a)
    if a.type == v.DURATION and b.type.numeric and op in "*/":
        return scale(a, b.col.cast("double") if op == "*" else F.lit(1.0) / b.col)
    if a.type.numeric and b.type == v.DURATION and op == "*":
        return scale(b, a.col.cast("double"))
    if a.type == b.type == v.DATE and op == "-":
        days = F.datediff(a.col, b.col).cast("bigint")
        return Value(F.when(days.isNotNull(), make_duration(_lit(0), days, _lit(0), _lit(0))), v.DURATION)
    raise QueryError(f"{a.type} {op} {b.type} is not defined")


def _total_nanos(a: Value, b: Value) -> Column:
    """Nanoseconds from a to b; a missing date on either side is ignored on both."""
    timed = {"localtime", "time"}
    if a.type.kind in timed or b.type.kind in timed:
        return nanos_of_day(b) - nanos_of_day(a)
    if a.type == b.type == v.DATETIME:
        return (F.unix_micros(b.col["at"]) - F.unix_micros(a.col["at"])) * 1000
    return (_micros(wall(b)) - _micros(wall(a))) * 1000


def _since(x: Column, y: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body(months, nanoseconds)`: the full months from x to y, and what remains after them."""
    step = lambda n: _join(F.add_months(x.cast("date"), n.cast("int")), _nanos_of_wall(x))
    rough = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    over = lambda n: n + F.when((n > 0) & (step(n) > y), -1).when((n < 0) & (step(n) < y), 1).otherwise(0)
    rest = lambda m: (_micros(y) - _micros(step(m))) * 1000
    return let(let(rough, over).cast("bigint"), lambda m: let(rest(m), lambda r: body(m, r)))


def _gap(kind: str, a: Value, b: Value) -> Column:
    timed = a.type.kind in ("localtime", "time") or b.type.kind in ("localtime", "time")
    zero = _lit(0)
    if kind == "seconds" or timed and kind == "between":
        return make_duration(zero, zero, zero, _total_nanos(a, b))
    if timed:
        return make_duration(zero, zero, zero, zero)
    if kind == "days":
        return make_duration(zero, F.call_function("div", _total_nanos(a, b), _lit(DAY)), zero, zero)

    def parts(months: Column, rest: Column) -> Column:
        if kind == "months":
            return make_duration(months, zero, zero, zero)
        return make_duration(months, F.call_function("div", rest, _lit(DAY)), zero, rest % DAY)

    return let(wall(a), lambda x: let(wall(b), lambda y: _since(x, y, parts)))


def _between(kind: str) -> Callable:
    def f(compiler, args):
        a, b = (compiler(x) for x in args)
        if NULL in (a.type, b.type):
            return Value(v.null_of(v.DURATION), v.DURATION)
        both = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), _gap(kind, Value(x, a.type), Value(y, b.type)))
        return Value(let(a.col, lambda x: let(b.col, lambda y: both(x, y))), v.DURATION)

    return f


# ---- truncation -----------------------------------------------------------------------

# Years of the long units.
LONG_UNITS = {"millennium": 1000, "century": 100, "decade": 10}


def _truncated_date(unit: str, date: Column) -> Column:
    if unit in LONG_UNITS:
        span = LONG_UNITS[unit]
        return F.make_date((F.year(date) - F.year(date) % span).cast("int"), F.lit(1), F.lit(1))
    if unit == "weekyear":
        year = F.extract(F.lit("YEAROFWEEK"), date).cast("int")
        january = F.make_date(year, F.lit(1), F.lit(4))
        return F.date_sub(january, F.weekday(january))
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(date, unit)
    return date


def _cut(kind: str, unit: str, x: Value, fields: dict[str, Value]) -> Column:
    has_date = x.type.kind in ("date", "localdatetime", "datetime")
    date = _truncated_date(unit, wall(x).cast("date")) if has_date else None
    nanos = _lit(0)
    if unit in UNITS and x.type != v.DATE:
        clock = nanos_of_day(x)
        nanos = clock - clock % UNITS[unit]
    if date is not None and any(n in fields for n in ("year", "month", "day", "week", "dayofweek", "ordinalday", "quarter", "dayofquarter")):
        if "dayofweek" in fields and "week" not in fields:
            date = F.date_add(F.trunc(date, "week"), (_int(fields, "dayofweek", 1) - 1).cast("int"))
        else:
            date = _date_from(fields, date)
    if any(n in fields for n in UNITS):
        kept = nanos
        nanos = _time_from(fields, kept)
        sub = [n for n in ("millisecond", "microsecond", "nanosecond") if n in fields]
        if sub and unit in ("millisecond", "microsecond"):
            nanos = nanos + kept % SECOND
    if kind == "date":
        out = date
    elif kind == "localtime":
        out = nanos
    elif kind == "time":
        offset = offset_seconds(x) if x.type in (v.TIME, v.DATETIME) else F.lit(0)
        if "timezone" in fields:
            offset = _offset_of_text(fields["timezone"].col)
        out = F.struct(nanos.alias("nanos"), offset.cast("int").alias("offset"))
    elif kind == "localdatetime":
        out = _join(date, nanos)
    else:
        out = _at_zone(_join(date, nanos), _zone(fields, x.col["zone"] if x.type == v.DATETIME else None))
    return F.when(x.col.isNotNull(), out)


def _truncate(kind: str) -> Callable:
    def f(compiler, args):
        unit_value, x = compiler(args[0]), compiler(args[1]) if len(args) > 1 else _now(kind, compiler)
        if not isinstance(unit_value.constant, str):
            raise QueryError("the unit of truncate() must be a constant string")
        unit = unit_value.constant.lower()
        fields = _fields(compiler(args[2])) if len(args) > 2 else {}
        if x.type == NULL:
            return Value(v.null_of(v.Type(kind)), v.Type(kind))
        if unit not in UNITS and unit not in ("day", "week", "month", "quarter", "year", "weekyear", *LONG_UNITS):
            raise QueryError(f"unknown unit {unit}")
        return Value(let(x.col, lambda c: _cut(kind, unit, Value(c, x.type), fields)), v.Type(kind))

    return f


# ---- accessors ------------------------------------------------------------------------


def accessor(x: Value, name: str) -> Value:
    key = name.lower()
    if x.type == v.DURATION:
        return Value(let(x.col, lambda d: _duration_field(d, key)), INT)
    if x.type.kind in ("date", "localdatetime", "datetime"):
        date = wall(x).cast("date")
        quarter_start = F.trunc(date, "quarter")
        found = {
            "year": lambda: F.year(date),
            "month": lambda: F.month(date),
            "day": lambda: F.dayofmonth(date),
            "quarter": lambda: F.quarter(date),
            "dayofweek": lambda: F.weekday(date) + 1,
            "weekday": lambda: F.weekday(date) + 1,
            "dayofquarter": lambda: F.datediff(date, quarter_start) + 1,
            "dayofyear": lambda: F.dayofyear(date),
            "ordinalday": lambda: F.dayofyear(date),
            "week": lambda: F.weekofyear(date),
            "weekyear": lambda: F.extract(F.lit("YEAROFWEEK"), date),
            "epochdays": lambda: F.datediff(date, F.lit("1970-01-01").cast("date")),
        }.get(key)
        if found:
            return Value(found().cast("bigint"), INT)
    if x.type == v.DATETIME and key in ("epochseconds", "epochmillis"):
        return Value(F.call_function("div", F.unix_micros(x.col["at"]), _lit(1_000_000 if key == "epochseconds" else 1_000)), INT)
    if x.type != v.DATE:
        nanos = nanos_of_day(x)
        part = lambda size, of: F.call_function("div", nanos % of, _lit(size))
        found = {
            "hour": lambda: part(UNITS["hour"], DAY),
            "minute": lambda: part(UNITS["minute"], UNITS["hour"]),
            "second": lambda: part(SECOND, UNITS["minute"]),
            "millisecond": lambda: part(1_000_000, SECOND),
            "microsecond": lambda: part(1_000, SECOND),
            "nanosecond": lambda: nanos % SECOND,
        }.get(key)
        if found:
            return Value(found().cast("bigint"), INT)
    if x.type in (v.TIME, v.DATETIME):
        seconds = offset_seconds(x)
        if key == "timezone":
            return Value(x.col["zone"] if x.type == v.DATETIME else _offset_text(seconds), STRING)
        if key == "offset":
            return Value(_offset_text(seconds), STRING)
        if key in ("offsetminutes", "offsetseconds"):
            return Value((seconds / (60 if key == "offsetminutes" else 1)).cast("bigint"), INT)
    return Value(F.lit(None).cast("bigint"), INT)


def _duration_field(d: Column, key: str) -> Column:
    div = lambda c, n: F.call_function("div", c, _lit(n))
    nanos = d["nanos"].cast("bigint")
    table = {
        "years": lambda: div(d["months"], 12),
        "quarters": lambda: div(d["months"], 3),
        "months": lambda: d["months"],
        "weeks": lambda: div(d["days"], 7),
        "days": lambda: d["days"],
        "hours": lambda: div(d["seconds"], 3600),
        "minutes": lambda: div(d["seconds"], 60),
        "seconds": lambda: d["seconds"],
        "milliseconds": lambda: d["seconds"] * 1_000 + div(nanos, 1_000_000),
        "microseconds": lambda: d["seconds"] * 1_000_000 + div(nanos, 1_000),
        "nanoseconds": lambda: d["seconds"] * SECOND + nanos,
        "quartersofyear": lambda: div(d["months"], 3) % 4,
        "monthsofyear": lambda: d["months"] % 12,
        "monthsofquarter": lambda: d["months"] % 3,
        "daysofweek": lambda: d["days"] % 7,
        "hoursofday": lambda: div(d["seconds"], 3600) % 24,
        "minutesofhour": lambda: div(d["seconds"], 60) % 60,
        "secondsofminute": lambda: d["seconds"] % 60,
        "millisecondsofsecond": lambda: div(nanos, 1_000_000),
        "microsecondsofsecond": lambda: div(nanos, 1_000),
        "nanosecondsofsecond": lambda: nanos,
    }
    if key not in table:
        return F.lit(None).cast("bigint")
    return table[key]().cast("bigint")


def _from_epoch(compiler, args) -> Value:
    seconds, nanos = (compiler(a).col.cast("bigint") for a in args)
    return Value(F.struct(F.timestamp_micros(seconds * 1_000_000 + F.call_function("div", nanos, _lit(1000))).alias("at"), F.lit("Z").alias("zone")), v.DATETIME)


def _from_epoch_millis(compiler, args) -> Value:
    return Value(F.struct(F.timestamp_millis(compiler(args[0]).col.cast("bigint")).alias("at"), F.lit("Z").alias("zone")), v.DATETIME)


#: Name -> (least arguments, most arguments, builder).
FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "duration": (1, 1, _duration),
    "duration.between": (2, 2, _between("between")),
    "duration.inmonths": (2, 2, _between("months")),
    "duration.indays": (2, 2, _between("days")),
    "duration.inseconds": (2, 2, _between("seconds")),
    "datetime.fromepoch": (2, 2, _from_epoch),
    "datetime.fromepochmillis": (1, 1, _from_epoch_millis),
}
for _kind in v.TEMPORAL:
    FUNCTIONS[_kind] = (0, 1, _constructor(_kind))
    FUNCTIONS[f"{_kind}.truncate"] = (1, 3, _truncate(_kind))
    for _form in ("transaction", "statement", "realtime"):
        FUNCTIONS[f"{_kind}.{_form}"] = (0, 1, _clock(_kind))
