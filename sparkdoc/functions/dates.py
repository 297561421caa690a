"""Date operators. Dates are timestamps without zone, read as UTC; sessions run at UTC."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

from .core import DATE, LONG, STRING, E, Scope, constant, fail_when, is_date, is_null, is_string, named, number, register, value

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MICROS = {"millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col.cast(LONG)).cast(DATE)


def date_of(e: E, op: str) -> Column:
    if is_null(e.type):
        return F.lit(None).cast(DATE)
    if not is_date(e.type):
        raise QueryError(f"{op} needs a date, not {e.type.simpleString()}")
    return e.col.cast(DATE)


def _zone(spec: dict, op: str) -> str | None:
    """A zone's name or offset; None for UTC."""
    zone = constant(spec.get("timezone"), op)
    if zone in (None, "UTC", "Z", "GMT", "Etc/UTC"):
        return None
    if not isinstance(zone, str):
        raise QueryError(f"{op} needs a timezone's name or offset")
    return zone


def localised(col: Column, zone: str | None) -> Column:
    return col if zone is None else F.from_utc_timestamp(col.cast("timestamp"), zone).cast(DATE)


def utc(col: Column, zone: str | None) -> Column:
    return col if zone is None else F.to_utc_timestamp(col.cast("timestamp"), zone).cast(DATE)


def _operand(spec: Any, scope: Scope, op: str) -> Column:
    """An expression or {date, timezone}, as local time."""
    if isinstance(spec, list) and len(spec) == 1:
        spec = spec[0]
    if isinstance(spec, dict) and "date" in spec:
        named(spec, op, ("date",), ("timezone",))
        return localised(date_of(value(spec["date"], scope), op), _zone(spec, op))
    return date_of(value(spec, scope), op)


def _weekday(d: Column) -> Column:
    return F.dayofweek(d)


#: Sunday-based week of the year, 0 to 53.
def _week(d: Column) -> Column:
    return F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7)


PARTS = {
    "$year": F.year,
    "$month": F.month,
    "$dayOfMonth": F.dayofmonth,
    "$hour": F.hour,
    "$minute": F.minute,
    "$second": lambda d: F.floor(F.extract(F.lit("SECOND"), d)),
    "$millisecond": lambda d: F.floor(F.pmod(micros(d), F.lit(10**6)) / 1000),
    "$dayOfWeek": _weekday,
    "$isoDayOfWeek": lambda d: F.extract(F.lit("DAYOFWEEK_ISO"), d),
    "$dayOfYear": F.dayofyear,
    "$week": _week,
    "$isoWeek": F.weekofyear,
    "$isoWeekYear": lambda d: F.extract(F.lit("YEAROFWEEK"), d),
}


def _part(name: str, compute) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        return E(compute(_operand(spec, scope, name)).cast(LONG), LONG)


for _name, _compute in PARTS.items():
    _part(_name, _compute)


def _unit(spec: dict, op: str) -> str:
    unit = constant(spec["unit"], op)
    if unit not in UNITS:
        raise QueryError(f"{op} knows no unit {unit}")
    return unit


def plus_units(d: Column, unit: str, amount: Column) -> Column:
    """Months, quarters and years keep the day, or take the month's last."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months:
        return (d + F.make_ym_interval(F.lit(0), (amount * months).cast("int"))).cast(DATE)
    return from_micros(micros(d) + amount * MICROS[unit])


def _shift(name: str, sign: int) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        named(spec, name, ("startDate", "unit", "amount"), ("timezone",))
        zone = _zone(spec, name)
        start = localised(date_of(value(spec["startDate"], scope), name), zone)
        amount = number(value(spec["amount"], scope), name).col
        return E(utc(plus_units(start, _unit(spec, name), amount * sign), zone), DATE)


_shift("$dateAdd", 1)
_shift("$dateSubtract", -1)


def truncate(d: Column, unit: str, size: int = 1, week_start: str = "sunday") -> Column:
    """The start of the bin. Years count from year 1; quarters and months start again every year; weeks, days and
    smaller units count from 1970."""
    if size < 1:
        raise QueryError("binSize must be positive")
    if unit == "year":
        year = F.floor((F.year(d) - 1) / size) * size + 1
        return F.make_timestamp_ntz(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) if size > 1 else F.date_trunc("year", d).cast(DATE)
    if unit in ("quarter", "month"):
        width = size * (3 if unit == "quarter" else 1)
        month = F.floor((F.month(d) - 1) / width) * width + 1
        return F.when(d.isNotNull(), F.make_timestamp_ntz(F.year(d), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    if unit == "week":
        first = week_start.lower()
        if first not in WEEKDAYS:
            raise QueryError(f"startOfWeek is a weekday, not {week_start}")
        # 1970-01-04 was a Sunday; the anchor is the last such day up to then
        anchor = 3 - (7 - WEEKDAYS.index(first)) % 7
        width, origin = MICROS["week"] * size, anchor * MICROS["day"]
        return from_micros(F.floor((micros(d) - origin) / width) * width + origin)
    if unit == "millisecond":
        raise QueryError("$dateTrunc knows no unit millisecond")
    width = MICROS[unit] * size
    if size == 1:
        return F.date_trunc(unit, d).cast(DATE)
    return from_micros((micros(d) - F.pmod(micros(d), F.lit(width))))


@register("$dateTrunc")
def date_trunc(spec: Any, scope: Scope) -> E:
    named(spec, "$dateTrunc", ("date", "unit"), ("binSize", "timezone", "startOfWeek"))
    if _zone(spec, "$dateTrunc"):
        raise QueryError("$dateTrunc knows the timezone UTC only")
    size = constant(spec.get("binSize", 1), "$dateTrunc")
    if not isinstance(size, int) or isinstance(size, bool):
        raise QueryError("$dateTrunc needs a whole binSize")
    return E(truncate(date_of(value(spec["date"], scope), "$dateTrunc"), _unit(spec, "$dateTrunc"), size, constant(spec.get("startOfWeek", "sunday"), "$dateTrunc")), DATE)


@register("$dateDiff")
def date_diff(spec: Any, scope: Scope) -> E:
    named(spec, "$dateDiff", ("startDate", "endDate", "unit"), ("timezone", "startOfWeek"))
    zone, unit = _zone(spec, "$dateDiff"), _unit(spec, "$dateDiff")
    a, b = (localised(date_of(value(spec[k], scope), "$dateDiff"), zone) for k in ("startDate", "endDate"))
    if unit == "millisecond":
        gap = micros(b) - micros(a)
        return E((F.signum(gap) * F.floor(F.abs(gap) / 1000)).cast(LONG), LONG)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months:
        number_of = lambda d: F.year(d) * (12 // months) + F.floor((F.month(d) - 1) / months)
        return E((number_of(b) - number_of(a)).cast(LONG), LONG)
    start = constant(spec.get("startOfWeek", "sunday"), "$dateDiff")
    a, b = (truncate(d, unit, 1, start) for d in (a, b))
    return E(((micros(b) - micros(a)) / MICROS[unit]).cast(LONG), LONG)


#: Tokens of $dateToString and the pattern that formats each.
FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS"}


def format_date(d: Column, pattern: str, zone: str | None, original: Column) -> Column:
    parts: list[Column] = []
    k = 0
    while k < len(pattern):
        token = pattern[k : k + 2]
        if token in FORMATS:
            parts.append(F.date_format(d.cast("timestamp"), FORMATS[token]))
        elif token == "%G":
            parts.append(F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast(STRING), 4, "0"))
        elif token == "%V":
            parts.append(F.lpad(F.weekofyear(d).cast(STRING), 2, "0"))
        elif token == "%u":
            parts.append(F.extract(F.lit("DAYOFWEEK_ISO"), d).cast(STRING))
        elif token == "%z":
            minutes = F.floor((micros(d) - micros(original)) / MICROS["minute"])
            size = F.abs(minutes)
            parts.append(F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast(STRING), 2, "0"), F.lpad((size % 60).cast(STRING), 2, "0")))
        else:
            parts.append(F.lit(pattern[k]))
            k -= 1
        k += 2
    return F.concat(*parts) if parts else F.lit("")


@register("$dateToString")
def date_to_string(spec: Any, scope: Scope) -> E:
    named(spec, "$dateToString", ("date",), ("format", "timezone", "onNull"))
    zone = _zone(spec, "$dateToString")
    original = date_of(value(spec["date"], scope), "$dateToString")
    pattern = constant(spec.get("format"), "$dateToString") or ("%Y-%m-%dT%H:%M:%S.%L" + ("" if zone else "Z"))
    made = format_date(localised(original, zone), pattern, zone, original)
    on_null = value(spec.get("onNull"), scope)
    return E(F.when(original.isNull(), on_null.col.cast(STRING)).otherwise(made), STRING)


@register("$dateFromString")
def date_from_string(spec: Any, scope: Scope) -> E:
    named(spec, "$dateFromString", ("dateString",), ("format", "timezone", "onError", "onNull"))
    source = value(spec["dateString"], scope)
    if is_null(source.type):
        source = E(F.lit(None).cast(STRING), STRING)
    if not is_string(source.type):
        if "onError" in spec:
            return value(spec["onError"], scope)
        raise QueryError("$dateFromString needs a string")
    pattern, zone = constant(spec.get("format"), "$dateFromString"), _zone(spec, "$dateFromString")
    if pattern:
        known = FORMATS | {"%z": "xx"}
        java, k = "", 0
        while k < len(pattern):
            if pattern[k] == "%":
                if pattern[k : k + 2] not in known:
                    raise QueryError(f"$dateFromString knows no token {pattern[k : k + 2]}")
                java += known[pattern[k : k + 2]]
                k += 2
            else:
                java += "''" if pattern[k] == "'" else f"'{pattern[k]}'" if pattern[k].isalpha() else pattern[k]
                k += 1
        made = F.try_to_timestamp(source.col, F.lit(java)).cast(DATE)
        zoned = "%z" in pattern
    else:
        made = F.when(source.col.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), source.col.try_cast("timestamp").cast(DATE))
        zoned = False
    made = made if zoned else utc(made, zone)
    on_error = value(spec["onError"], scope).col.cast(DATE) if "onError" in spec else F.raise_error(F.lit("$dateFromString cannot read the date")).cast(DATE)
    on_null = value(spec.get("onNull"), scope).col.cast(DATE)
    return E(F.when(source.col.isNull(), on_null).otherwise(F.coalesce(made, on_error)), DATE)


def _record(parts: dict[str, Column], present: Column) -> E:
    return E(F.when(present, F.struct(*[c.cast(LONG).alias(n) for n, c in parts.items()])), T.StructType([T.StructField(n, LONG) for n in parts]))


@register("$dateToParts")
def date_to_parts(spec: Any, scope: Scope) -> E:
    named(spec, "$dateToParts", ("date",), ("timezone", "iso8601"))
    d = localised(date_of(value(spec["date"], scope), "$dateToParts"), _zone(spec, "$dateToParts"))
    if constant(spec.get("iso8601", False), "$dateToParts"):
        names = {"isoWeekYear": "$isoWeekYear", "isoWeek": "$isoWeek", "isoDayOfWeek": "$isoDayOfWeek"}
    else:
        names = {"year": "$year", "month": "$month", "day": "$dayOfMonth"}
    names |= {"hour": "$hour", "minute": "$minute", "second": "$second", "millisecond": "$millisecond"}
    return _record({n: PARTS[op](d) for n, op in names.items()}, d.isNotNull())


@register("$dateFromParts")
def date_from_parts(spec: Any, scope: Scope) -> E:
    iso = isinstance(spec, dict) and "isoWeekYear" in spec
    first = ("isoWeekYear",) if iso else ("year",)
    named(spec, "$dateFromParts", first, (*(("isoWeek", "isoDayOfWeek") if iso else ("month", "day")), "hour", "minute", "second", "millisecond", "timezone"))
    ranges = {"month": (1, 12), "day": (1, 31), "isoWeek": (1, 53), "isoDayOfWeek": (1, 7), "hour": (0, 23), "minute": (0, 59), "second": (0, 59), "millisecond": (0, 999)}

    def part(name: str, default: int) -> Column:
        if name not in spec:
            return F.lit(default)
        col = number(value(spec[name], scope), "$dateFromParts").col.cast("int")
        lo, hi = ranges.get(name, (1, 9999))
        return fail_when((col < lo) | (col > hi), f"$dateFromParts: {name} goes from {lo} to {hi}", col)

    seconds = part("second", 0) + part("millisecond", 0) / F.lit(1000)
    clock = (part("hour", 0), part("minute", 0), seconds.cast("decimal(16,6)"))
    if iso:
        # the week of January 4 is week 1
        jan4 = F.make_timestamp_ntz(part("isoWeekYear", 1970), F.lit(1), F.lit(4), *clock)
        monday = plus_units(jan4, "day", 1 - F.extract(F.lit("DAYOFWEEK_ISO"), jan4))
        made = plus_units(monday, "day", (part("isoWeek", 1) - 1) * 7 + part("isoDayOfWeek", 1) - 1)
    else:
        made = F.make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), *clock)
    return E(utc(made, _zone(spec, "$dateFromParts")), DATE)


