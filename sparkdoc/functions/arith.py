"""Arithmetic, bit and statistics operators."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import DATE, DECIMAL, DOUBLE, LONG, E, Scope, arguments, array_of, cast, common_type, constant, fail_when, is_array, is_date, is_int, is_null, is_number, literal, named, number, register, value, wide


def millis(e: E) -> Column:
    """Milliseconds since 1970 (sessions run at UTC)."""
    return F.unix_millis(e.col.cast("timestamp"))


def plus_millis(date: Column, ms: Column) -> Column:
    return (date + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))).cast(DATE)


def _fold(spec: Any, scope: Scope, op: str, least: int, join) -> E:
    args = [number(e, op) for e in arguments(spec, scope, op, least)]
    kind = common_type([e.type for e in args])
    return E(reduce(join, [cast(e, kind) for e in args]), kind)


@register("$add")
def add(spec: Any, scope: Scope) -> E:
    args = arguments(spec, scope, "$add", 1)
    dates = [e for e in args if is_date(e.type)]
    if len(dates) > 1:
        raise QueryError("$add takes one date at most")
    if dates:
        rest = [number(e, "$add") for e in args if not is_date(e.type)]
        total = reduce(lambda a, b: a + b, [e.col for e in rest], F.lit(0))
        return E(plus_millis(dates[0].col, total), DATE)
    return _fold(spec, scope, "$add", 1, lambda a, b: a + b)


@register("$multiply")
def multiply(spec: Any, scope: Scope) -> E:
    return _fold(spec, scope, "$multiply", 1, lambda a, b: a * b)


@register("$subtract")
def subtract(spec: Any, scope: Scope) -> E:
    a, b = arguments(spec, scope, "$subtract", 2, 2)
    if is_date(a.type) and is_date(b.type):
        return E(millis(a) - millis(b), LONG)
    if is_date(a.type):
        return E(plus_millis(a.col, -number(b, "$subtract").col), DATE)
    a, b = number(a, "$subtract"), number(b, "$subtract")
    kind = common_type([a.type, b.type])
    return E(cast(a, kind) - cast(b, kind), kind)


@register("$divide")
def divide(spec: Any, scope: Scope) -> E:
    a, b = (number(e, "$divide") for e in arguments(spec, scope, "$divide", 2, 2))
    kind = DECIMAL if isinstance(common_type([a.type, b.type]), T.DecimalType) else DOUBLE
    return E((cast(a, kind) / cast(b, kind)).cast(kind), kind)


@register("$mod")
def mod(spec: Any, scope: Scope) -> E:
    a, b = (number(e, "$mod") for e in arguments(spec, scope, "$mod", 2, 2))
    kind = common_type([a.type, b.type])
    return E(cast(a, kind) % cast(b, kind), kind)


@register("$abs")
def absolute(spec: Any, scope: Scope) -> E:
    e = number(arguments(spec, scope, "$abs", 1, 1)[0], "$abs")
    return E(F.abs(e.col), e.type)


def _real(name: str, compute, bad=None, message: str = "") -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        x = number(arguments(spec, scope, name, 1, 1)[0], name).col.cast(DOUBLE)
        return E(fail_when(bad(x), f"{name} {message}", compute(x)) if bad else compute(x), DOUBLE)


_real("$exp", F.exp)
_real("$ln", F.ln, lambda x: x <= 0, "needs a positive number")
_real("$log10", F.log10, lambda x: x <= 0, "needs a positive number")
_real("$sqrt", F.sqrt, lambda x: x < 0, "needs a number of at least 0")


@register("$log")
def log(spec: Any, scope: Scope) -> E:
    x, base = (number(e, "$log").col.cast(DOUBLE) for e in arguments(spec, scope, "$log", 2, 2))
    return E(fail_when((x <= 0) | (base <= 0) | (base == 1), "$log needs positive numbers and a base other than 1", F.ln(x) / F.ln(base)), DOUBLE)


@register("$pow")
def power(spec: Any, scope: Scope) -> E:
    x, y = (number(e, "$pow").col.cast(DOUBLE) for e in arguments(spec, scope, "$pow", 2, 2))
    return E(fail_when((x == 0) & (y < 0), "$pow cannot raise 0 to a negative exponent", F.pow(x, y)), DOUBLE)


def _place(spec: Any, op: str) -> tuple[Any, int]:
    items = spec if isinstance(spec, list) else [spec]
    place = constant(items[1], op) if len(items) > 1 else 0
    if not isinstance(place, int) or isinstance(place, bool) or not -20 <= place <= 100:
        raise QueryError(f"{op} takes a place from -20 to 100")
    return items[0], place


@register("$round")
def round_(spec: Any, scope: Scope) -> E:
    inner, place = _place(spec, "$round")
    e = number(value(inner, scope), "$round")
    if place <= 0:
        return E(F.bround(e.col, place).cast(LONG), LONG)
    return e if is_int(e.type) else E(F.bround(e.col, place).cast(e.type), e.type)


@register("$trunc")
def trunc(spec: Any, scope: Scope) -> E:
    inner, place = _place(spec, "$trunc")
    e = number(value(inner, scope), "$trunc")
    if is_int(e.type) and place >= 0:
        return e
    scale = F.lit(10.0**place)
    toward_zero = F.signum(e.col) * F.floor(F.abs(e.col) * scale) / scale
    return E(toward_zero.cast(LONG), LONG) if place <= 0 else E(toward_zero, DOUBLE)


@register("$floor")
def floor(spec: Any, scope: Scope) -> E:
    e = number(arguments(spec, scope, "$floor", 1, 1)[0], "$floor")
    return E(F.floor(e.col).cast(LONG), LONG)


@register("$ceil")
def ceil(spec: Any, scope: Scope) -> E:
    e = number(arguments(spec, scope, "$ceil", 1, 1)[0], "$ceil")
    return E(F.ceil(e.col).cast(LONG), LONG)


# --- over lists ------------------------------------------------------------------------------------------------------


def numbers_of(spec: Any, scope: Scope) -> E:
    """The numeric members of one array, or of the listed operands, as an array without nulls."""
    items = spec if isinstance(spec, list) else [spec]
    args = [value(x, scope) for x in items]
    if len(args) == 1 and is_array(args[0].type):
        kind = args[0].type.elementType
        if not is_number(kind):
            return E(F.array().cast(T.ArrayType(LONG)), T.ArrayType(LONG))
        to = wide(E(F.lit(0), kind)).type
        return E(F.coalesce(F.filter(args[0].col.cast(T.ArrayType(to)), lambda x: x.isNotNull()), F.array().cast(T.ArrayType(to))), T.ArrayType(to))
    known = [wide(e) for e in args if is_number(e.type)]
    if not known:
        return E(F.array().cast(T.ArrayType(LONG)), T.ArrayType(LONG))
    made = array_of(known)
    return E(F.filter(made.col, lambda x: x.isNotNull()), made.type)


def total(numbers: E) -> Column:
    kind = numbers.type.elementType
    return F.aggregate(numbers.col, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def mean(numbers: E) -> Column:
    return F.when(F.size(numbers.col) > 0, total(numbers).cast(DOUBLE) / F.size(numbers.col))


@register("$sum")
def sum_(spec: Any, scope: Scope) -> E:
    numbers = numbers_of(spec, scope)
    return E(total(numbers), numbers.type.elementType)


@register("$avg")
def avg(spec: Any, scope: Scope) -> E:
    return E(mean(numbers_of(spec, scope)), DOUBLE)


def _extreme(name: str, pick, fold) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        items = spec if isinstance(spec, list) else [spec]
        args = [wide(value(x, scope)) for x in items]
        if len(args) == 1 and is_array(args[0].type):
            numbers = numbers_of(spec, scope)
            return E(pick(numbers.col), numbers.type.elementType)
        args = [e for e in args if not is_null(e.type)]
        if not args:
            return literal(None)
        kind = common_type([e.type for e in args])
        return E(fold(*[cast(e, kind) for e in args]) if len(args) > 1 else args[0].col, kind)


_extreme("$min", F.array_min, F.least)
_extreme("$max", F.array_max, F.greatest)


def deviation(numbers: E, sample: bool) -> Column:
    n = F.size(numbers.col)
    at = mean(numbers)
    squares = F.aggregate(F.transform(numbers.col, lambda x: (x - at) * (x - at)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > (1 if sample else 0), F.sqrt(squares / (n - (1 if sample else 0))))


@register("$stdDevPop")
def std_dev_pop(spec: Any, scope: Scope) -> E:
    return E(deviation(numbers_of(spec, scope), False), DOUBLE)


@register("$stdDevSamp")
def std_dev_samp(spec: Any, scope: Scope) -> E:
    return E(deviation(numbers_of(spec, scope), True), DOUBLE)


def nearest_rank(ordered: Column, p: float) -> Column:
    """The member of an ascending array at the nearest rank, null for an empty one."""
    n = F.size(ordered)
    return F.get(ordered, F.greatest(F.ceil(n * F.lit(float(p))).cast("int") - 1, F.lit(0)))


def shares(spec: Any, op: str) -> list[float]:
    p = constant(spec, op)
    if not isinstance(p, list) or not p or not all(isinstance(x, int | float) and 0 <= x <= 1 for x in p):
        raise QueryError(f"{op} takes a list of numbers from 0 to 1 as p")
    return [float(x) for x in p]


def check_method(spec: dict, op: str) -> None:
    if spec["method"] != "approximate":
        raise QueryError(f"{op} knows the method 'approximate' only")


@register("$median")
def median(spec: Any, scope: Scope) -> E:
    check_method(named(spec, "$median", ("input", "method")), "$median")
    numbers = numbers_of(spec["input"], scope)
    return E(nearest_rank(F.sort_array(numbers.col), 0.5), numbers.type.elementType)


@register("$percentile")
def percentile(spec: Any, scope: Scope) -> E:
    check_method(named(spec, "$percentile", ("input", "p", "method")), "$percentile")
    numbers = numbers_of(spec["input"], scope)
    ordered = F.sort_array(numbers.col)
    return E(F.array(*[nearest_rank(ordered, p) for p in shares(spec["p"], "$percentile")]), numbers.type)


@register("$range")
def range_(spec: Any, scope: Scope) -> E:
    args = [number(e, "$range").col.cast(LONG) for e in arguments(spec, scope, "$range", 2, 3)]
    start, end, by = (*args, F.lit(1).cast(LONG))[:3]
    last = F.when(by > 0, end - 1).otherwise(end + 1)
    some = ((by > 0) & (start < end)) | ((by < 0) & (start > end))
    return E(fail_when(by == 0, "$range needs a step other than 0", F.when(some, F.sequence(start, last, by)).otherwise(F.array().cast(T.ArrayType(LONG)))), T.ArrayType(LONG))


def _bits(name: str, join) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        args = arguments(spec, scope, name, 1)
        if any(isinstance(e.type, T.BooleanType) for e in args):
            raise QueryError(f"{name} needs whole numbers")
        return E(reduce(join, [number(e, name).col.cast(LONG) for e in args]), LONG)


_bits("$bitAnd", lambda a, b: a.bitwiseAND(b))
_bits("$bitOr", lambda a, b: a.bitwiseOR(b))
_bits("$bitXor", lambda a, b: a.bitwiseXOR(b))


@register("$bitNot")
def bit_not(spec: Any, scope: Scope) -> E:
    return E(F.bitwise_not(number(arguments(spec, scope, "$bitNot", 1, 1)[0], "$bitNot").col.cast(LONG)), LONG)


@register("$rand")
def rand(spec: Any, scope: Scope) -> E:
    return E(F.rand(), DOUBLE)


