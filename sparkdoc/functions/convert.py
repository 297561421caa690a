"""Type conversions. Each is (strict column, lenient column): the lenient one is null where the strict one fails."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .arith import millis
from .core import BOOL, DATE, DECIMAL, DOUBLE, LONG, STRING, E, Scope, arguments, cast, common_type, compile_expression, constant, is_date, is_float, is_null, is_number, is_object, is_string, literal, named, register, value

INT = T.IntegerType()


def _to_whole(e: E, to: T.DataType, name: str) -> Column:
    """null where the conversion is impossible (for a non-null input)."""
    if isinstance(e.type, T.BooleanType):
        return e.col.cast(to)
    if is_number(e.type):
        return e.col.try_cast(to) if not is_float(e.type) else F.when(~F.isnan(e.col), F.signum(e.col) * F.floor(F.abs(e.col))).try_cast(to)
    if is_string(e.type):
        s = F.trim(e.col)
        return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast(to))
    if is_date(e.type) and isinstance(to, T.LongType):
        return millis(e)
    raise QueryError(f"{name} cannot convert {e.type.simpleString()}")


def _bool(e: E) -> Column:
    if isinstance(e.type, T.BooleanType):
        return e.col
    if is_number(e.type):
        return e.col != 0
    return F.when(e.col.isNotNull(), F.lit(True))


def _double(e: E) -> Column:
    if is_number(e.type) or isinstance(e.type, T.BooleanType):
        return e.col.cast(DOUBLE)
    if is_string(e.type):
        return F.trim(e.col).try_cast(DOUBLE)
    if is_date(e.type):
        return millis(e).cast(DOUBLE)
    raise QueryError(f"$toDouble cannot convert {e.type.simpleString()}")


def _decimal(e: E) -> Column:
    if is_number(e.type) or isinstance(e.type, T.BooleanType):
        return (e.col.cast(STRING) if is_float(e.type) else e.col.cast(LONG) if isinstance(e.type, T.BooleanType) else e.col).try_cast(DECIMAL)
    if is_string(e.type):
        return F.trim(e.col).try_cast(DECIMAL)
    raise QueryError(f"$toDecimal cannot convert {e.type.simpleString()}")


def date_text(col: Column) -> Column:
    return F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _string(e: E) -> Column:
    if isinstance(e.type, T.BooleanType):
        return e.col.cast(STRING)
    if is_date(e.type):
        return date_text(e.col)
    if isinstance(e.type, T.BinaryType):
        return F.base64(e.col)
    if is_float(e.type):
        # plain digits from 1e-4 up to 1e16, else a mantissa without ".0" and an exponent with a sign and two digits
        java, size = e.col.cast(DOUBLE).cast(STRING), F.abs(e.col)
        digits = F.regexp_replace(java.try_cast("decimal(38,21)").cast(STRING), r"(\.\d+?)0+$", "$1")
        exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E-", "e-"), "E", "e+")
        exponent = F.regexp_replace(exponent, r"(e[+-])(\d)$", "$10$2")
        return F.when(F.isnan(e.col), F.lit("nan")).when(size == float("inf"), F.lower(F.regexp_replace(java, "inity", ""))).when((size >= 1e16) | ((size < 1e-4) & (size > 0)), exponent).when((size >= 1e7) | ((size < 1e-3) & (size > 0)), digits).otherwise(java)
    if is_number(e.type) or is_string(e.type):
        return e.col.cast(STRING)
    if is_object(e.type):
        return F.to_json(e.col)
    raise QueryError(f"$toString cannot convert {e.type.simpleString()}")


def _date(e: E) -> Column:
    if is_date(e.type):
        return e.col.cast(DATE)
    if is_number(e.type):
        return F.timestamp_micros(F.floor(e.col.cast(DOUBLE) * 1000).cast(LONG)).cast(DATE) if is_float(e.type) else F.timestamp_millis(e.col.cast(LONG)).cast(DATE)
    if is_string(e.type):
        seconds = F.conv(F.substring(e.col, 1, 8), 16, 10).cast(LONG)
        from_id = F.when(e.col.rlike("^[0-9a-fA-F]{24}$"), F.timestamp_seconds(seconds).cast(DATE))
        return F.coalesce(from_id, F.when(e.col.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), e.col.try_cast("timestamp").cast(DATE)))
    raise QueryError(f"$toDate cannot convert {e.type.simpleString()}")


def _object_id(e: E) -> Column:
    if not is_string(e.type):
        raise QueryError(f"$toObjectId cannot convert {e.type.simpleString()}")
    return F.when(e.col.rlike("^[0-9a-fA-F]{24}$"), F.lower(e.col))


def _uuid(e: E) -> Column:
    if isinstance(e.type, T.BinaryType):
        plain = F.when(F.octet_length(e.col) == 16, F.lower(F.hex(e.col)))
    elif is_string(e.type):
        plain = F.lower(F.regexp_replace(e.col, "[{}-]|urn:uuid:", ""))
        plain = F.when(plain.rlike("^[0-9a-f]{32}$"), plain)
    else:
        raise QueryError(f"$toUUID cannot convert {e.type.simpleString()}")
    return F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


#: Target: (conversion, type).
TARGETS = {
    "bool": (_bool, BOOL),
    "int": (lambda e: _to_whole(e, INT, "$toInt"), INT),
    "long": (lambda e: _to_whole(e, LONG, "$toLong"), LONG),
    "double": (_double, DOUBLE),
    "decimal": (_decimal, DECIMAL),
    "string": (_string, STRING),
    "date": (_date, DATE),
    "objectId": (_object_id, STRING),
    "uuid": (_uuid, STRING),
}


def _strict(name: str, target: str) -> None:
    convert, kind = TARGETS[target]

    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        e = arguments(spec, scope, name, 1, 1)[0]
        if is_null(e.type):
            return E(F.lit(None).cast(kind), kind)
        if isinstance(e.type, T.VariantType):
            return E(F.variant_get(e.col, "$", kind.simpleString()), kind)
        made = convert(e)
        failed = F.when(e.col.isNotNull(), F.raise_error(F.lit(f"{name} cannot convert the value"))).cast(kind)
        return E(made if target in ("bool", "string") else F.coalesce(made, failed), kind)


for _name, _target in (("$toBool", "bool"), ("$toInt", "int"), ("$toLong", "long"), ("$toDouble", "double"), ("$toDecimal", "decimal"), ("$toString", "string"), ("$toDate", "date"), ("$toObjectId", "objectId"), ("$toUUID", "uuid")):
    _strict(_name, _target)


@register("$convert")
def convert(spec: Any, scope: Scope) -> E:
    named(spec, "$convert", ("input", "to"), ("onError", "onNull"))
    target = constant(spec["to"], "$convert")
    target = target.get("type") if isinstance(target, dict) else target
    e = value(spec["input"], scope)
    on_null = value(spec["onNull"], scope) if "onNull" in spec else literal(None)
    if target not in ("bool", "int", "long", "double", "date", "objectId", "string"):
        if "onError" not in spec:
            raise QueryError(f"$convert knows no target {target}")
        return value(spec["onError"], scope)
    to, kind = TARGETS[target]
    if is_null(e.type):
        made = E(F.lit(None).cast(kind), kind)
    else:
        try:
            made = E(to(e), kind)
        except QueryError:
            if "onError" not in spec:
                raise
            made = E(F.lit(None).cast(kind), kind)
    on_error = compile_expression(spec["onError"], scope) if "onError" in spec else E(F.raise_error(F.lit("$convert cannot convert the value")).cast(kind), kind)
    out = common_type([kind, on_null.type, on_error.type])
    return E(F.when(e.col.isNull(), cast(on_null, out)).otherwise(F.coalesce(cast(made, out), cast(on_error, out))), out)
