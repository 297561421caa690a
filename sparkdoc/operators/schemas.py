"""`$jsonSchema` as a boolean column, generated from the schema and the column's type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import E, alias_of, equal, is_array, is_null, is_number, is_string, literal, step
from ..functions.strings import matches

#: What the plain `type` keyword's names mean.
PLAIN = {"object": {"object"}, "array": {"array"}, "string": {"string"}, "number": {"int", "long", "double", "decimal"}, "boolean": {"bool"}, "null": {"null"}}
KNOWN = {"bsonType", "type", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "allOf", "anyOf", "oneOf", "not", "title", "description"}


def valid(schema: Any, e: E) -> Column:
    """Whether a value conforms; keywords for other kinds of values don't apply to it."""
    if not isinstance(schema, dict):
        raise QueryError("$jsonSchema takes an object")
    if unknown := set(schema) - KNOWN:
        raise QueryError(f"$jsonSchema knows no {', '.join(sorted(unknown))}")
    present = F.lit(False) if is_null(e.type) else e.col.isNotNull()
    out: list[Column] = []
    for key, names in (("bsonType", None), ("type", PLAIN)):
        if key in schema:
            wanted: set[str] = set()
            for name in schema[key] if isinstance(schema[key], list) else [schema[key]]:
                wanted |= names[name] if names else ({"int", "long", "double", "decimal"} if name == "number" else {name})
            own = not is_null(e.type) and alias_of(e.type) in wanted
            out.append((present if own else F.lit(False)) | (~present if "null" in wanted else F.lit(False)))
    if "enum" in schema:
        out.append(_any([equal(e, literal(x)) for x in schema["enum"]]))
    if isinstance(e.type, T.StructType):
        for name in schema.get("required", []):
            found = step(e, name)
            out.append(~present | (F.lit(False) if is_null(found.type) else found.col.isNotNull()))
        for name, inner in schema.get("properties", {}).items():
            found = step(e, name)
            if not is_null(found.type):
                out.append(found.col.isNull() | valid(inner, found))
        extra = schema.get("additionalProperties", True)
        for name in e.type.names if extra is not True else []:
            if name not in schema.get("properties", {}) and not name.startswith("__"):
                found = step(e, name)
                out.append(found.col.isNull() | (F.lit(False) if extra is False else valid(extra, found)))
    if is_array(e.type):
        if "items" in schema:
            out.append(~present | F.forall(e.col, lambda x: valid(schema["items"], E(x, e.type.elementType))))
        for key, test in (("minItems", lambda n: F.size(e.col) >= n), ("maxItems", lambda n: F.size(e.col) <= n)):
            if key in schema:
                out.append(~present | test(schema[key]))
    if is_string(e.type):
        for key, test in (("minLength", lambda n: F.char_length(e.col) >= n), ("maxLength", lambda n: F.char_length(e.col) <= n), ("pattern", lambda p: matches(e.col, p))):
            if key in schema:
                out.append(~present | test(schema[key]))
    if is_number(e.type):
        for key, test in (("minimum", lambda n: e.col >= n), ("maximum", lambda n: e.col <= n)):
            if key in schema:
                out.append(~present | test(schema[key]))
    if "allOf" in schema:
        out += [valid(s, e) for s in schema["allOf"]]
    if "anyOf" in schema:
        out.append(_any([valid(s, e) for s in schema["anyOf"]]))
    if "oneOf" in schema:
        counts = F.lit(0)
        for s in schema["oneOf"]:
            counts = counts + F.coalesce(valid(s, e), F.lit(False)).cast("int")
        out.append(counts == 1)
    if "not" in schema:
        out.append(~F.coalesce(valid(schema["not"], e), F.lit(False)))
    result = F.lit(True)
    for part in out:
        result = result & F.coalesce(part, F.lit(False))
    return result


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
