"""Filter documents, lowered to one boolean column; null counts as false (negations make it so).

A condition on a path holds if any candidate satisfies it: the value, or a member where the value is an array; paths fan
out over arrays on the way. Null and missing coincide in typed columns: null satisfies `$lt` and `$lte` (null is less
than everything) and does not exist for `$exists`. Predicates on plain columns keep the shape `column op literal`, so
that they reach the scan.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator
from ..functions.core import E, Scope, alias_of, equal, from_variant, is_array, is_float, is_int, is_null, is_number, is_object, is_string, less, literal, rank, step, truthy, value
from ..functions.strings import matches
from . import geo

Test = Callable[[E], Column]


def no(column: Column) -> Column:
    return ~F.coalesce(column, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def over(e: E, steps: list[str], test: Test, members: bool = True) -> Column:
    """Whether any candidate at the end of the path passes; `members`: those of a last array count too."""
    if steps:
        name, *rest = steps
        if is_array(e.type):
            inner = F.exists(e.col, lambda x: over(E(x, e.type.elementType), steps, test, members))
            if name.isdigit():
                inner = inner | over(E(F.get(e.col, F.lit(int(name))), e.type.elementType), rest, test, members)
            return F.coalesce(inner, F.lit(False))
        return over(step(e, name), rest, test, members)
    if is_array(e.type) and members:
        return F.coalesce(test(e), F.lit(False)) | F.coalesce(F.exists(e.col, lambda x: test(E(x, e.type.elementType))), F.lit(False))
    return test(e)


class Field:
    """A path in a scope, or a value that is already there."""

    def __init__(self, scope: Scope, path: str, given: E | None = None):
        self.scope = scope
        if given is not None:
            self.start, self.steps = given, []
        elif path in scope.fields:
            self.start, self.steps = scope.fields[path], []
        else:
            head, *self.steps = path.split(".")
            self.start = scope.fields.get(head) or E(F.lit(None), T.NullType())
        self.plain = not self.steps and not is_array(self.start.type)

    def any(self, test: Test, members: bool = True) -> Column:
        found = over(self.start, self.steps, test, members)
        return found if self.plain else F.coalesce(found, F.lit(False))


# --- single operators ------------------------------------------------------------------------------------------------


def _comparison(op: str, target: E) -> Test:
    def test(e: E) -> Column:
        e = e if is_null(target.type) else from_variant(e, target.type)
        if is_null(e.type):
            # a missing field compares like null
            if op in ("$gte", "$lte") and is_null(target.type):
                return F.lit(True)
            return F.lit(op in ("$lt", "$lte") and not is_null(target.type))
        if is_null(target.type):
            return {"$gt": e.col.isNotNull(), "$gte": F.lit(True), "$lt": F.lit(False), "$lte": e.col.isNull()}[op]
        if is_array(e.type) and not is_array(target.type):
            return F.lit(False)
        if rank(e.type) != rank(target.type):
            above = rank(e.type) > rank(target.type)
            if op in ("$gt", "$gte"):
                return e.col.isNotNull() if above else F.lit(False)
            return e.col.isNull() if above else F.lit(True)
        if is_array(e.type) or is_object(e.type):
            return {"$gt": less(target, e), "$gte": ~less(e, target), "$lt": less(e, target), "$lte": ~less(target, e)}[op]
        nan = F.isnan(e.col) if is_float(e.type) else None
        if op in ("$gt", "$gte"):
            plain = e.col > target.col if op == "$gt" else e.col >= target.col
            return plain if nan is None else plain & ~nan
        plain = e.col.isNull() | (e.col < target.col if op == "$lt" else e.col <= target.col)
        return plain if nan is None else plain | nan

    return test


def _equality(operand: Any) -> Test:
    if isinstance(operand, re.Pattern):
        return _pattern(operand.pattern, _flags(operand))
    target = literal(operand)

    def test(e: E) -> Column:
        if is_null(target.type):
            return e.col.isNull()
        e = from_variant(e, target.type)
        if is_null(e.type):
            return F.lit(False)
        if rank(e.type) == rank(target.type) and not is_array(e.type) and not is_object(e.type):
            return e.col == target.col  # null is not equal to a literal; the caller makes it two-valued
        return equal(e, target)

    return test


def _flags(pattern: re.Pattern) -> str:
    return "".join(f for f, flag in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & flag)


def _pattern(pattern: str, options: str) -> Test:
    return lambda e: matches(e.col, pattern, options) if is_string(e.type) else F.lit(False)


def _membership(operand: Any, op: str) -> Test:
    if not isinstance(operand, list | tuple):
        raise QueryError(f"{op} takes a list")
    plain = [x for x in operand if isinstance(x, int | float | str) and not isinstance(x, bool)]
    rest = [x for x in operand if not (isinstance(x, int | float | str) and not isinstance(x, bool))]

    def test(e: E) -> Column:
        parts = [_equality(x)(e) for x in rest]
        fitting = [x for x in plain if not is_null(e.type) and not is_array(e.type) and rank(e.type) == (3 if isinstance(x, str) else 2)]
        if fitting:
            parts.append(e.col.isin(fitting))
        return F.coalesce(any_of(parts), F.lit(False))

    return test


def _modulus(operand: Any) -> Test:
    if not (isinstance(operand, list | tuple) and len(operand) == 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in operand)) or int(operand[0]) == 0:
        raise QueryError("$mod takes a divisor other than 0 and a remainder")
    divisor, remainder = (int(x) for x in operand)

    def test(e: E) -> Column:
        if not is_number(e.type):
            return F.lit(False)
        if is_int(e.type):
            return e.col % F.lit(divisor) == remainder
        return F.abs(e.col % F.lit(float(divisor)) - remainder) <= 1e-12

    return test


def bit_mask(operand: Any, op: str) -> int:
    if isinstance(operand, bool):
        raise QueryError(f"{op} takes a mask or bit positions")
    if isinstance(operand, int) and operand >= 0:
        return operand
    if isinstance(operand, bytes | bytearray):
        return int.from_bytes(operand, "little")
    if isinstance(operand, list | tuple) and all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in operand):
        return sum(1 << min(x, 63) for x in set(operand))
    raise QueryError(f"{op} takes a mask or bit positions")


def _bits(operand: Any, op: str) -> Test:
    mask = bit_mask(operand, op)
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask

    def test(e: E) -> Column:
        if not is_number(e.type):
            return F.lit(False)
        whole = e.col.cast("long") if not is_float(e.type) else F.when(F.floor(e.col) == e.col, e.col).try_cast("long")
        found = whole.bitwiseAND(F.lit(mask).cast("long"))
        return {"$bitsAllSet": found == mask, "$bitsAnySet": found != 0, "$bitsAllClear": found == 0, "$bitsAnyClear": found != mask}[op]

    return test


#: Codes of types, and what an alias stands for.
TYPE_CODES = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 6: "undefined", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 13: "javascript", 16: "int", 17: "timestamp", 18: "long", 19: "decimal", -1: "minKey", 127: "maxKey"}


def type_names(operand: Any) -> set[str]:
    names: set[str] = set()
    for x in operand if isinstance(operand, list | tuple) else [operand]:
        name = TYPE_CODES.get(x) if isinstance(x, int) and not isinstance(x, bool) else x
        if name == "number":
            names |= {"int", "long", "double", "decimal"}
        elif name in TYPE_CODES.values():
            names.add(name)
        else:
            raise QueryError(f"$type knows no type {x}")
    return names


def _typed(operand: Any) -> Test:
    names = type_names(operand)

    def test(e: E) -> Column:
        if is_null(e.type):
            return F.lit(False)
        found = e.col.isNotNull() if alias_of(e.type) in names else F.lit(False)
        return found | e.col.isNull() if "null" in names else found

    return test


def _element(operand: Any, scope: Scope) -> Test:
    """For an array: one member that satisfies all of it."""
    if not isinstance(operand, dict):
        raise QueryError("$elemMatch takes an object")
    by_operator = bool(operand) and all(k.startswith("$") and k not in TOP_LEVEL for k in operand)

    def member(x: E) -> Column:
        if by_operator:
            return F.coalesce(all_of([field_condition(x, op, v, scope, operand) for op, v in operand.items()]), F.lit(False))
        if not isinstance(x.type, T.StructType):
            return F.lit(False)
        inner = Scope({f.name: E(x.col.getField(f.name), f.dataType) for f in x.type.fields}, scope.variables, scope.now)
        return compile_filter(operand, inner)

    return lambda e: F.exists(e.col, lambda x: member(E(x, e.type.elementType))) if is_array(e.type) else F.lit(False)


def field_condition(given: E, op: str, operand: Any, scope: Scope, siblings: dict | None = None) -> Column:
    return condition(Field(scope, "", given), op, operand, scope, siblings or {})


def condition(field: Field, op: str, operand: Any, scope: Scope, siblings: dict) -> Column:
    """One operator on one path."""
    if op == "$eq":
        return F.coalesce(field.any(_equality(operand)), F.lit(False)) if not field.plain else field.any(_equality(operand))
    if op == "$ne":
        return no(condition(field, "$eq", operand, scope, siblings))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if isinstance(operand, re.Pattern):
            raise QueryError(f"{op} takes no regular expression")
        return field.any(_comparison(op, literal(operand)))
    if op == "$in":
        return field.any(_membership(operand, op))
    if op == "$nin":
        return no(field.any(_membership(operand, op)))
    if op == "$all":
        if not isinstance(operand, list | tuple):
            raise QueryError("$all takes a list")
        if not operand:
            return F.lit(False)
        parts = [field.any(_element(x["$elemMatch"], scope), members=False) if isinstance(x, dict) and list(x) == ["$elemMatch"] else condition(field, "$eq", x, scope, {}) for x in operand]
        return F.coalesce(all_of(parts), F.lit(False))
    if op == "$size":
        if not isinstance(operand, int) or isinstance(operand, bool) or operand < 0:
            raise QueryError("$size takes a whole number of at least 0")
        return F.coalesce(field.any(lambda e: F.size(e.col) == operand if is_array(e.type) else F.lit(False), members=False), F.lit(False))
    if op == "$mod":
        return F.coalesce(field.any(_modulus(operand)), F.lit(False))
    if op in ("$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear"):
        return F.coalesce(field.any(_bits(operand, op)), F.lit(False))
    if op == "$regex":
        pattern, options = (operand.pattern, _flags(operand)) if isinstance(operand, re.Pattern) else (operand, "")
        if not isinstance(pattern, str):
            raise QueryError("$regex takes a pattern")
        return field.any(_pattern(pattern, siblings.get("$options", options)))
    if op == "$options":
        if "$regex" not in siblings:
            raise QueryError("$options needs $regex")
        return F.lit(True)
    if op == "$not":
        if isinstance(operand, re.Pattern):
            operand = {"$regex": operand}
        if not isinstance(operand, dict) or not operand or not all(k.startswith("$") for k in operand):
            raise QueryError("$not takes operators")
        return no(all_of([condition(field, o, v, scope, operand) for o, v in operand.items()]))
    if op == "$elemMatch":
        return F.coalesce(field.any(_element(operand, scope), members=False), F.lit(False))
    if op == "$exists":
        found = field.any(lambda e: F.lit(False) if is_null(e.type) else e.col.isNotNull(), members=False)
        return found if truth(operand) else no(found)
    if op == "$type":
        return F.coalesce(field.any(_typed(operand)), F.lit(False))
    if op in ("$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
        return F.coalesce(field.any(geo.test(op, operand, siblings), members=False), F.lit(False))
    if op in ("$minDistance", "$maxDistance", "$geometry") and ("$near" in siblings or "$nearSphere" in siblings):
        return F.lit(True)
    raise UnsupportedOperator("query operator", op)


def truth(operand: Any) -> bool:
    return not (operand is None or operand is False or (isinstance(operand, int | float) and operand == 0))


# --- documents of conditions -----------------------------------------------------------------------------------------


def _clauses(operand: Any, op: str, scope: Scope) -> list[Column]:
    if not isinstance(operand, list | tuple) or not operand:
        raise QueryError(f"{op} takes a list of filters")
    return [compile_filter(x, scope) for x in operand]


TOP_LEVEL = ("$and", "$or", "$nor", "$expr", "$jsonSchema", "$comment", "$text", "$where")


def compile_filter(spec: Any, scope: Scope) -> Column:
    """A filter document as a boolean column."""
    if not isinstance(spec, dict):
        raise QueryError("a filter is an object")
    parts: list[Column] = []
    for key, operand in spec.items():
        if key == "$and":
            parts.append(all_of(_clauses(operand, key, scope)))
        elif key == "$or":
            parts.append(any_of(_clauses(operand, key, scope)))
        elif key == "$nor":
            parts.append(no(any_of(_clauses(operand, key, scope))))
        elif key == "$expr":
            parts.append(truthy(value(operand, scope)))
        elif key == "$jsonSchema":
            from .schemas import valid

            parts.append(valid(operand, scope.root()))
        elif key == "$comment":
            continue
        elif key == "$where":
            parts.append(where(operand, scope))
        elif key == "$text":
            raise QueryError("$text stands at the top level of a find or first $match only")
        elif key.startswith("$"):
            raise UnsupportedOperator("query operator", key)
        else:
            field = Field(scope, key)
            if isinstance(operand, dict) and operand and all(k.startswith("$") for k in operand) and list(operand) not in (["$ref", "$id"], ["$ref", "$id", "$db"]):
                parts += [condition(field, op, v, scope, operand) for op, v in operand.items()]
            else:
                parts.append(condition(field, "$eq", operand, scope, {}))
    return all_of(parts)


# --- $where ----------------------------------------------------------------------------------------------------------


def where(operand: Any, scope: Scope) -> Column:
    """A Python predicate over the row (a row-at-a-time UDF, the only one here), or an expression over `this` that is
    translated to columns."""
    if callable(operand):
        root = scope.root()
        return F.coalesce(F.udf(lambda row: bool(operand(row.asDict(recursive=True))), "boolean")(root.col), F.lit(False))
    if not isinstance(operand, str):
        raise QueryError("$where takes an expression or a function")
    try:
        tree = ast.parse(operand.strip(), mode="eval").body
    except SyntaxError as wrong:
        raise QueryError(f"$where cannot read {operand!r}") from wrong
    return truthy(_python(tree, scope))


_ARITH = {ast.Add: "$add", ast.Sub: "$subtract", ast.Mult: "$multiply", ast.Div: "$divide", ast.Mod: "$mod", ast.Pow: "$pow"}
_COMPARE = {ast.Eq: "$eq", ast.NotEq: "$ne", ast.Gt: "$gt", ast.GtE: "$gte", ast.Lt: "$lt", ast.LtE: "$lte", ast.In: "$in"}


def _python(node: ast.AST, scope: Scope) -> E:
    from ..functions.core import operators

    def go(n: ast.AST) -> E:
        return _python(n, scope)

    if isinstance(node, ast.Constant):
        return literal(node.value)
    if isinstance(node, ast.List | ast.Tuple):
        return value([go(x) for x in node.elts], scope)
    if isinstance(node, ast.Name) and node.id in ("this", "doc"):
        return scope.root()
    if isinstance(node, ast.Attribute):
        return step(go(node.value), node.attr)
    if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant):
        return step(go(node.value), str(node.slice.value))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):
        return step(go(node.func.value), str(node.args[0].value))
    if isinstance(node, ast.BoolOp):
        parts = [truthy(go(v)) for v in node.values]
        return E(all_of(parts) if isinstance(node.op, ast.And) else any_of(parts), T.BooleanType())
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return E(~truthy(go(node.operand)), T.BooleanType())
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return operators["$multiply"]([go(node.operand), -1], scope)
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITH:
        return operators[_ARITH[type(node.op)]]([go(node.left), go(node.right)], scope)
    if isinstance(node, ast.Compare):
        sides = [go(x) for x in (node.left, *node.comparators)]
        parts = []
        for op, a, b in zip(node.ops, sides, sides[1:], strict=False):
            if type(op) not in _COMPARE:
                raise QueryError("$where does not know this comparison")
            parts.append(truthy(operators[_COMPARE[type(op)]]([a, b], scope)))
        return E(all_of(parts), T.BooleanType())
    raise QueryError(f"$where does not know {type(node).__name__}")
