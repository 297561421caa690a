"""Update documents and pipelines, lowered to one projection over the matched rows.

Every path becomes a rebuilt column: `when(matched, new).otherwise(old)`, so an update is a map over the table and its
filter needs no second pass. Positional segments (`$`, `$[]`, `$[name]` with arrayFilters) rebuild arrays member by
member.
"""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator
from ..functions.arrays import comparator, sort_keys
from ..functions.core import DATE, LONG, REMOVE, E, Scope, array_of, cast, common_type, equal, is_array, is_null, is_number, less, literal, number, struct_of, wide
from .filters import compile_filter, field_condition
from .shapes import concrete, fields_of

OPERATORS = ("$set", "$unset", "$inc", "$min", "$max", "$mul", "$bit", "$rename", "$currentDate", "$setOnInsert", "$push", "$addToSet", "$pull", "$pullAll", "$pop")


def conflicts(paths: list[str]) -> None:
    for i, a in enumerate(sorted(paths)):
        for b in sorted(paths)[i + 1 :]:
            if b == a or b.startswith(a + "."):
                raise QueryError(f"updating {b} would conflict with {a}")


class Update:
    """A compiled update: columns by name for the rows it applies to."""

    def __init__(self, spec: dict, scope: Scope, query: dict | None = None, array_filters: list[dict] | None = None, now: datetime.datetime | None = None):
        if not spec or not all(k.startswith("$") for k in spec):
            raise QueryError("an update consists of update operators")
        self.scope, self.query = scope, query or {}
        self.filters = {}
        for f in array_filters or []:
            name = next(iter(f)).split(".")[0]
            self.filters[name] = f
        self.now = now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        self.out: dict[str, E | Any] = {}
        paths = []
        for op, body in spec.items():
            if op not in OPERATORS:
                raise UnsupportedOperator("update operator", op)
            if not isinstance(body, dict):
                raise QueryError(f"{op} takes an object")
            paths += [p for p in body] + ([str(v) for v in body.values()] if op == "$rename" else [])
        conflicts(paths)
        if any(p == "_id" or p.startswith("_id.") for op, body in spec.items() if op != "$setOnInsert" for p in body):
            raise QueryError("_id cannot be changed")
        for op, body in spec.items():
            if op == "$setOnInsert":
                continue
            for path, arg in body.items():
                if op == "$rename":
                    self._rename(path, arg)
                else:
                    self._at(path, lambda own, op=op, arg=arg: _APPLY[op](own, arg, self))

    def field(self, name: str) -> E | None:
        got = self.out.get(name, self.scope.fields.get(name))
        return None if got is REMOVE else got

    def _at(self, path: str, change: Any) -> None:
        head, *rest = path.split(".")
        self.out[head] = self._walk(self.field(head), rest, change, head)

    def _walk(self, own: E | None, rest: list[str], change: Any, at: str) -> Any:
        """The value of a field after `change` is applied at the end of the rest of the path."""
        if not rest:
            return change(own)
        name, *more = rest
        if name.startswith("$"):
            if own is None or not is_array(own.type):
                raise QueryError(f"{at} is no array")
            kind = own.type.elementType
            test = self._chooses(name, at)
            # the result's type is that of the changed member
            probe = self._walk(E(F.lit(None).cast(kind), kind), more, change, at)
            to = common_type([kind, probe.type])
            if name == "$":
                first = F.array_min(F.transform(own.col, lambda x, k: F.when(test(E(x, kind)), k)))
                return E(F.transform(own.col, lambda x, k: F.when(k == first, cast(self._walk(E(x, kind), more, change, at), to)).otherwise(cast(E(x, kind), to))), T.ArrayType(to))
            return E(F.transform(own.col, lambda x: F.when(test(E(x, kind)), cast(self._walk(E(x, kind), more, change, at), to)).otherwise(cast(E(x, kind), to))), T.ArrayType(to))
        if own is not None and is_array(own.type) and name.isdigit():
            kind, place = own.type.elementType, int(name)
            new = self._walk(E(F.get(own.col, F.lit(place)), kind), more, change, at)
            if new is REMOVE:
                new = E(F.lit(None).cast(kind), kind)
            to = common_type([kind, new.type])
            padded = F.concat(own.col.cast(T.ArrayType(to)), F.array_repeat(F.lit(None).cast(to), F.greatest(F.lit(place + 1) - F.size(own.col), F.lit(0))))
            return E(F.transform(padded, lambda x, k: F.when(k == place, cast(new, to)).otherwise(x)), T.ArrayType(to))
        fields = fields_of(own) if own is not None and isinstance(own.type, T.StructType) else {}
        new = self._walk(fields.get(name), more, change, f"{at}.{name}")
        if new is REMOVE:
            fields.pop(name, None)
        elif new is not None:
            fields[name] = new
        return struct_of(fields) if fields else REMOVE

    def _chooses(self, name: str, at: str) -> Any:
        if name == "$[]":
            return lambda x: F.lit(True)
        if name == "$":
            conditions = [(p, c) for p, c in self.query.items() if p == at or p.startswith(at + ".")]
            if not conditions:
                raise QueryError(f"the positional operator needs a condition on {at}")

            def test(x: E) -> Column:
                out = F.lit(True)
                for p, c in conditions:
                    sub = p[len(at) + 1 :]
                    if sub and isinstance(x.type, T.StructType):
                        out = out & compile_filter({sub: c}, Scope(fields_of(x)))
                    else:
                        c = c["$elemMatch"] if isinstance(c, dict) and list(c) == ["$elemMatch"] else c
                        if isinstance(c, dict) and c and not all(k.startswith("$") for k in c):
                            out = out & compile_filter(c, Scope(fields_of(x)))
                        else:
                            for op, v in (c.items() if isinstance(c, dict) and c else [("$eq", c)]):
                                out = out & F.coalesce(field_condition(x, op, v, self.scope, c if isinstance(c, dict) else {}), F.lit(False))
                return F.coalesce(out, F.lit(False))

            return test
        label = name[2:-1]
        if label not in self.filters:
            raise QueryError(f"no array filter for {name}")
        spec = self.filters[label]
        return lambda x: compile_filter(spec, Scope({label: x}))

    def _rename(self, path: str, to: str) -> None:
        if "$" in path or "$" in to:
            raise QueryError("$rename takes no positional paths")
        held: dict[str, E | None] = {}

        def take(own: E | None) -> Any:
            held["e"] = own
            return REMOVE

        self._at(path, take)
        if held.get("e") is not None:
            self._at(to, lambda _: held["e"])


def _value(arg: Any) -> E:
    return concrete(literal(arg))


def _set(own: E | None, arg: Any, u: Update) -> E:
    return _value(arg)


def _unset(own: E | None, arg: Any, u: Update) -> Any:
    return REMOVE


def _inc(own: E | None, arg: Any, u: Update) -> E:
    by = number(literal(arg), "$inc")
    if own is None or is_null(own.type):
        return by
    base = number(own, "$inc")
    kind = common_type([base.type, by.type])
    return E(F.coalesce(cast(base, kind), F.lit(0).cast(kind)) + cast(by, kind), kind)


def _mul(own: E | None, arg: Any, u: Update) -> E:
    by = number(literal(arg), "$mul")
    if own is None or is_null(own.type):
        return E(F.lit(0).cast(by.type), by.type)
    base = number(own, "$mul")
    kind = common_type([base.type, by.type])
    return E(F.coalesce(cast(base, kind), F.lit(0).cast(kind)) * cast(by, kind), kind)


def _bound(smaller: bool) -> Any:
    def apply(own: E | None, arg: Any, u: Update) -> E:
        new = _value(arg)
        if own is None or is_null(own.type):
            return new
        base = wide(own)
        kind = common_type([base.type, new.type])
        a, b = E(cast(base, kind), kind), E(cast(new, kind), kind)
        return E(F.when(a.col.isNull() | (less(b, a) if smaller else less(a, b)), b.col).otherwise(a.col), kind)

    return apply


def _bit(own: E | None, arg: Any, u: Update) -> E:
    if not isinstance(arg, dict) or not arg or set(arg) - {"and", "or", "xor"}:
        raise QueryError("$bit takes and, or or xor")
    now = F.coalesce(number(own, "$bit").col.cast(LONG), F.lit(0).cast(LONG)) if own is not None else F.lit(0).cast(LONG)
    for op, v in arg.items():
        now = {"and": now.bitwiseAND, "or": now.bitwiseOR, "xor": now.bitwiseXOR}[op](F.lit(v).cast(LONG))
    return E(now, LONG)


def _current_date(own: E | None, arg: Any, u: Update) -> E:
    if arg is not True and arg not in ({"$type": "date"}, {"$type": "timestamp"}):
        raise QueryError("$currentDate takes true or a $type")
    if arg == {"$type": "timestamp"}:
        at = int(u.now.replace(tzinfo=datetime.UTC).timestamp())
        return struct_of({"t": E(F.lit(at).cast(LONG), LONG), "i": E(F.lit(1).cast(LONG), LONG)})
    return E(literal(u.now).col, DATE)


def _items(arg: Any) -> tuple[list, dict]:
    if isinstance(arg, dict) and "$each" in arg:
        if set(arg) - {"$each", "$position", "$slice", "$sort"} or not isinstance(arg["$each"], list):
            raise QueryError("$each takes a list, with $position, $slice and $sort")
        return arg["$each"], arg
    return [arg], {}


def _base(own: E | None, new: E) -> tuple[Column, T.DataType]:
    if own is not None and not is_null(own.type) and not is_array(own.type):
        raise QueryError("the field is no array")
    kind = common_type([own.type.elementType if own is not None and is_array(own.type) else T.NullType(), new.type.elementType])
    empty = F.array().cast(T.ArrayType(kind))
    return (F.coalesce(cast(own, T.ArrayType(kind)), empty) if own is not None and is_array(own.type) else empty), kind


def _push(own: E | None, arg: Any, u: Update) -> E:
    items, how = _items(arg)
    new = array_of([_value(x) for x in items]) if items else E(F.array().cast("array<string>"), T.ArrayType(T.NullType()))
    base, kind = _base(own, new)
    to = T.ArrayType(kind)
    add = cast(new, to) if items else F.array().cast(to)
    place = how.get("$position")
    if place is None:
        made = F.concat(base, add)
    else:
        at = F.least(F.lit(place), F.size(base)) if place >= 0 else F.greatest(F.size(base) + place, F.lit(0))
        made = F.concat(F.slice(base, F.lit(1), at), add, F.slice(base, at + 1, F.size(base)))
    if "$sort" in how:
        keys = sort_keys(how["$sort"], "$sort")
        made = F.sort_array(made, keys[0][1] == 1) if keys[0][0] == "" else F.array_sort(made, comparator(keys, kind))
    if "$slice" in how:
        n = how["$slice"]
        made = F.slice(made, F.lit(1), F.lit(n)) if n >= 0 else F.slice(made, F.greatest(F.size(made) + n, F.lit(0)) + 1, F.lit(-n))
    return E(made, to)


def _add_to_set(own: E | None, arg: Any, u: Update) -> E:
    items, how = _items(arg)
    if set(how) - {"$each"}:
        raise QueryError("$addToSet takes $each only")
    new = array_of([_value(x) for x in items])
    base, kind = _base(own, new)
    to = T.ArrayType(kind)
    return E(F.concat(base, F.array_except(F.array_distinct(cast(new, to)), base)), to)


def _pull(own: E | None, arg: Any, u: Update) -> Any:
    if own is None or is_null(own.type):
        return own
    if not is_array(own.type):
        raise QueryError("$pull needs an array")
    kind = own.type.elementType

    def hit(x: E) -> Column:
        if isinstance(arg, dict) and arg and all(k.startswith("$") for k in arg):
            out = F.lit(True)
            for op, v in arg.items():
                out = out & F.coalesce(field_condition(x, op, v, u.scope, arg), F.lit(False))
            return out
        if isinstance(arg, dict) and isinstance(kind, T.StructType):
            return F.coalesce(compile_filter(arg, Scope(fields_of(x))), F.lit(False))
        return F.coalesce(field_condition(x, "$eq", arg, u.scope), F.lit(False))

    return E(F.filter(own.col, lambda x: ~hit(E(x, kind))), own.type)


def _pull_all(own: E | None, arg: Any, u: Update) -> Any:
    if not isinstance(arg, list):
        raise QueryError("$pullAll takes a list")
    if own is None or is_null(own.type):
        return own
    kind = own.type.elementType

    def hit(x: E) -> Column:
        out = F.lit(False)
        for v in arg:
            out = out | equal(x, literal(v))
        return out

    return E(F.filter(own.col, lambda x: ~hit(E(x, kind))), own.type)


def _pop(own: E | None, arg: Any, u: Update) -> Any:
    if arg not in (1, -1):
        raise QueryError("$pop takes 1 or -1")
    if own is None or is_null(own.type):
        return own
    n = F.greatest(F.size(own.col) - 1, F.lit(0))
    return E(F.slice(own.col, F.lit(1 if arg == 1 else 2), n), own.type)


_APPLY = {
    "$set": _set, "$unset": _unset, "$inc": _inc, "$mul": _mul, "$min": _bound(True), "$max": _bound(False), "$bit": _bit,
    "$currentDate": _current_date, "$push": _push, "$addToSet": _add_to_set, "$pull": _pull, "$pullAll": _pull_all, "$pop": _pop,
}


def apply(df, condition: Column, spec: dict, query: dict | None = None, array_filters: list[dict] | None = None, now: datetime.datetime | None = None):
    """df with the update applied where the condition holds; fields that it creates are null elsewhere."""
    scope = Scope.of(df.schema)
    made = Update(spec, scope, query, array_filters, now)
    out: list[Column] = []
    marked = df.withColumn("__sd_hit", condition)
    for f in df.schema.fields:
        own = scope.fields[f.name]
        if f.name not in made.out:
            out.append(own.col)
            continue
        new = made.out[f.name]
        new = E(F.lit(None).cast(own.type), own.type) if new is REMOVE or new is None else new
        kind = _merged(own.type, new.type)
        out.append(F.when(F.col("__sd_hit"), cast(new, kind)).otherwise(cast(own, kind)).alias(f.name))
    for name, new in made.out.items():
        if name not in scope.fields and new is not REMOVE and new is not None:
            out.append(F.when(F.col("__sd_hit"), concrete(new).col).alias(name))
    return marked.select(*out)


def _merged(own: T.DataType, new: T.DataType) -> T.DataType:
    """The old type where it holds the new values too, so that updates don't change a table's schema needlessly."""
    if own == new or is_null(new):
        return own
    if is_number(own) and is_number(new):
        return own if isinstance(own, T.IntegralType) and isinstance(new, T.IntegralType) else common_type([own, new])
    return common_type([own, new])
