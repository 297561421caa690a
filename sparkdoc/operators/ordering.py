"""Document order: sort keys and the aggregates that observe it.

Rows carry no order in Spark. Where a pipeline observes one, an ordinal is taken at the scan and sort keys travel in
hidden columns; ordered aggregates put them into a struct that sorts ascending (descending numbers, dates and booleans
are inverted) and use min_by and max_by, which combine map-side; only what returns a list collects one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import E, is_array, is_date, is_float, is_null, is_number, less, quote

ORDINAL = "__sd_ord"


@dataclass(frozen=True)
class Key:
    """A hidden or visible column and its direction."""

    name: str
    type: T.DataType
    ascending: bool = True

    @property
    def e(self) -> E:
        return E(F.col(quote(self.name)), self.type)


def sortable(e: E, ascending: bool) -> E:
    """What a document is sorted by: an array's least (or greatest) member, other values as they are."""
    if is_array(e.type) and not is_array(e.type.elementType):
        return E(F.array_min(e.col) if ascending else F.array_max(e.col), e.type.elementType)
    return e


def order_by(key: Key) -> list[Column]:
    """Spark sort columns: null least, NaN the smallest number."""
    col = key.e.col
    parts = [F.when(col.isNotNull(), ~F.isnan(col)), col] if is_float(key.type) else [col]
    return [(p.asc_nulls_first() if key.ascending else p.desc_nulls_last()) for p in parts]


def invertible(t: T.DataType) -> bool:
    return is_number(t) or is_date(t) or isinstance(t, T.BooleanType) or is_null(t)


def _ascending(key: Key) -> list[Column] | None:
    """Columns that sort ascending (null first) as the key does, if there are such."""
    col = key.e.col
    if key.ascending:
        return [F.when(col.isNotNull(), ~F.isnan(col)), col] if is_float(key.type) else [col]
    if not invertible(key.type):
        return None
    if isinstance(key.type, T.BooleanType):
        return [col.isNull(), ~col]
    if is_date(key.type):
        return [col.isNull(), -F.unix_micros(col.cast("timestamp"))]
    return [col.isNull(), *([F.isnan(col)] if is_float(key.type) else []), -col]


class Order:
    """An order of the rows of a group."""

    def __init__(self, keys: list[Key]):
        self.keys = keys
        parts: list[Column] | None = []
        for k in keys:
            made = _ascending(k)
            parts = None if parts is None or made is None else parts + made
        self.key = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]) if parts else None

    def reversed(self, upto: int) -> Order:
        """The first `upto` keys the other way round, the rest as they are."""
        return Order([Key(k.name, k.type, not k.ascending) if i < upto else k for i, k in enumerate(self.keys)])

    def first(self, v: Column, over=None) -> Column:
        if self.key is None:
            return F.get(self.list(v, over), F.lit(0)) if self.keys else self._over(F.first(v), over)
        return self._over(F.min_by(F.struct(v.alias("v")), self.key), over)["v"]

    def last(self, v: Column, over=None) -> Column:
        if self.key is None:
            return F.get(F.reverse(self.list(v, over)), F.lit(0)) if self.keys else self._over(F.last(v), over)
        return self._over(F.max_by(F.struct(v.alias("v")), self.key), over)["v"]

    def list(self, v: Column, over=None, where: Column | None = None) -> Column:
        """All values in order, nulls kept; `where`: only rows that pass."""
        if not self.keys:
            kept = F.struct(v.alias("v")) if where is None else F.when(where, F.struct(v.alias("v")))
            return F.transform(self._over(F.collect_list(kept), over), lambda x: x["v"])
        if self.key is not None:
            row = F.struct(self.key.alias("k"), v.alias("v"))
            items = F.array_sort(self._over(F.collect_list(row if where is None else F.when(where, row)), over), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        else:
            row = F.struct(*[k.e.col.alias(f"k{i}") for i, k in enumerate(self.keys)], v.alias("v"))
            items = F.array_sort(self._over(F.collect_list(row if where is None else F.when(where, row)), over), self._compare)
        return F.transform(items, lambda x: x["v"])

    def _compare(self, a: Column, b: Column) -> Column:
        chain = F
        for i, k in enumerate(self.keys):
            x, y = E(a[f"k{i}"], k.type), E(b[f"k{i}"], k.type)
            sign = 1 if k.ascending else -1
            chain = chain.when(less(x, y), F.lit(-sign)).when(less(y, x), F.lit(sign))
        return chain.otherwise(F.lit(0))

    @staticmethod
    def _over(c: Column, over) -> Column:
        return c if over is None else c.over(over)
