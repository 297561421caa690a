"""Planar geometry on points: native expressions; a shape given in a query is unrolled edge by edge.

A point column is [x, y] or {type, coordinates: [x, y]}. Distances are planar, for spherical operators too.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import E, is_array, is_number


def point(e: E) -> tuple[Column, Column] | None:
    """The coordinates of a point column, or None if the type cannot be one."""
    if isinstance(e.type, T.StructType) and "coordinates" in e.type.names:
        e = E(e.col.getField("coordinates"), e.type["coordinates"].dataType)
    elif isinstance(e.type, T.StructType) and len(e.type.fields) == 2 and all(is_number(f.dataType) for f in e.type.fields):
        return tuple(e.col.getField(f.name).cast("double") for f in e.type.fields)
    if is_array(e.type) and is_number(e.type.elementType):
        return F.get(e.col, F.lit(0)).cast("double"), F.get(e.col, F.lit(1)).cast("double")
    return None


def coordinates(spec: Any, op: str) -> tuple[float, float]:
    if isinstance(spec, dict) and "$geometry" in spec:
        spec = spec["$geometry"]
    if isinstance(spec, dict):
        if spec.get("type") != "Point":
            raise QueryError(f"{op} needs a point")
        spec = spec["coordinates"]
    if not isinstance(spec, list | tuple) or len(spec) < 2:
        raise QueryError(f"{op} needs a point")
    return float(spec[0]), float(spec[1])


def distance(e: E, at: tuple[float, float]) -> Column:
    found = point(e)
    if found is None:
        raise QueryError("distances need a column of points")
    return F.hypot(found[0] - at[0], found[1] - at[1])


def _on(x: Column, y: Column, a: list[float], b: list[float]) -> Column:
    (ax, ay), (bx, by) = a[:2], b[:2]
    cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
    return (cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))


def _inside_ring(x: Column, y: Column, ring: list[list[float]]) -> tuple[Column, Column]:
    """(odd number of crossings to the right, on an edge)."""
    odd, edge = F.lit(False), F.lit(False)
    for a, b in zip(ring, ring[1:], strict=False):
        (ax, ay), (bx, by) = (float(v) for v in a[:2]), (float(v) for v in b[:2])
        edge = edge | _on(x, y, [ax, ay], [bx, by])
        if ay != by:
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            odd = odd != (crosses & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax))
    return odd, edge


def covers(x: Column, y: Column, rings: list) -> Column:
    """Whether a polygon covers the point, its border included; later rings are holes."""
    shell, *holes = [_inside_ring(x, y, r) for r in rings]
    inside = shell[0] | shell[1]
    for odd, edge in holes:
        inside = inside & (~odd | edge)
    return inside


def meets(x: Column, y: Column, shape: dict) -> Column:
    """Whether a point lies in or on a shape."""
    kind, at = shape.get("type"), shape.get("coordinates")
    if kind == "Point":
        return (x == float(at[0])) & (y == float(at[1]))
    if kind == "MultiPoint":
        return _any([(x == float(p[0])) & (y == float(p[1])) for p in at])
    if kind == "LineString":
        return _any([_on(x, y, a, b) for a, b in zip(at, at[1:], strict=False)])
    if kind == "MultiLineString":
        return _any([_on(x, y, a, b) for line in at for a, b in zip(line, line[1:], strict=False)])
    if kind == "Polygon":
        return covers(x, y, at)
    if kind == "MultiPolygon":
        return _any([covers(x, y, rings) for rings in at])
    if kind == "GeometryCollection":
        return _any([meets(x, y, s) for s in shape["geometries"]])
    raise QueryError(f"unknown geometry {kind}")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def test(op: str, operand: Any, siblings: dict) -> Callable[[E], Column]:
    if op in ("$near", "$nearSphere"):
        inner = operand if isinstance(operand, dict) else {}
        least = inner.get("$minDistance", siblings.get("$minDistance"))
        most = inner.get("$maxDistance", siblings.get("$maxDistance"))
        at = coordinates(operand, op)

        def near(e: E) -> Column:
            if point(e) is None:
                return F.lit(False)
            d = distance(e, at)
            return d.isNotNull() & (d >= float(least) if least is not None else F.lit(True)) & (d <= float(most) if most is not None else F.lit(True))

        return near
    if not isinstance(operand, dict):
        raise QueryError(f"{op} takes an object")
    if "$box" in operand and op == "$geoWithin":
        (x0, y0), (x1, y1) = operand["$box"]
        (x0, x1), (y0, y1) = sorted((float(x0), float(x1))), sorted((float(y0), float(y1)))

        def boxed(e: E) -> Column:
            found = point(e)
            return F.lit(False) if found is None else found[0].between(x0, x1) & found[1].between(y0, y1)

        return boxed
    shape = operand.get("$geometry")
    if not isinstance(shape, dict) or (op == "$geoWithin" and shape.get("type") not in ("Polygon", "MultiPolygon")):
        raise QueryError(f"{op} takes $geometry" + (" with a Polygon or MultiPolygon, or $box" if op == "$geoWithin" else ""))

    def shaped(e: E) -> Column:
        found = point(e)
        return F.lit(False) if found is None else meets(*found, shape)

    return shaped
