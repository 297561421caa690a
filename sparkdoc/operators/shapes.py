"""Rebuilding documents: inclusion, exclusion and assignment of nested paths."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import REMOVE, E, is_array, is_null, struct_of

Leaf = Any
Make = Callable[[Leaf, "E | None"], Any]


def tree_of(paths: dict[str, Any]) -> dict:
    """{"a.b": x, "c": y} as {"a": {"b": x}, "c": y}; a path may not be the beginning of another."""
    out: dict = {}
    for path, leaf in paths.items():
        at, names = out, path.split(".")
        if not all(names):
            raise QueryError(f"bad path {path!r}")
        for name in names[:-1]:
            at = at.setdefault(name, Tree())
            if not isinstance(at, Tree):
                raise QueryError(f"{path} conflicts with another path")
        if names[-1] in at:
            raise QueryError(f"{path} conflicts with another path")
        at[names[-1]] = leaf
    return out


class Tree(dict):
    """An inner node, to tell it from an expression object."""


def fields_of(e: E) -> dict[str, E]:
    return {f.name: E(e.col.getField(f.name), f.dataType) for f in e.type.fields}


def _members(e: E, change: Callable[[E], E | None]) -> E | None:
    """Change every member of an array of objects."""
    kind = change(E(F.lit(None).cast(e.type.elementType), e.type.elementType))
    if kind is None:
        return None
    return E(F.transform(e.col, lambda x: change(E(x, e.type.elementType)).col), T.ArrayType(kind.type))


def include(e: E, tree: dict, make: Make) -> E | None:
    """Only what the tree names; make(leaf, own value or None) gives a leaf's column (None or REMOVE: left out)."""
    if is_array(e.type):
        return _members(e, lambda x: include(x, tree, make)) if isinstance(e.type.elementType, T.StructType | T.ArrayType) else None
    own = fields_of(e) if isinstance(e.type, T.StructType) else {}
    out: dict[str, E] = {}
    for name, leaf in tree.items():
        made = (include(own[name], leaf, make) if name in own else new(leaf, make)) if isinstance(leaf, Tree) else make(leaf, own.get(name))
        if made is not None and made is not REMOVE:
            out[name] = made
    if not out:
        return None
    order = [n for n in own if n in out] + [n for n in out if n not in own]
    made = struct_of({n: out[n] for n in order})
    return E(F.when(e.col.isNotNull(), made.col), made.type) if own else made


def new(tree: Tree, make: Make) -> E | None:
    out = {n: (new(leaf, make) if isinstance(leaf, Tree) else make(leaf, None)) for n, leaf in tree.items()}
    out = {n: x for n, x in out.items() if x is not None and x is not REMOVE}
    return struct_of(out) if out else None


def exclude(e: E, tree: dict) -> E | None:
    if is_array(e.type):
        return _members(e, lambda x: exclude(x, tree)) if isinstance(e.type.elementType, T.StructType | T.ArrayType) else e
    if not isinstance(e.type, T.StructType):
        return e
    out: dict[str, E] = {}
    for name, own in fields_of(e).items():
        if name not in tree:
            out[name] = own
        elif isinstance(tree[name], Tree) and (rest := exclude(own, tree[name])) is not None:
            out[name] = rest
    if not out:
        return None
    made = struct_of(out)
    return E(F.when(e.col.isNotNull(), made.col), made.type)


def assign(e: E | None, tree: Tree, make: Make, create: bool = True) -> E:
    """e with the tree's leaves set; parents are created, arrays of objects get them in every member."""
    if e is not None and is_array(e.type) and isinstance(e.type.elementType, T.StructType):
        return _members(e, lambda x: assign(x, tree, make))
    own = fields_of(e) if e is not None and isinstance(e.type, T.StructType) else {}
    out = dict(own)
    for name, leaf in tree.items():
        made = assign(own.get(name), leaf, make) if isinstance(leaf, Tree) else make(leaf, own.get(name))
        if made is REMOVE:
            out.pop(name, None)
        elif made is not None:
            out[name] = made
    if not out:
        return E(F.lit(None), T.NullType())
    return struct_of(out)


def concrete(e: E) -> E:
    """A column of unknown type as a string column (tables have no void columns)."""
    return E(e.col.cast("string"), T.StringType()) if is_null(e.type) else e
