"""Projections of find: inclusion and exclusion as in `$project`, and `$slice`, `$elemMatch`, `f.$` and `$meta`."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.arrays import cut
from ..functions.core import E, Scope, hidden, is_array, quote, resolve, value
from .filters import _element, all_of, field_condition


def _positional(path: str, query: dict, scope: Scope) -> Any:
    """The first member that the filter's conditions on the path accept."""
    e = resolve(scope, path)
    if not is_array(e.type):
        raise QueryError(f"{path}.$ needs an array")
    tests = []
    for p, c in query.items():
        if p == path or p.startswith(path + "."):
            sub = p[len(path) + 1 :]
            tests.append((sub, c))
    if not tests:
        raise QueryError(f"{path}.$ needs a condition on {path}")

    def accepts(x: E) -> Any:
        parts = []
        for sub, c in tests:
            inner = _element({sub: c}, scope) if sub else None
            if inner is not None:
                parts.append(inner(E(F.array(x.col), e.type)))
            elif isinstance(c, dict) and list(c) == ["$elemMatch"]:
                parts.append(_element(c["$elemMatch"], scope)(E(F.array(x.col), e.type)))
            else:
                parts += [field_condition(x, op, v, scope, c if isinstance(c, dict) else {}) for op, v in (c.items() if isinstance(c, dict) and c and all(k.startswith("$") for k in c) else [("$eq", c)])]
        return F.coalesce(all_of(parts), F.lit(False))

    return E(F.slice(F.filter(e.col, lambda x: accepts(E(x, e.type.elementType))), 1, 1), e.type)


def _first_member(e: E, spec: Any, scope: Scope) -> E:
    accepts = _element(spec, scope)
    return E(F.slice(F.filter(e.col, lambda x: accepts(E(F.array(x), e.type))), 1, 1), e.type)


def project_find(flow: Any, projection: Any, query: dict) -> DataFrame:
    from ..plans.pipeline import project

    spec = dict.fromkeys(projection, 1) if isinstance(projection, list) else dict(projection)
    scope, special, plain = flow.scope, {}, {}
    for path, how in spec.items():
        if path.endswith(".$"):
            special[path[:-2]] = _positional(path[:-2], query, scope)
            plain[path[:-2]] = 1
        elif isinstance(how, dict) and list(how) == ["$slice"]:
            e = resolve(scope, path)
            n = how["$slice"]
            if not is_array(e.type):
                raise QueryError("$slice needs an array")
            special[path] = E(cut(e.col, F.lit(n[1]), F.lit(n[0])) if isinstance(n, list) else cut(e.col, F.lit(n)), e.type)
        elif isinstance(how, dict) and list(how) == ["$elemMatch"]:
            e = resolve(scope, path)
            special[path] = _first_member(e, how["$elemMatch"], scope)
            plain[path] = 1
        elif isinstance(how, dict) and list(how) == ["$meta"]:
            special[path] = value(how, scope)
        else:
            plain[path] = how
    if any("." in p for p in special):
        raise QueryError("these projections go by top-level fields")
    df = flow.df.withColumns({p: e.col for p, e in special.items()}) if special else flow.df
    done = flow.on(df)
    if any(v not in (0, False) for p, v in plain.items() if p != "_id"):
        plain |= dict.fromkeys((p for p in special if p not in plain), 1)
    return project(done, plain, False).df if plain else df


def visible(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(quote(c)) for c in df.columns if not hidden(c)])


