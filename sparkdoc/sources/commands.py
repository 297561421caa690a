"""`database.command`: commands onto the same compilers."""

from __future__ import annotations

import itertools
import platform
from typing import Any

from pyspark.sql import functions as F

from ..errors import QueryError, UnsupportedOperator

_STATIC = ("ping", "hello", "isMaster", "ismaster", "buildInfo", "connectionStatus", "hostInfo", "serverStatus", "whatsmyuri", "getCmdLineOpts", "listCommands", "currentOp")


#: Documents of a first batch, unless a command names another number.
BATCH = 101


def _rows(df: Any) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def command(db: Any, spec: dict) -> dict:
    """The reply to a command document; its first key names the command. Results come in batches: a first one and, with the cursor's
    id, more by `getMore`."""
    name, target = next(iter(spec.items()))
    handler = globals().get(f"_do_{name}")
    if handler is not None:
        return handler(db, target, spec) | {"ok": 1.0}
    if name in _STATIC:
        return _static(db, name) | {"ok": 1.0}
    raise UnsupportedOperator("command", name)


def _static(db: Any, name: str) -> dict:
    sc = db.spark.sparkContext
    if name in ("hello", "isMaster", "ismaster"):
        return {"isWritablePrimary": True, "ismaster": True}
    if name == "buildInfo":
        return {"version": db.spark.version}
    if name == "hostInfo":
        return {"system": {"hostname": platform.node(), "numCores": sc.defaultParallelism}}
    if name == "serverStatus":
        return {"host": platform.node(), "process": sc.appName}
    if name == "connectionStatus":
        return {"authInfo": {"authenticatedUsers": [{"user": sc.sparkUser()}]}}
    if name == "whatsmyuri":
        return {"you": sc.uiWebUrl or sc.master}
    if name == "getCmdLineOpts":
        return {"parsed": dict(sc.getConf().getAll())}
    if name == "currentOp":
        return {"inprog": [{"opid": j} for j in sc.statusTracker().getActiveJobsIds()]}
    if name == "listCommands":
        helps = {k[4:]: (v.__doc__ or "") for k, v in globals().items() if k.startswith("_do_")}
        return {"commands": {c: {"help": helps.get(c, "")} for c in sorted({*_STATIC, *helps})}}
    return {}


def _cursor(db: Any, name: str, df: Any, spec: dict) -> dict:
    """The first batch and the number of a cursor for the rest (0: there is none). Rows come partition by partition."""
    size = spec.get("batchSize", (spec.get("cursor") or {}).get("batchSize", BATCH))
    if not isinstance(size, int) or isinstance(size, bool) or size < 0:
        raise QueryError("batchSize is a whole number of at least 0")
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))
    first = list(itertools.islice(rows, size))
    number = _keep(db, next(_numbers), rows)
    return {"cursor": {"id": number, "ns": f"{db.name}.{name}", "firstBatch": first}}


_numbers = itertools.count(1)


def _keep(db: Any, number: int, rows: Any) -> int:
    """The cursor's number, if rows are left."""
    ahead = list(itertools.islice(rows, 1))
    if not ahead:
        db.cursors.pop(number, None)
        return 0
    db.cursors[number] = itertools.chain(ahead, rows)
    return number


def _do_getMore(db: Any, number: int, spec: dict) -> dict:  # noqa: N802
    """The next batch of a cursor."""
    if number not in db.cursors:
        raise QueryError(f"cursor {number} is not open")
    rows = db.cursors[number]
    batch = list(itertools.islice(rows, spec.get("batchSize", BATCH)))
    return {"cursor": {"id": _keep(db, number, rows), "ns": f"{db.name}.{spec.get('collection', '')}", "nextBatch": batch}}


def _do_killCursors(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    """Forget cursors."""
    open_, gone = [n for n in spec["cursors"] if n in db.cursors], [n for n in spec["cursors"] if n not in db.cursors]
    for n in open_:
        del db.cursors[n]
    return {"cursorsKilled": open_, "cursorsNotFound": gone}


def _do_killOp(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    """Cancel one job, named by the opid that currentOp shows."""
    op = spec.get("op")
    if not isinstance(op, int) or isinstance(op, bool):
        raise QueryError("killOp takes op, the number of an operation")
    if op not in db.spark.sparkContext.statusTracker().getActiveJobsIds():
        return {"info": "no such operation"}
    db.spark.sparkContext._jsc.sc().cancelJob(op)
    return {"info": "attempting to kill op"}


def _do_find(db: Any, name: str, spec: dict) -> dict:
    return _cursor(db, name, db[name].find(spec.get("filter"), spec.get("projection"), spec.get("sort"), spec.get("skip", 0), spec.get("limit", 0), spec.get("let"), spec.get("collation"), spec.get("hint")), spec)


def _do_aggregate(db: Any, name: Any, spec: dict) -> dict:
    return _cursor(db, str(name), db.aggregate(spec["pipeline"]) if name == 1 else db[name].aggregate(spec["pipeline"], spec.get("let")), spec)


def _do_count(db: Any, name: str, spec: dict) -> dict:
    return {"n": db[name].count_documents(spec.get("query", {}), spec.get("skip", 0), spec.get("limit", 0))}


def _do_distinct(db: Any, name: str, spec: dict) -> dict:
    return {"values": [r["value"] for r in db[name].distinct(spec["key"], spec.get("query")).collect()]}


def _do_insert(db: Any, name: str, spec: dict) -> dict:
    return {"n": db[name].insert_many(spec["documents"]).inserted}


def _do_update(db: Any, name: str, spec: dict) -> dict:
    n = changed = 0
    for u in spec["updates"]:
        how = db[name].update_many if u.get("multi") else db[name].update_one
        r = how(u["q"], u["u"], u.get("upsert", False), u.get("arrayFilters"))
        n, changed = n + r.matched + (r.upserted_id is not None), changed + r.modified
    return {"n": n, "nModified": changed}


def _do_delete(db: Any, name: str, spec: dict) -> dict:
    return {"n": sum((db[name].delete_one if d.get("limit") == 1 else db[name].delete_many)(d["q"]).deleted for d in spec["deletes"])}


def _do_findAndModify(db: Any, name: str, spec: dict) -> dict:  # noqa: N802 - the command's name
    c, query, sort = db[name], spec.get("query", {}), spec.get("sort")
    if spec.get("remove"):
        return {"value": c.find_one_and_delete(query, sort)}
    return {"value": c.find_one_and_update(query, spec["update"], sort, spec.get("new", False), spec.get("upsert", False))}


def _do_create(db: Any, name: str, spec: dict) -> dict:
    db.create_collection(name, spec.get("validator"), spec.get("validationLevel", "strict"), spec.get("validationAction", "error"))
    return {}


def _do_drop(db: Any, name: str, spec: dict) -> dict:
    db.drop_collection(name)
    return {"ns": f"{db.name}.{name}"}


def _do_dropDatabase(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    for name in db.list_collection_names():
        db.drop_collection(name)
    return {"dropped": db.name}


def _do_renameCollection(db: Any, name: str, spec: dict) -> dict:  # noqa: N802
    db.rename_collection(name.split(".")[-1], spec["to"].split(".")[-1])
    return {}


def _do_createIndexes(db: Any, name: str, spec: dict) -> dict:  # noqa: N802
    for index in spec["indexes"]:
        db[name].create_index(index["key"], index.get("name"), **{k: v for k, v in index.items() if k not in ("key", "name")})
    return {"numIndexesAfter": len(db[name].indexes) + 1}


def _do_dropIndexes(db: Any, name: str, spec: dict) -> dict:  # noqa: N802
    for index in list(db[name].indexes) if spec["index"] == "*" else [spec["index"]]:
        db[name].drop_index(index)
    return {}


def _do_listIndexes(db: Any, name: str, spec: dict) -> dict:  # noqa: N802
    return {"cursor": {"id": 0, "ns": f"{db.name}.{name}", "firstBatch": db[name].list_indexes()}}


def _do_listCollections(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    return {"cursor": {"id": 0, "ns": db.name, "firstBatch": [{"name": n, "type": "collection"} for n in db.list_collection_names()]}}


def _do_listDatabases(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    return {"databases": [{"name": db.name}]}


def _do_collStats(db: Any, name: str, spec: dict) -> dict:  # noqa: N802
    return _rows(db[name].aggregate([{"$collStats": {"count": {}, "storageStats": {}}}]))[0]


def _do_dbStats(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    return {"db": db.name, "collections": len(db.tables), "objects": sum(db[n].estimated_document_count() for n in db.tables)}


def _do_dbHash(db: Any, _: Any, spec: dict) -> dict:  # noqa: N802
    hashes = {}
    for n in db.list_collection_names():
        df = db.read(n)
        hashes[n] = format(df.agg(F.bit_xor(F.xxhash64(F.to_json(F.struct(*df.columns))))).first()[0] or 0, "x")
    return {"collections": hashes}


def _do_validate(db: Any, name: str, spec: dict) -> dict:
    c = db[name]
    problems = []
    for index in c.indexes.values():
        if index.get("unique"):
            try:
                c._check_unique(c.df(), index)
            except QueryError as wrong:
                problems.append(str(wrong))
    return {"ns": f"{db.name}.{name}", "nrecords": c.estimated_document_count(), "valid": not problems, "errors": problems}


def _do_explain(db: Any, inner: dict, spec: dict) -> dict:
    name, target = next(iter(inner.items()))
    if name == "aggregate":
        return db[target].explain(pipeline=inner["pipeline"])
    if name == "find":
        return db[target].explain(filter=inner.get("filter"))
    raise QueryError(f"{name} cannot be explained")
