"""Collections: the document API over tables.

A database is a folder of Parquet tables (or a set of DataFrames given by name). Every version of a collection is an
immutable DataFrame; a write makes the next version, checks what has to hold (unique keys, validators) with aggregates,
writes it to a new folder and switches to it. There is one writer. Reads are lazy DataFrames.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import E, Scope, cast, common_type, equal, hidden, is_array, is_date, literal, quote, resolve
from ..operators import search as searches
from ..operators import updates
from ..operators.filters import compile_filter
from ..operators.projections import project_find
from ..operators.schemas import valid
from ..operators.shapes import concrete
from ..plans.pipeline import Context, Flow, execute, limit, match, run, single, skip, sort


class WriteError(QueryError):
    """A write that would break a unique index or a validator."""


class BulkWriteError(WriteError):
    """Requests of an unordered bulk write that failed: `errors` (place, message), and what the others did: `result`."""

    def __init__(self, errors: list[tuple[int, str]], result: Result):
        super().__init__("; ".join(f"request {k}: {message}" for k, message in errors))
        self.errors, self.result = errors, result


#: Hidden columns of a staged version: whether a write took the row, and whether it changed it; what an event calls it; the
#: document before; whether the validator took the document before.
WRITTEN, CHANGED, EVENT, BEFORE, WAS_VALID = "__sd_written", "__sd_changed", "__sd_event", "__sd_before", "__sd_was_valid"
#: Tables that an insert may put side by side before they are written as one.
MOST_PARTS = 32


@dataclass
class Options:
    validator: dict | None = None
    level: str = "strict"
    action: str = "error"


@dataclass
class Result:
    """Counts of a write."""

    inserted: int = 0
    matched: int = 0
    modified: int = 0
    deleted: int = 0
    upserted_id: Any = None


class Database:
    """Named collections. `folder`: where versions are written (a shared one on a cluster); without it tables that are
    written stay lazy DataFrames of this session."""

    def __init__(self, spark: SparkSession, folder: str | None = None, name: str = "db"):
        self.spark, self.folder, self.name = spark, folder, name
        self.tables: dict[str, DataFrame] = {}
        self.collections: dict[str, Collection] = {}
        self.listeners: list[Callable[[str, str, DataFrame | None], None]] = []
        self.parts: dict[str, int] = {}
        self.cursors: dict[int, Iterator[dict]] = {}

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            self.collections[name] = Collection(self, name)
        return self.collections[name]

    get_collection = __getitem__

    def register(self, name: str, df: DataFrame) -> Collection:
        self.tables[name] = df
        return self[name]

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise QueryError(f"no collection {name}")
        return self[name].visible(self.tables[name])

    def create_collection(self, name: str, validator: dict | None = None, validationLevel: str = "strict", validationAction: str = "error") -> Collection:  # noqa: N803 - the API's names
        made = self[name]
        made.options = Options(validator, validationLevel, validationAction)
        return made

    def list_collection_names(self) -> list[str]:
        return sorted(self.tables)

    def drop_collection(self, name: str) -> None:
        there = name in self.tables
        self.tables.pop(name, None)
        self.collections.pop(name, None)
        if there:
            self.announce(name, "drop")
            self.announce(name, "invalidate")

    def announce(self, name: str, event: str, rows: DataFrame | None = None) -> None:
        for listener in self.listeners:
            listener(name, event, rows)

    def rename_collection(self, old: str, new: str) -> None:
        if new in self.tables:
            raise QueryError(f"{new} exists")
        self.announce(old, "rename")
        self.announce(old, "invalidate")
        self.tables[new] = self.tables.pop(old)
        self.collections[new] = self.collections.pop(old, Collection(self, new))
        self.collections[new].name = new

    def command(self, spec: dict | str, **more: Any) -> dict:
        from .commands import command

        return command(self, ({spec: 1} | more) if isinstance(spec, str) else spec)

    def aggregate(self, pipeline: list) -> DataFrame:
        """For pipelines that start with a source of their own."""
        return run(pipeline, self.spark.range(0).select(F.lit(None).cast("string").alias("_id")), Context(self.spark, self.read))

    def stage(self, name: str, df: DataFrame) -> tuple[DataFrame, str | None]:
        """df written to a folder of its own and read back (computed once), and the folder; without folders df as it is."""
        if not self.folder:
            return df, None
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def discard(self, path: str | None) -> None:
        """A staged version that did not become one."""
        if path is not None:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class Collection:
    database: Database
    name: str
    options: Options = field(default_factory=Options)
    indexes: dict[str, dict] = field(default_factory=dict)
    search_indexes: dict[str, dict] = field(default_factory=dict)

    # --- reading -----------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.database.spark

    def visible(self, df: DataFrame) -> DataFrame:
        """Without documents whose time to live is over."""
        for index in self.indexes.values():
            if "expireAfterSeconds" in index:
                e = resolve(Scope.of(df.schema), next(iter(index["key"])))
                e = E(F.array_min(e.col), e.type.elementType) if is_array(e.type) else e
                if is_date(e.type):
                    over = F.unix_micros(e.col.cast("timestamp")) / 1e6 + float(index["expireAfterSeconds"]) <= F.unix_micros(F.current_timestamp()) / 1e6
                    df = df.where(~F.coalesce(over, F.lit(False)))
        return df

    def df(self) -> DataFrame:
        return self.database.read(self.name)

    def context(self, let: dict | None = None) -> Context:
        text = next((i for i in self.indexes.values() if "text" in i["key"].values()), None)
        variables = {n: literal(v) for n, v in (let or {}).items()}
        paths = tuple(p for p, d in (text or {"key": {}})["key"].items() if d == "text")
        return Context(self.spark, self.database.read, variables, metadata=self._metadata, search=self._search, text_paths=paths, text_weights=dict((text or {}).get("weights") or {}))

    def _search(self, stage: str, spec: Any, df: DataFrame) -> DataFrame:
        if not isinstance(spec, dict):
            raise QueryError(f"{stage} takes an object")
        definition = self.search_indexes.get(spec.get("index", "default"))
        if definition is None and "index" in spec:
            raise QueryError(f"no search index {spec['index']}")
        return {"$search": searches.search, "$searchMeta": searches.search_meta, "$vectorSearch": searches.vector_search}[stage](df, spec, definition)

    def _metadata(self, stage: str, spec: Any) -> DataFrame:
        if stage == "$collStats":
            scale = ((spec or {}).get("storageStats") or {}).get("scale", 1)
            df = self.df()
            size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]))))
            counted = df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(size, F.lit(0)).alias("size"))
            return counted.select(F.lit(f"{self.database.name}.{self.name}").alias("ns"), *([F.col("count")] if "count" in (spec or {}) else []), *([F.struct((F.col("size") / scale).cast("long").alias("size"), F.col("count"), F.lit(len(self.indexes) + 1).alias("nindexes")).alias("storageStats")] if "storageStats" in (spec or {}) else []))
        if stage == "$indexStats":
            rows = [("_id_", '{"_id": 1}')] + [(n, repr(i["key"])) for n, i in self.indexes.items()]
            return self.spark.createDataFrame(rows, "name string, key string").withColumn("accesses", F.struct(F.lit(0).cast("long").alias("ops")))
        if stage == "$currentOp":
            tracker = self.spark.sparkContext.statusTracker()
            rows = [(int(j), "active") for j in tracker.getActiveJobsIds()]
            return self.spark.createDataFrame(rows, "opid long, state string")
        if stage == "$planCacheStats":
            return self.spark.createDataFrame([], "planCacheKey string, isActive boolean")
        return self.spark.createDataFrame([(self.spark.sparkContext.applicationId, self.spark.sparkContext.sparkUser())], "_id string, user string")

    def find(self, filter: dict | None = None, projection: Any = None, sort: Any = None, skip: int = 0, limit: int = 0, let: dict | None = None, collation: dict | None = None, hint: Any = None) -> DataFrame:  # noqa: A002 - the API's names
        """Filter, sort, skip, limit and projection, as one lazy plan. A hint has to name an index; Catalyst plans the scan."""
        self._check_hint(hint)
        return run_find(self, filter or {}, projection, sort, skip, limit, let, collation)

    def _check_hint(self, hint: Any) -> None:
        if hint is None:
            return
        known = self.list_indexes()
        wanted = dict(hint) if isinstance(hint, dict | list) else hint
        if not any(wanted == i["name"] or (isinstance(wanted, dict) and list(wanted.items()) == list(i["key"].items())) for i in known):
            raise QueryError(f"the hint {hint} names no index")

    def find_one(self, filter: dict | None = None, projection: Any = None, sort: Any = None) -> dict | None:  # noqa: A002
        row = self.find(filter, projection, sort, limit=1).first()
        return None if row is None else row.asDict(recursive=True)

    def aggregate(self, pipeline: list, let: dict | None = None) -> DataFrame:
        """A lazy plan; a last `$merge` runs at once and leaves no rows."""
        if pipeline and single(pipeline[-1])[0] == "$merge":
            made = run(pipeline[:-1], self.df(), self.context(let))
            self._merge(made, single(pipeline[-1])[1])
            return made.where("false")
        return run(pipeline, self.df(), self.context(let))

    def raw_batches(self, df: DataFrame, batch_size: int = 1000, raw: bool = False) -> Iterator[Any]:
        """Batches of at most `batch_size` documents, packed by the executors; the driver holds one partition and the next.
        raw: the batches as Arrow streams (bytes), which the receiver decodes."""
        import pyarrow as pa

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, batch_size):
                    sink = pa.BufferOutputStream()
                    part = batch.slice(at, batch_size)
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

        for row in df.mapInArrow(pack, "b binary").toLocalIterator(prefetchPartitions=True):
            yield bytes(row["b"]) if raw else pa.ipc.open_stream(row["b"]).read_all().to_pylist()

    def count_documents(self, filter: dict, skip: int = 0, limit: int = 0) -> int:  # noqa: A002
        return self.find(filter, skip=skip, limit=limit).count()

    def estimated_document_count(self) -> int:
        return self.df().count()

    def distinct(self, key: str, filter: dict | None = None) -> DataFrame:  # noqa: A002
        """One row a value, array members each on their own; column `value`."""
        df = self.df().where(compile_filter(filter or {}, Scope.of(self.df().schema)))
        e = concrete(resolve(Scope.of(df.schema), key))
        return df.select((F.explode_outer(e.col) if is_array(e.type) else e.col).alias("value")).dropDuplicates()

    def explain(self, pipeline: list | None = None, filter: dict | None = None) -> dict:  # noqa: A002
        from ..plans.explain import explain

        return explain(run(pipeline, self.df(), self.context()) if pipeline is not None else self.find(filter or {}), pipeline)

    # --- indexes -----------------------------------------------------------------------------------------------------

    def create_index(self, keys: Any, name: str | None = None, **options: Any) -> str:
        keys = {keys: 1} if isinstance(keys, str) else dict(keys)
        if any(d not in (1, -1, "text", "hashed", "2dsphere", "2d") for d in keys.values()):
            raise QueryError("an index key goes by 1, -1, text, hashed, 2dsphere or 2d")
        name = name or "_".join(f"{p}_{d}" for p, d in keys.items())
        index = {"key": keys} | options
        if options.get("unique") and self.name in self.database.tables:
            self._check_unique(self.df(), index)
        self.indexes[name] = index
        return name

    def drop_index(self, name: str) -> None:
        if name not in self.indexes:
            raise QueryError(f"no index {name}")
        del self.indexes[name]

    def list_indexes(self) -> list[dict]:
        return [{"name": "_id_", "key": {"_id": 1}}] + [{"name": n} | i for n, i in self.indexes.items()]

    def create_search_index(self, definition: dict, name: str = "default") -> str:
        self.search_indexes[name] = definition
        return name

    update_search_index = create_search_index

    def drop_search_index(self, name: str) -> None:
        self.search_indexes.pop(name, None)

    def list_search_indexes(self) -> list[dict]:
        return [{"name": n, "definition": d} for n, d in self.search_indexes.items()]

    # --- writing -----------------------------------------------------------------------------------------------------

    def _check_unique(self, df: DataFrame, index: dict) -> None:
        scope = Scope.of(df.schema)
        parts = [resolve(scope, p) for p in index["key"]]
        if index.get("sparse"):
            present = F.lit(False)
            for e in parts:
                present = present | e.col.isNotNull()
            df = df.where(present)
        if index.get("partialFilterExpression"):
            df = df.where(compile_filter(index["partialFilterExpression"], scope))
        keys = [(F.explode_outer(F.array_distinct(e.col)) if is_array(e.type) else concrete(e).col).alias(f"k{i}") for i, e in enumerate(parts)]
        if df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise WriteError(f"duplicate key in {index['key']}")

    def _rule(self, df: DataFrame) -> Column | None:
        """Whether the validator takes a document; None if there is none to ask."""
        options = self.options
        if not options.validator or options.level == "off" or options.action != "error":
            return None
        scope = Scope.of(df.schema)
        rule = valid(options.validator["$jsonSchema"], scope.root()) if "$jsonSchema" in options.validator else compile_filter(options.validator, scope)
        return F.coalesce(rule, F.lit(False))

    def _commit(self, marked: DataFrame, bypass: bool = False, beside: DataFrame | None = None) -> tuple[int, int]:
        """(rows written, rows changed) by a version whose rows carry WRITTEN, CHANGED and EVENT.

        The version is computed once, checked as it lies in its folder, and then switched to; a version that nobody wrote
        to or that breaks a rule is discarded. `beside`: rows that the version leaves as they are and where they are.
        """
        staged, path = self.database.stage(self.name, marked)
        try:
            written, changed = (x or 0 for x in staged.agg(F.count(F.when(F.col(WRITTEN), 1)), F.count(F.when(F.col(CHANGED), 1))).first())
            if not written:
                self.database.discard(path)
                return 0, 0
            rule = None if bypass else self._rule(staged)
            if rule is not None:
                asked = F.col(WRITTEN)
                if self.options.level == "moderate" and WAS_VALID in staged.columns:
                    asked = asked & F.coalesce(WAS_VALID, F.lit(True))
                if staged.where(asked & ~rule).limit(1).count():
                    raise WriteError("a document fails validation")
            plain = staged.drop(*[c for c in staged.columns if hidden(c)])
            version = plain if beside is None else united(beside, plain)
            for index in ({"key": {"_id": 1}}, *(i for i in self.indexes.values() if i.get("unique"))):
                if "_id" in version.columns or next(iter(index["key"])) != "_id":
                    self._check_unique(version, index)
        except BaseException:
            self.database.discard(path)
            raise
        self.database.tables[self.name] = version
        self.database.parts[self.name] = self.database.parts.get(self.name, 1) + 1 if beside is not None else 1
        if changed and self.database.listeners:
            for event in [r[0] for r in staged.where(CHANGED).select(EVENT).distinct().collect()]:  # a handful of names
                rows = staged.where(F.col(CHANGED) & (F.col(EVENT) == event))
                self.database.announce(self.name, event, rows.drop(*[c for c in rows.columns if hidden(c)]))
        return written, changed

    def _insert(self, rows: DataFrame, bypass: bool = False) -> int:
        """Rows beside those that are there: a table that is there is not written again, but for every MOST_PARTS-th time."""
        old = self.database.tables.get(self.name)
        marked = marking(rows, F.lit(True), F.lit(True), "insert")
        if old is None:
            return self._commit(marked, bypass)[0]
        if self.database.parts.get(self.name, 1) < MOST_PARTS:
            return self._commit(marked, bypass, beside=old)[0]
        return self._commit(united(marking(old, F.lit(False), F.lit(False), "insert"), marked), bypass)[0]

    def _rows(self, documents: list[dict]) -> DataFrame:
        documents = [{"_id": uuid.uuid4().hex[:24]} | d if "_id" not in d else d for d in documents]
        rows = [literal(d) for d in documents]
        kind = common_type([r.type for r in rows])
        made = self.spark.range(1).select(F.explode(F.array(*[cast(r, kind) for r in rows])).alias("d")).select("d.*")
        return made.select(*[concrete(E(F.col(quote(f.name)), f.dataType)).col.alias(f.name) for f in made.schema.fields])

    def insert_many(self, documents: list[dict], bypass_document_validation: bool = False) -> Result:
        if not documents:
            raise QueryError("nothing to insert")
        return self.insert_df(self._rows(documents), bypass_document_validation)

    def insert_one(self, document: dict, bypass_document_validation: bool = False) -> Result:
        return self.insert_many([document], bypass_document_validation)

    def insert_df(self, rows: DataFrame, bypass_document_validation: bool = False) -> Result:
        """Insert a DataFrame's rows: the way to load anything large."""
        return Result(inserted=self._insert(rows, bypass_document_validation))

    def _condition(self, df: DataFrame, filter: dict, one: bool, sort_by: Any = None, let: dict | None = None) -> tuple[DataFrame, Column]:  # noqa: A002
        """(df, whether a row is to be written): all that match, or the first."""
        if not one:
            return df, F.coalesce(compile_filter(filter, Scope.of(df.schema, {n: literal(v) for n, v in (let or {}).items()})), F.lit(False))
        if "_id" not in df.columns:
            raise QueryError("writes to single documents need _id")
        first = run_find(self, filter, {"_id": 1}, sort_by, 0, 1, let, None).first()
        return df, (equal_to(df, "_id", first["_id"]) if first is not None else F.lit(False))

    def _marked(self, df: DataFrame, test: Column) -> DataFrame:
        """df with WRITTEN by the test on the rows as they are, the document before and whether it was valid."""
        rule = self._rule(df)
        made = df.withColumns({WRITTEN: F.coalesce(test, F.lit(False)), BEFORE: Scope.of(df.schema).root().col})
        return made.withColumn(WAS_VALID, rule if rule is not None else F.lit(True))

    def _update(self, filter: dict, update: Any, one: bool, upsert: bool = False, array_filters: list | None = None, sort: Any = None, let: dict | None = None, hint: Any = None, bypass: bool = False) -> Result:  # noqa: A002
        """The filter is asked of the documents before the update; the validator and listeners see them after it."""
        self._check_hint(hint)
        df, test = self._condition(self.df(), filter, one, sort, let)
        if not df.where(test).limit(1).count():
            return self._upsert(filter, update, bypass) if upsert else Result()
        marked = self._marked(df, test)
        if isinstance(update, list):
            for spec in update:
                if single(spec)[0] not in ("$set", "$addFields", "$project", "$unset", "$replaceRoot", "$replaceWith"):
                    raise QueryError(f"{single(spec)[0]} is no stage of an update")
            made = execute(update, Flow(marked.where(WRITTEN), self.context(let))).df
            if "_id" in df.columns and "_id" not in made.columns:
                made = made.withColumn("_id", F.col(BEFORE)["_id"])
            new = united(made, marked.where(~F.col(WRITTEN)))
        else:
            new = updates.apply(marked, F.col(WRITTEN), update, filter, array_filters)
        if "_id" in new.columns and isinstance(update, list):
            kept = equal(E(F.col("_id"), new.schema["_id"].dataType), E(F.col(BEFORE)["_id"], df.schema["_id"].dataType))
            new = new.withColumn("_id", F.when(kept | ~F.col(WRITTEN), F.col("_id")).otherwise(F.raise_error(F.lit("_id cannot be changed")).cast(new.schema["_id"].dataType)))
        new = new.withColumns({CHANGED: F.col(WRITTEN) & differs(new, df.schema), EVENT: F.lit("update")}).drop(BEFORE)
        written, changed = self._commit(new, bypass)
        return Result(matched=written, modified=changed)

    def update_one(self, filter: dict, update: Any, upsert: bool = False, array_filters: list | None = None, sort: Any = None, let: dict | None = None, hint: Any = None, bypass_document_validation: bool = False) -> Result:  # noqa: A002
        return self._update(filter, update, True, upsert, array_filters, sort, let, hint, bypass_document_validation)

    def update_many(self, filter: dict, update: Any, upsert: bool = False, array_filters: list | None = None, let: dict | None = None, hint: Any = None, bypass_document_validation: bool = False) -> Result:  # noqa: A002
        return self._update(filter, update, False, upsert, array_filters, None, let, hint, bypass_document_validation)

    def _upsert(self, filter: dict, update: Any, bypass: bool = False) -> Result:  # noqa: A002
        seed: dict[str, Any] = {}
        for key, value in equalities(filter).items():
            at = seed
            *parents, last = key.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = value
        seed.setdefault("_id", uuid.uuid4().hex[:24])
        rows = self._rows([seed])
        if isinstance(update, dict) and not any(k.startswith("$") for k in update):
            rows = self._rows([{"_id": seed["_id"]} | update])
        elif isinstance(update, list):
            rows = run(update, rows, self.context())
        else:
            body = {k: v for k, v in update.items() if k != "$setOnInsert"}
            if update.get("$setOnInsert"):
                body["$set"] = body.get("$set", {}) | update["$setOnInsert"]
            rows = updates.apply(rows, F.lit(True), body) if body else rows
        self._insert(rows, bypass)
        return Result(upserted_id=seed["_id"])

    def replace_one(self, filter: dict, document: dict, upsert: bool = False, sort: Any = None, let: dict | None = None, hint: Any = None, bypass_document_validation: bool = False) -> Result:  # noqa: A002
        if any(k.startswith("$") for k in document):
            raise QueryError("a replacement has no operators")
        self._check_hint(hint)
        df, test = self._condition(self.df(), filter, True, sort, let)
        old = df.where(test).select("_id").first()
        if old is None:
            return self._upsert(filter, document, bypass_document_validation) if upsert else Result()
        marked = self._marked(df, test)
        row = self._rows([{"_id": old["_id"]} | {k: v for k, v in document.items() if k != "_id"}])
        taken = marked.where(WRITTEN).select(WRITTEN, BEFORE, WAS_VALID).join(F.broadcast(row), how="cross")  # one row
        new = united(taken, marked.where(~F.col(WRITTEN)))
        new = new.withColumns({CHANGED: F.col(WRITTEN) & differs(new, df.schema), EVENT: F.lit("replace")}).drop(BEFORE)
        written, changed = self._commit(new, bypass_document_validation)
        return Result(matched=written, modified=changed)

    def _delete(self, filter: dict, one: bool, sort: Any = None, let: dict | None = None) -> Result:  # noqa: A002
        """Listeners get the keys of the documents that go."""
        df, test = self._condition(self.df(), filter, one, sort, let)
        gone = df.where(test)
        n = gone.count()
        if n:
            staged, _ = self.database.stage(self.name, df.where(~F.coalesce(test, F.lit(False))))
            self.database.tables[self.name] = staged
            self.database.parts[self.name] = 1
            self.database.announce(self.name, "delete", gone.select("_id") if "_id" in df.columns else gone)
        return Result(deleted=n)

    def delete_one(self, filter: dict, let: dict | None = None, hint: Any = None) -> Result:  # noqa: A002
        self._check_hint(hint)
        return self._delete(filter, True, None, let)

    def delete_many(self, filter: dict, let: dict | None = None, hint: Any = None) -> Result:  # noqa: A002
        self._check_hint(hint)
        return self._delete(filter, False, None, let)

    def _shown(self, rows: DataFrame, projection: Any, filter: dict) -> dict | None:  # noqa: A002
        row = (project_find(Flow(rows, self.context()), projection, filter) if projection else rows).first()
        return None if row is None else row.asDict(recursive=True)

    def find_one_and_update(self, filter: dict, update: Any, sort: Any = None, after: bool = False, upsert: bool = False, projection: Any = None, array_filters: list | None = None, let: dict | None = None) -> dict | None:  # noqa: A002
        """The document before (or after) the update, by the id that one search found."""
        old = self.df()
        found = run_find(self, filter, {"_id": 1}, sort, 0, 1, let, None).first()
        by_id = {"_id": found["_id"]} if found else filter
        result = self._update(filter | by_id, update, True, upsert, array_filters, let=let)
        if not after:
            return self._shown(old.where(equal_to(old, "_id", found["_id"])), projection, filter) if found else None
        key = found["_id"] if found else result.upserted_id
        new = self.df()
        return None if key is None else self._shown(new.where(equal_to(new, "_id", key)), projection, filter)

    def find_one_and_replace(self, filter: dict, document: dict, sort: Any = None, after: bool = False, upsert: bool = False, projection: Any = None, let: dict | None = None) -> dict | None:  # noqa: A002
        old = self.df()
        found = run_find(self, filter, {"_id": 1}, sort, 0, 1, let, None).first()
        if not found and not upsert:
            return None
        result = self.replace_one({"_id": found["_id"]} if found else filter, document, upsert)
        if not after:
            return self._shown(old.where(equal_to(old, "_id", found["_id"])), projection, filter) if found else None
        new = self.df()
        return self._shown(new.where(equal_to(new, "_id", found["_id"] if found else result.upserted_id)), projection, filter)

    def find_one_and_delete(self, filter: dict, sort: Any = None, projection: Any = None, let: dict | None = None) -> dict | None:  # noqa: A002
        old = self.df()
        found = run_find(self, filter, {"_id": 1}, sort, 0, 1, let, None).first()
        if not found:
            return None
        self._delete({"_id": found["_id"]}, True)
        return self._shown(old.where(equal_to(old, "_id", found["_id"])), projection, filter)

    def bulk_write(self, requests: list[tuple], ordered: bool = True) -> Result:
        """Requests ("insert_one", document), ("update_one", filter, update), ... one after the other. Ordered ones stop at
        the first error; unordered ones all run, and then a BulkWriteError names those that failed."""
        done, errors = Result(), []
        for k, (name, *arguments) in enumerate(requests):
            if name not in ("insert_one", "update_one", "update_many", "replace_one", "delete_one", "delete_many"):
                raise QueryError(f"unknown request {name}")
            try:
                r = getattr(self, name)(*arguments)
            except QueryError as wrong:
                if ordered:
                    raise
                errors.append((k, str(wrong)))
                continue
            done = Result(done.inserted + r.inserted, done.matched + r.matched, done.modified + r.modified, done.deleted + r.deleted, r.upserted_id or done.upserted_id)
        if errors:
            raise BulkWriteError(errors, done)
        return done

    def _merge(self, rows: DataFrame, spec: Any) -> None:
        """Rows into another collection by _id: one full outer join, then the next version."""
        spec = {"into": spec} if isinstance(spec, str) else spec
        into = spec["into"]["coll"] if isinstance(spec["into"], dict) else spec["into"]
        if spec.get("on", "_id") not in ("_id", ["_id"]):
            raise QueryError("$merge goes by _id")
        found, missing = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
        if found not in ("replace", "merge", "keepExisting", "fail") or missing not in ("insert", "discard", "fail"):
            raise QueryError("$merge does not know this mode")
        target = self.database[into]
        if into not in self.database.tables:
            if missing == "fail" and rows.limit(1).count():
                raise WriteError("$merge found no matching document")
            if missing == "insert" and not target._insert(rows):
                self.database.tables[into] = rows.limit(0)
            return
        target._commit(merged(self.database.tables[into], rows, found, missing, marks=True))


def marking(df: DataFrame, written: Column, changed: Column, event: str) -> DataFrame:
    return df.withColumns({WRITTEN: written, CHANGED: changed, EVENT: F.lit(event)})


def _plain(e: E) -> E:
    """Values that can be compared: those that hold variants as JSON."""
    return E(F.to_json(F.struct(e.col.alias("v"))), T.StringType()) if "variant" in e.type.simpleString() else e


def differs(df: DataFrame, before: T.StructType) -> Column:
    """Whether a document is another one than its BEFORE; never null."""
    out = F.lit(False)
    names = list(dict.fromkeys([*before.names, *df.columns]))
    for n in (x for x in names if not hidden(x)):
        old = _plain(E(F.col(BEFORE).getField(n), before[n].dataType)) if n in before.names else literal(None)
        new = _plain(E(F.col(quote(n)), df.schema[n].dataType)) if n in df.columns else literal(None)
        out = out | ~equal(old, new)
    return out


def merged(old: DataFrame, rows: DataFrame, found: str = "merge", missing: str = "insert", marks: bool = False) -> DataFrame:
    """What `$merge` makes of two tables; marks: with the hidden columns of a staged version."""
    names = list(dict.fromkeys([*old.columns, *rows.columns]))
    a = old.select(*[F.col(quote(c)).alias(f"a_{c}") for c in old.columns], F.lit(True).alias("__sd_a"))
    b = rows.select(*[F.col(quote(c)).alias(f"b_{c}") for c in rows.columns], F.lit(True).alias("__sd_b"))
    both = a.join(b, F.col("a__id").eqNullSafe(F.col("b__id")), "full")
    in_a, in_b = F.col("__sd_a").isNotNull(), F.col("__sd_b").isNotNull()
    if missing == "discard":
        both = both.where(in_a)
    fails = [(found == "fail", in_a & in_b, "matched"), (missing == "fail", ~in_a & in_b, "did not match")]
    for on, when, how in fails:
        if on:
            both = both.where(F.when(when, F.raise_error(F.lit(f"$merge {how} a document")).cast("boolean")).otherwise(F.lit(True)))
    out, changed = [], ~in_a
    for c in names:
        left = E(F.col(quote(f"a_{c}")), old.schema[c].dataType) if c in old.columns else literal(None)
        right = E(F.col(quote(f"b_{c}")), rows.schema[c].dataType) if c in rows.columns else literal(None)
        kind = common_type([left.type, right.type])
        x, y = cast(left, kind), cast(right, kind)
        if found == "replace":
            chosen = F.when(in_b, y).otherwise(x)
        elif found == "keepExisting":
            chosen = F.when(in_a, x).otherwise(y)
        else:
            chosen = F.when(in_b & F.lit(c in rows.columns), F.coalesce(y, x)).otherwise(x)
        out.append(chosen.alias(c))
        changed = changed | ~equal(_plain(E(x, kind)), _plain(E(chosen, kind)))
    if marks:
        written = in_b & (~in_a | F.lit(found != "keepExisting"))
        out += [written.alias(WRITTEN), (written & changed).alias(CHANGED), F.when(~in_a, "insert").otherwise("replace" if found == "replace" else "update").alias(EVENT)]
    return both.select(*out)


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both under a schema that holds both."""
    types = {f.name: f.dataType for f in a.schema.fields}
    for f in b.schema.fields:
        types[f.name] = common_type([types[f.name], f.dataType]) if f.name in types else f.dataType

    def under(df: DataFrame) -> DataFrame:
        return df.select(*[(cast(E(F.col(quote(n)), df.schema[n].dataType), t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()])

    return under(a).unionAll(under(b))


def equal_to(df: DataFrame, name: str, value: Any) -> Column:
    return F.col(quote(name)).eqNullSafe(F.lit(value) if not isinstance(value, dict | list) else literal(value).col)


def equalities(filter: dict) -> dict[str, Any]:  # noqa: A002
    """What an upsert takes over from its filter."""
    out: dict[str, Any] = {}
    for key, value in filter.items():
        if key == "$and":
            for part in value:
                out |= equalities(part)
        elif key.startswith("$"):
            continue
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            if "$eq" in value:
                out[key] = value["$eq"]
            elif "$in" in value and len(value["$in"]) == 1:
                out[key] = value["$in"][0]
        else:
            out[key] = value
    return out


#: Collations by strength: 1 ignores case and accents, 2 case, 3 neither.
COLLATIONS = {1: "UNICODE_CI_AI", 2: "UNICODE_CI", 3: "UNICODE"}


def collated(df: DataFrame, collation: dict | None) -> DataFrame:
    """Strings under a collation: comparisons, sorts and groups go by it."""
    if not collation or collation.get("locale") == "simple":
        return df
    if collation.get("locale") != "en" or set(collation) - {"locale", "strength", "caseLevel"}:
        raise QueryError("collations are simple, or en with a strength")
    name = COLLATIONS[collation.get("strength", 3)]
    return df.select(*[F.collate(F.col(quote(f.name)), name).alias(f.name) if f.dataType == T.StringType() else F.col(quote(f.name)) for f in df.schema.fields])


def run_find(c: Collection, filter: dict, projection: Any, order: Any, offset: int, most: int, let: dict | None, collation: dict | None) -> DataFrame:  # noqa: A002
    if order is not None:
        order = dict(order) if not isinstance(order, str) else {order: 1}
    flow = Flow(collated(c.df(), collation), c.context(let))
    if order or offset or most:
        from ..functions.core import LONG
        from ..operators.ordering import ORDINAL, Key

        flow = flow.on(flow.df.withColumn(ORDINAL, F.monotonically_increasing_id()), ties=(Key(ORDINAL, LONG),), ordered=True)
    flow = match(flow, filter, False) if filter else flow
    if order:
        flow = sort(flow, order, False)
    if offset:
        flow = skip(flow, offset, False)
    if most:
        flow = limit(flow, most, False)
    df = project_find(flow, projection, filter) if projection else flow.df
    return df.drop(*[x for x in df.columns if hidden(x)])


def utcnow() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
