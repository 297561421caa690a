import datetime

import pytest

from sparkdoc.errors import QueryError, UnsupportedOperator
from sparkdoc.sources.collection import Database, WriteError
from sparkdoc.streaming.changes import ChangeLog, drain, gaps, watch, windowed_counts


@pytest.fixture
def db(spark, tmp_path):
    made = Database(spark, str(tmp_path / "data"))
    made["c"].insert_many([{"_id": 1, "a": 1, "tags": ["x"], "s": {"n": 1}}, {"_id": 2, "a": 5, "tags": [], "s": {"n": 2}}, {"_id": 3, "a": 9, "tags": ["x", "y"], "s": {"n": 3}}])
    return made


def test_reads(db):
    c = db["c"]
    assert [r._id for r in c.find({"a": {"$gt": 1}}, {"a": 1}, [("a", -1)]).collect()] == [3, 2]
    assert c.count_documents({"tags": "x"}) == 2 and c.estimated_document_count() == 3
    assert sorted(r.value or "" for r in c.distinct("tags").collect()) == ["", "x", "y"]
    assert c.find_one({"_id": 2})["a"] == 5 and c.find_one({"_id": 99}) is None
    assert c.find({"tags": "y"}, {"tags.$": 1}).first().tags == ["y"]
    assert sum(map(len, c.raw_batches(c.find()))) == 3


def test_updates(db):
    c = db["c"]
    assert c.update_many({"a": {"$gte": 5}}, {"$inc": {"a": 1}, "$push": {"tags": "z"}, "$set": {"s.n": 7}}).modified == 2
    assert [(r.a, r.tags, r.s.n) for r in c.find({}, sort=[("_id", 1)]).collect()] == [(1, ["x"], 1), (6, ["z"], 7), (10, ["x", "y", "z"], 7)]
    assert c.update_one({}, {"$set": {"new": "v"}}, sort=[("_id", -1)]).modified == 1
    assert c.find_one({"_id": 3})["new"] == "v" and c.find_one({"_id": 1})["new"] is None
    c.update_many({"_id": 1}, [{"$set": {"a": {"$add": ["$a", 100]}}}])
    assert c.find_one({"_id": 1})["a"] == 101
    with pytest.raises(QueryError):
        c.update_many({}, {"$set": {"_id": 5}})
    with pytest.raises(QueryError):
        c.update_many({}, {"$set": {"s": 1, "s.n": 2}})
    with pytest.raises(UnsupportedOperator):
        c.update_many({}, {"$nope": {"a": 1}})


def test_writes(db):
    c = db["c"]
    with pytest.raises(WriteError):
        c.insert_one({"_id": 1, "a": 0})
    assert c.update_one({"_id": 50, "a": {"$eq": 4}}, {"$set": {"s.n": 1}, "$setOnInsert": {"b": "new"}}, upsert=True).upserted_id == 50
    assert c.find_one({"_id": 50}) | {} == {"_id": 50, "a": 4, "tags": None, "s": {"n": 1}, "b": "new"}
    assert c.replace_one({"_id": 50}, {"a": 8}).modified == 1 and c.find_one({"_id": 50})["b"] is None
    assert c.find_one_and_update({"_id": 2}, {"$inc": {"a": 1}}, after=True)["a"] == 6
    assert c.find_one_and_delete({}, sort=[("a", 1)])["_id"] == 1
    assert c.delete_many({"a": {"$gt": 6}}).deleted == 2 and c.count_documents({}) == 1
    done = c.bulk_write([("insert_one", {"_id": 70, "a": 1}), ("delete_one", {"_id": 2}), ("update_many", {}, {"$mul": {"a": 3}})])
    assert (done.inserted, done.deleted, done.modified) == (1, 1, 1) and c.find_one({})["a"] == 3


def test_indexes_and_validators(db):
    c = db["c"]
    c.create_index("a", unique=True)
    with pytest.raises(WriteError):
        c.insert_one({"_id": 9, "a": 5})
    assert [i["name"] for i in c.list_indexes()] == ["_id_", "a_1"]
    v = db.create_collection("v", {"$jsonSchema": {"required": ["n"], "properties": {"n": {"minimum": 0}}}})
    v.insert_one({"_id": 1, "n": 3})
    with pytest.raises(WriteError):
        v.insert_one({"_id": 2, "n": -3})
    old = datetime.datetime(2001, 1, 1)
    e = db["e"]
    e.insert_many([{"_id": 1, "at": old}, {"_id": 2, "at": datetime.datetime(2999, 1, 1)}])
    e.create_index("at", expireAfterSeconds=60)
    assert [r._id for r in e.find().collect()] == [2]


def test_merge(db):
    db["c"].aggregate([{"$match": {"a": {"$gt": 1}}}, {"$project": {"a": 1}}, {"$merge": {"into": "m"}}])
    db["c"].aggregate([{"$project": {"b": {"$literal": 0}}}, {"$merge": {"into": "m", "whenNotMatched": "discard"}}])
    assert sorted((r._id, r.a, r.b) for r in db["m"].find().collect()) == [(2, 5, 0), (3, 9, 0)]


def test_commands(db):
    assert db.command("ping")["ok"] == 1.0
    assert db.command({"count": "c", "query": {"a": {"$gt": 1}}})["n"] == 2
    assert len(db.command({"find": "c", "limit": 2})["cursor"]["firstBatch"]) == 2
    assert db.command({"explain": {"find": "c", "filter": {"a": 1}}})["python"] is False
    assert db.command({"update": "c", "updates": [{"q": {"_id": 1}, "u": {"$set": {"a": 0}}}]})["nModified"] == 1
    with pytest.raises(UnsupportedOperator):
        db.command("shutdown")


def test_change_stream(db, spark, tmp_path):
    log = ChangeLog(db, str(tmp_path / "log"))
    db["c"].insert_one({"_id": 4, "a": 2})
    db["c"].update_many({"_id": {"$lte": 2}}, {"$set": {"a": 0}})
    events = watch(spark, log.folder, [{"$match": {"operationType": "insert"}}, {"$project": {"seq": 1, "documentKey": 1, "a": "$fullDocument.a"}}], coll="c", schema="_id long, a long")
    assert [(r.documentKey, r.a) for r in drain(events, str(tmp_path / "ck")).collect()] == [("4", 2)]
    seen = drain(watch(spark, log.folder), str(tmp_path / "all")).count()
    assert seen == 3 and gaps(spark.read.schema("seq long").json(log.folder)).count() == 0
    db["c"].delete_many({"_id": 4})
    assert watch(spark, log.folder, resume_after=1, streaming=False).count() == 3
    gone = watch(spark, log.folder, resume_after=3, streaming=False).first()
    assert (gone.operationType, gone.documentKey, gone.fullDocument) == ("delete", "4", None)
    with pytest.raises(QueryError):
        watch(spark, log.folder, [{"$group": {"_id": None}}])


def test_updates_that_leave_their_filter(db, spark, tmp_path):
    v = db.create_collection("v", {"n": {"$lt": 10}})
    v.insert_many([{"_id": 1, "st": "A", "n": 1}, {"_id": 2, "st": "A", "n": 2}, {"_id": 3, "st": "B", "n": 3}])
    log = ChangeLog(db, str(tmp_path / "log"))
    with pytest.raises(WriteError):
        v.update_many({"st": "A"}, {"$set": {"st": "Z", "n": 99}})
    assert v.count_documents({"st": "A"}) == 2 and log.last == 0
    assert v.update_many({"st": "A"}, {"$set": {"st": "Z", "n": 99}}, bypass_document_validation=True).modified == 2
    events = watch(spark, log.folder, streaming=False, schema="_id long, st string, n long", full_document="updateLookup").orderBy("seq").collect()
    assert sorted((e.operationType, e.documentKey, e.fullDocument.st) for e in events) == [("update", "1", "Z"), ("update", "2", "Z")]
    same = v.update_many({}, {"$set": {"st": "Z"}}, bypass_document_validation=True)
    assert (same.matched, same.modified) == (3, 1) and log.last == 3
    assert v.update_many({"_id": 1}, [{"$set": {"st": "Z"}}], bypass_document_validation=True).modified == 0
    assert v.update_many({"_id": 1}, [{"$project": {"n": 1}}], bypass_document_validation=True).modified == 1
    with pytest.raises(Exception, match="_id cannot be changed"):
        v.update_many({"_id": 1}, [{"$set": {"_id": 9}}], bypass_document_validation=True)
    assert v.replace_one({"_id": 3}, {"n": 4}).modified == 1 and v.replace_one({"_id": 3}, {"n": 4}).modified == 0
    assert v.delete_many({"n": {"$gt": 50}}).deleted == 2
    kinds = [e.operationType for e in watch(spark, log.folder, streaming=False).orderBy("seq").collect()]
    assert kinds[3:] == ["update", "replace", "delete", "delete"]
    db.drop_collection("v")
    again = ChangeLog(db, log.folder)
    assert again.last == log.last == 9
    assert [e.operationType for e in watch(spark, log.folder, coll="v", resume_after=7, streaming=False).orderBy("seq").collect()] == ["drop", "invalidate"]


def test_moderate_validation(db):
    c = db["m"]
    c.insert_many([{"_id": 1, "n": 50}, {"_id": 2, "n": 5}])
    db.create_collection("m", {"n": {"$lt": 10}}, validationLevel="moderate")
    assert c.update_many({"_id": 1}, {"$inc": {"n": 1}}).modified == 1
    with pytest.raises(WriteError):
        c.update_many({"_id": 2}, {"$inc": {"n": 10}})


def test_hints_projections_and_bulk_errors(db):
    from sparkdoc.sources.collection import BulkWriteError

    c = db["c"]
    c.create_index("a")
    assert c.find({"a": 5}, hint="a_1").count() == 1 and c.find({"a": 5}, hint={"a": 1}).count() == 1
    with pytest.raises(QueryError):
        c.find({}, hint="nope")
    assert c.find_one_and_update({"_id": 1}, {"$set": {"a": 3}}, projection={"a": 1}) == {"_id": 1, "a": 1}
    assert c.find_one_and_update({"a": {"$gt": 4}}, {"$set": {"a": 0}}, sort=[("a", -1)], after=True, projection={"a": 1}) == {"_id": 3, "a": 0}
    assert c.update_many({"$expr": {"$eq": ["$a", "$$x"]}}, {"$set": {"a": 8}}, let={"x": 3}).modified == 1
    with pytest.raises(BulkWriteError) as failed:
        c.bulk_write([("insert_one", {"_id": 1}), ("insert_one", {"_id": 60, "a": 1}), ("insert_one", {"_id": 60})], ordered=False)
    assert [k for k, _ in failed.value.errors] == [0, 2] and failed.value.result.inserted == 1
    import pyarrow as pa

    assert [len(b) for b in c.raw_batches(c.find().coalesce(1), 3)] == [3, 1]
    assert sum(pa.ipc.open_stream(b).read_all().num_rows for b in c.raw_batches(c.find(), raw=True)) == 4


def test_cursors_and_kill(db):
    first = db.command({"find": "c", "sort": [("_id", 1)], "batchSize": 2})["cursor"]
    assert [d["_id"] for d in first["firstBatch"]] == [1, 2] and first["id"]
    rest = db.command({"getMore": first["id"], "collection": "c"})["cursor"]
    assert [d["_id"] for d in rest["nextBatch"]] == [3] and rest["id"] == 0
    held = db.command({"find": "c", "batchSize": 1})["cursor"]["id"]
    assert db.command({"killCursors": "c", "cursors": [held, 10**9]})["cursorsKilled"] == [held]
    assert db.command({"killOp": 1, "op": 10**9})["info"] == "no such operation"
    with pytest.raises(QueryError):
        db.command({"killOp": 1})


def test_many_inserts_and_merge_events(db, spark, tmp_path):
    c = db["i"]
    for k in range(35):
        c.insert_one({"_id": k, "a": k})
    assert c.count_documents({}) == 35 and db.parts["i"] < 35
    log = ChangeLog(db, str(tmp_path / "log"))
    db["c"].aggregate([{"$project": {"a": {"$literal": 1}}}, {"$merge": {"into": "i", "whenMatched": "replace"}}])
    db["c"].aggregate([{"$project": {"_id": {"$add": ["$_id", 33]}, "a": {"$literal": 7}}}, {"$merge": {"into": "i", "whenMatched": "keepExisting"}}])
    kinds = sorted((e.operationType, e.documentKey) for e in watch(spark, log.folder, streaming=False).collect())
    assert kinds == [("insert", "35"), ("insert", "36"), ("replace", "2"), ("replace", "3")]


def test_transaction_events(db, spark, tmp_path):
    from sparkdoc.sources.sessions import Session

    log = ChangeLog(db, str(tmp_path / "log"))
    s = Session(db)
    s.start_transaction()["c"].delete_one({"_id": 1})
    assert log.last == 0
    s.commit_transaction()
    s.start_transaction()["c"].delete_one({"_id": 2})
    s.abort_transaction()
    assert [(e.operationType, e.documentKey) for e in watch(spark, log.folder, streaming=False).collect()] == [("delete", "1")]


def test_windowed_stream(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 30) AS ts, id % 2 AS k FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "in"))
    assert windowed_counts(stream, "ts", "1 minute", "0 seconds", "k").isStreaming
    batch = windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "1 minute", "0 seconds", "k")
    assert batch.count() == 10


def test_transactions(db):
    from sparkdoc.sources.sessions import Conflict, Session

    s = Session(db)
    staged = s.start_transaction()
    staged["c"].delete_many({"_id": 1})
    assert staged["c"].count_documents({}) == 2 and db["c"].count_documents({}) == 3
    s.commit_transaction()
    assert db["c"].count_documents({}) == 2
    staged = s.start_transaction()
    staged["c"].delete_many({})
    s.abort_transaction()
    assert db["c"].count_documents({}) == 2
    staged = s.start_transaction()
    staged["c"].delete_many({"_id": 2})
    db["c"].insert_one({"_id": 77, "a": 1})
    with pytest.raises(Conflict):
        s.commit_transaction()
    s.with_transaction(lambda t: t["c"].update_many({}, {"$set": {"a": 4}}))
    assert db["c"].count_documents({"a": 4}) == 3


def test_deadline(spark):
    from sparkdoc.sources.sessions import deadline

    with deadline(spark, 60_000):
        assert spark.range(5).count() == 5
    with pytest.raises(Exception, match="cancel"), deadline(spark, 300):
        spark.range(10**12).selectExpr("sum(hash(id))").collect()


def test_documents_without_schema(spark, tmp_path):
    from sparkdoc.sources.collection import Database
    from sparkdoc.sources.tables import documents_of

    (tmp_path / "x.json").write_text('{"a": {"b": 3}, "s": "x"}\n{"a": {"b": "text"}}\n{"a": 1.5}\n')
    c = Database(spark).register("v", documents_of(spark, str(tmp_path / "x.json")))
    assert c.count_documents({"doc.a.b": 3}) == 1 and c.count_documents({"doc.a.b": {"$gt": 2}}) == 1 and c.count_documents({"doc.s": "x"}) == 1
    assert [r.b for r in c.aggregate([{"$match": {"doc.s": "x"}}, {"$project": {"b": {"$toLong": "$doc.a.b"}}}]).collect()] == [3]
