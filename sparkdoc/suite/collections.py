"""The collection API: find, updates, search, vectors, metadata and streams."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import updates
from ..operators.filters import compile_filter
from ..functions.core import Scope
from ..sources.collection import Collection, Database
from . import collection_query as c
from . import database


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir)["lineitem"].aggregate([{"$group": {"_id": "$l_orderkey", "nums": {"$push": "$l_linenumber"}}}, {"$project": {"nums": {"$sortArray": {"input": "$nums", "sortBy": 1}}}}])


LINES = "WITH o AS (SELECT l_orderkey AS _id, list(l_linenumber ORDER BY l_linenumber) AS nums FROM lineitem GROUP BY 1)"


def update_arrays(spec: dict, query: dict, sql: str, filters: list | None = None) -> tuple:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = orders_with_lines(spark, sf_dir)
        return updates.apply(df, compile_filter(query, Scope.of(df.schema)), spec, query, filters)

    return run, f"{LINES} SELECT _id, {sql} AS nums FROM o"


def update(table: str, columns: list[str], spec: dict, query: dict, sql: str) -> tuple:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = database(spark, sf_dir).tables[table].select(*columns)
        return updates.apply(df, compile_filter(query, Scope.of(df.schema)), spec, query)

    return run, sql


def text_query(body: dict, score: str = "searchScore") -> object:
    def use(docs: Collection) -> DataFrame:
        docs.create_search_index({"mappings": {"dynamic": False, "fields": {"text": {"type": "string"}}}}, "by_text")
        return docs.aggregate([{"$search": {"index": "by_text"} | body}, {"$project": {"doc_id": 1, "score": {"$round": [{"$meta": score}, 6]}}}])

    return c("documents", use)


TOKENS = "WITH d AS (SELECT doc_id, source, n_chars, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)"


def count_of(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


VECTOR = [0.1 if i % 2 else -0.05 for i in range(64)]
V_SQL = "[" + ", ".join(str(x) for x in VECTOR) + "]"


def vector(kind: str, more: dict | None = None) -> object:
    def use(v: Collection) -> DataFrame:
        v.create_search_index({"fields": [{"type": "vector", "path": "embedding", "numDimensions": 64, "similarity": kind}]}, "by_vector")
        return v.aggregate([{"$vectorSearch": {"index": "by_vector", "path": "embedding", "queryVector": VECTOR, "numCandidates": 50, "limit": 20} | (more or {})}, {"$project": {"vec_id": 1, "score": {"$round": [{"$meta": "vectorSearchScore"}, 5]}}}])

    return c("embeddings", use)


def vector_sql(score: str, where: str = "true") -> str:
    return f"SELECT vec_id, round({score}, 5) AS score FROM embeddings WHERE {where} ORDER BY {score} DESC, vec_id LIMIT 20"


def classic(docs: Collection) -> DataFrame:
    docs.create_index({"text": "text"})
    return docs.aggregate([{"$match": {"$text": {"$search": "thing -license"}}}, {"$project": {"doc_id": 1, "score": {"$meta": "textScore"}}}])


def stream_match_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless stream compiler over the events table, drained once."""
    from ..sources.tables import from_parquet
    from ..streaming.changes import transformed

    schema = from_parquet(spark, f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = transformed(events, [{"$match": {"value": {"$gt": 50}}}, {"$project": {"event_id": 1, "twice": {"$multiply": ["$value", 2]}}}], spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkdoc-")
    name = f"stream_{abs(hash(sf_dir)) % 10**8}"
    query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register("places", db["nation"].aggregate([{"$project": {"_id": "$n_nationkey", "at": [{"$toDouble": "$n_nationkey"}, {"$toDouble": "$n_regionkey"}]}}]))
    return db["places"].aggregate([{"$geoNear": {"near": [3, 1], "key": "at", "distanceField": "d", "maxDistance": 6, "query": {"_id": {"$ne": 3}}}}, {"$project": {"d": {"$round": ["$d", 6]}}}])


def dynamic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a schema: one variant column, paths resolved at run time."""
    db = database(spark, sf_dir)
    db.register("loose", db.tables["events"].selectExpr("event_id AS _id", "parse_json(props) AS doc"))
    return db["loose"].aggregate([{"$match": {"doc.k": {"$gte": 50}, "doc.none": None}}, {"$project": {"k": {"$toLong": "$doc.k"}}}])


def text_score_order(docs: Collection) -> DataFrame:
    docs.create_index({"text": "text"})
    return docs.aggregate([{"$match": {"$text": {"$search": "the thing"}}}, {"$sort": {"score": {"$meta": "textScore"}, "doc_id": 1}}, {"$limit": 15}, {"$project": {"doc_id": 1, "score": {"$meta": "textScore"}}}])


def weighted(docs: Collection) -> DataFrame:
    docs.create_index({"text": "text", "source": "text"}, weights={"text": 3})
    return docs.aggregate([{"$match": {"$text": {"$search": "thing src0"}}}, {"$project": {"doc_id": 1, "score": {"$meta": "textScore"}}}])


def written(work: object) -> object:
    """Events of writes to orders: operation, key and, but for deletes, the price after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = database(spark, sf_dir).tables["orders"]
        db, events = Database(spark), []
        orders = db.register("orders", source.select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_totalprice"))
        db.listeners.append(lambda name, event, rows: events.append(rows.select(F.lit(event).alias("operation"), "_id", rows["o_totalprice"].alias("price") if "o_totalprice" in rows.columns else F.lit(None).cast("double").alias("price"))))
        work(orders)
        return reduce(DataFrame.unionByName, events)

    return run


def after(work: object) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = database(spark, sf_dir).tables["orders"]
        orders = Database(spark).register("orders", source.select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_totalprice"))
        work(orders)
        return orders.find()

    return run


def merge_stage(found: str, missing: str) -> object:
    """Urgent orders merged into those that are not open."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = database(spark, sf_dir).tables["orders"]
        db = Database(spark)
        db.register("old", source.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("_id"), "o_totalprice", "o_orderstatus"))
        new = db.register("new", source.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("_id"), F.lit(1.5).alias("o_totalprice")))
        new.aggregate([{"$merge": {"into": "old", "whenMatched": found, "whenNotMatched": missing}}])
        return db["old"].find()

    return run


def merge_sql(price: str, status: str, where: str = "true") -> str:
    return f"WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT coalesce(a.k, b.k) AS _id, {price} AS o_totalprice, {status} AS o_orderstatus FROM a FULL JOIN b ON a.k = b.k WHERE {where}"


ORDERS = "SELECT o_orderkey AS _id, o_orderstatus, o_totalprice FROM orders"

QUERIES = {
    "write_events": (
        written(lambda o: (o.update_many({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "Q"}, "$inc": {"o_totalprice": 1}}), o.update_many({"o_orderstatus": "Q"}, {"$set": {"o_orderstatus": "Q"}}), o.delete_many({"o_totalprice": {"$lt": 50000}}))),
        "WITH u AS (SELECT o_orderkey AS _id, o_orderstatus AS s, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders) SELECT 'update' AS operation, _id, price FROM u WHERE s = 'P' UNION ALL SELECT 'delete', _id, NULL FROM u WHERE price < 50000",
    ),
    "write_upsert": (
        after(lambda o: o.update_one({"_id": -5, "o_orderstatus": "N"}, {"$set": {"o_totalprice": 2.5}, "$setOnInsert": {"o_orderstatus": "I"}}, upsert=True)),
        f"{ORDERS} UNION ALL SELECT -5, 'I', 2.5",
    ),
    "write_replace": (after(lambda o: o.replace_one({"o_orderstatus": "P"}, {"o_totalprice": 3.5}, sort=[("_id", 1)])), f"WITH f AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS _id, CASE WHEN o_orderkey <> k THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = k THEN 3.5 ELSE o_totalprice END AS o_totalprice FROM orders, f"),
    "write_delete": (after(lambda o: (o.delete_many({"o_totalprice": {"$gte": 100000}}), o.delete_one({"_id": {"$gte": 0}}))[0]), f"WITH r AS ({ORDERS} WHERE o_totalprice < 100000) SELECT * FROM r WHERE _id <> (SELECT min(_id) FROM r)"),
    "write_pipeline": (after(lambda o: o.update_many({"o_orderstatus": "F"}, [{"$set": {"o_totalprice": {"$multiply": ["$o_totalprice", 2]}}}, {"$unset": "o_orderstatus"}])), "SELECT o_orderkey AS _id, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "merge_stage_merge": (merge_stage("merge", "insert"), merge_sql("CASE WHEN b.k IS NOT NULL THEN 1.5 ELSE a.p END", "a.s")),
    "merge_stage_replace": (merge_stage("replace", "discard"), merge_sql("CASE WHEN b.k IS NOT NULL THEN 1.5 ELSE a.p END", "CASE WHEN b.k IS NULL THEN a.s END", "a.k IS NOT NULL")),
    "merge_stage_keep": (merge_stage("keepExisting", "insert"), merge_sql("coalesce(a.p, 1.5)", "a.s")),
    "text_weights": (c("documents", weighted), f"{TOKENS} SELECT doc_id, CAST(3 * {count_of('thing')} + 3 * {count_of('src0')} + CAST(source = 'src0' AS INTEGER) AS DOUBLE) AS score FROM d WHERE {count_of('thing')} + {count_of('src0')} > 0 OR source = 'src0'"),
    "search_phrase_slop": (
        text_query({"phrase": {"query": "in the", "path": "text", "slop": 1}}),
        f"{TOKENS} SELECT doc_id, round(n, 6) AS score FROM (SELECT doc_id, list_sum(list_transform(range(1, len(t)), lambda i: CASE WHEN t[i] <> 'in' THEN 0.0 WHEN t[i + 1] = 'the' THEN 1.0 WHEN i + 2 <= len(t) AND t[i + 2] = 'the' THEN 0.5 ELSE 0.0 END)) AS n FROM d) WHERE n > 0",
    ),
    "search_meta_threshold": (c("documents", lambda x: x.aggregate([{"$searchMeta": {"exists": {"path": "text"}, "count": {"type": "lowerBound", "threshold": 150}}}, {"$project": {"n": "$count.lowerBound", "capped": "$count.cappedByThreshold"}}])), "SELECT least(count(*), 150) AS n, count(*) > 150 AS capped FROM documents WHERE text IS NOT NULL"),
    "dynamic_match": (dynamic_match, "SELECT event_id AS _id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50"),
    "sort_text_score": (c("documents", text_score_order), f"{TOKENS} SELECT doc_id, CAST({count_of('thing')} + {count_of('the')} AS DOUBLE) AS score FROM d WHERE {count_of('thing')} + {count_of('the')} > 0 ORDER BY score DESC, doc_id LIMIT 15"),
    "find": (c("orders", lambda o: o.find({"o_orderstatus": "P"}, {"o_orderkey": 1, "o_totalprice": 1}, [("o_totalprice", -1), ("o_orderkey", 1)], skip=5, limit=30)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 5"),
    "find_collation": (c("part", lambda p: p.find({"p_brand": "brand#11"}, {"p_partkey": 1}, collation={"locale": "en", "strength": 2})), "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#11'"),
    "distinct": (c("customer", lambda x: x.distinct("c_mktsegment", {"c_acctbal": {"$gt": 0}})), "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal > 0"),
    "find_slice": (lambda s, d: database(s, d).register("o", orders_with_lines(s, d)).find({}, {"nums": {"$slice": 2}}), f"{LINES} SELECT _id, nums[1:2] AS nums FROM o"),
    "find_elem_match": (lambda s, d: database(s, d).register("o", orders_with_lines(s, d)).find({}, {"_id": 1, "nums": {"$elemMatch": {"$gte": 3}}}), f"{LINES} SELECT _id, list_filter(nums, lambda x: x >= 3)[1:1] AS nums FROM o"),
    "find_positional": (lambda s, d: database(s, d).register("o", orders_with_lines(s, d)).find({"nums": {"$gt": 2}}, {"nums.$": 1}), f"{LINES} SELECT _id, list_filter(nums, lambda x: x > 2)[1:1] AS nums FROM o WHERE list_max(nums) > 2"),
    "geo_near": (geo_near, "SELECT n_nationkey AS _id, round(sqrt((n_nationkey - 3) ** 2 + (n_regionkey - 1) ** 2), 6) AS d FROM nation WHERE n_nationkey <> 3 AND sqrt((n_nationkey - 3) ** 2 + (n_regionkey - 1) ** 2) <= 6"),
    "coll_stats": (c("orders", lambda o: o.aggregate([{"$collStats": {"count": {}}}, {"$project": {"count": 1}}])), "SELECT count(*) AS count FROM orders"),
    "index_stats": (c("orders", lambda o: (o.create_index("o_custkey"), o.aggregate([{"$indexStats": {}}, {"$project": {"name": 1}}]))[1]), "SELECT '_id_' AS name UNION ALL SELECT 'o_custkey_1'"),
    "current_op": (c("orders", lambda o: o.aggregate([{"$currentOp": {}}, {"$match": {"state": "none"}}, {"$count": "n"}])), "SELECT CAST(0 AS BIGINT) AS n"),
    "plan_cache_stats": (c("orders", lambda o: o.aggregate([{"$planCacheStats": {}}, {"$count": "n"}])), "SELECT CAST(0 AS BIGINT) AS n"),
    "list_sessions": (c("orders", lambda o: o.aggregate([{"$listSessions": {}}, {"$count": "n"}])), "SELECT CAST(1 AS BIGINT) AS n"),
    "update_set_inc": update("orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], {"$set": {"o_orderstatus": "X"}, "$inc": {"o_totalprice": 10}}, {"o_totalprice": {"$gt": 100000}}, "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "update_mul_min_max": update("part", ["p_partkey", "p_size", "p_retailprice"], {"$mul": {"p_size": 2}, "$max": {"p_retailprice": 1200.0}}, {"p_size": {"$lt": 20}}, "SELECT p_partkey, CASE WHEN p_size < 20 THEN p_size * 2 ELSE p_size END AS p_size, CASE WHEN p_size < 20 THEN greatest(p_retailprice, 1200.0) ELSE p_retailprice END AS p_retailprice FROM part"),
    "update_min_bit": update("part", ["p_partkey", "p_size", "p_retailprice"], {"$min": {"p_retailprice": 1200.0}, "$bit": {"p_size": {"and": 12}}}, {"p_size": {"$lt": 20}}, "SELECT p_partkey, CAST(CASE WHEN p_size < 20 THEN p_size & 12 ELSE p_size END AS INTEGER) AS p_size, CASE WHEN p_size < 20 THEN least(p_retailprice, 1200.0) ELSE p_retailprice END AS p_retailprice FROM part"),
    "update_unset": update("nation", ["n_nationkey", "n_name"], {"$unset": {"n_name": ""}}, {"n_nationkey": {"$lt": 5}}, "SELECT n_nationkey, CASE WHEN n_nationkey >= 5 THEN n_name END AS n_name FROM nation"),
    "update_rename": update("nation", ["n_nationkey", "n_name"], {"$rename": {"n_name": "name"}}, {}, "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS n_name, n_name AS name FROM nation"),
    "update_push": update_arrays({"$push": {"nums": {"$each": [9, 8], "$position": 1, "$slice": 4}}}, {"nums": 2}, "CASE WHEN list_contains(nums, 2) THEN list_concat(nums[1:1], [9, 8], nums[2:])[1:4] ELSE nums END"),
    "update_push_sort": update_arrays({"$push": {"nums": {"$each": [0], "$sort": -1}}}, {}, "list_reverse_sort(list_append(nums, 0))"),
    "update_add_to_set": update_arrays({"$addToSet": {"nums": {"$each": [1, 50]}}}, {}, "CASE WHEN list_contains(nums, 1) THEN list_append(nums, 50) ELSE list_concat(nums, [1, 50]) END"),
    "update_pull": update_arrays({"$pull": {"nums": {"$gt": 3}}}, {}, "list_filter(nums, lambda x: x <= 3)"),
    "update_pull_all": update_arrays({"$pullAll": {"nums": [1, 3]}}, {}, "list_filter(nums, lambda x: x NOT IN (1, 3))"),
    "update_pop": update_arrays({"$pop": {"nums": -1}}, {}, "nums[2:]"),
    "update_positional": update_arrays({"$set": {"nums.$": 77}}, {"nums": {"$gte": 3}}, "CASE WHEN list_max(nums) >= 3 THEN list_concat(list_filter(nums, lambda x: x < 3), [77], list_filter(nums, lambda x: x >= 3)[2:]) ELSE nums END"),
    "update_positional_all": update_arrays({"$inc": {"nums.$[]": 10}}, {}, "list_transform(nums, lambda x: x + 10)"),
    "update_array_filters": update_arrays({"$set": {"nums.$[n]": 0}}, {}, "list_transform(nums, lambda x: CASE WHEN x >= 4 THEN 0 ELSE x END)", [{"n": {"$gte": 4}}]),
    "search_text": (text_query({"text": {"query": "thing benchmark", "path": "text"}}), f"{TOKENS} SELECT doc_id, CAST({count_of('thing')} + {count_of('benchmark')} AS DOUBLE) AS score FROM d WHERE {count_of('thing')} + {count_of('benchmark')} > 0"),
    "search_phrase": (text_query({"phrase": {"query": "in the", "path": "text"}}), f"{TOKENS} SELECT doc_id, CAST(n AS DOUBLE) AS score FROM (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'in' AND t[i + 1] = 'the')) AS n FROM d) WHERE n > 0"),
    "search_autocomplete": (text_query({"autocomplete": {"query": "licens", "path": "text"}}), f"{TOKENS} SELECT doc_id, CAST(n AS DOUBLE) AS score FROM (SELECT doc_id, len(list_filter(t, lambda x: starts_with(x, 'licens'))) AS n FROM d) WHERE n > 0"),
    "search_wildcard": (text_query({"wildcard": {"query": "*license*", "path": "text"}}), "SELECT doc_id, 1.0 AS score FROM documents WHERE contains(lower(text), 'license')"),
    "search_regex": (text_query({"regex": {"query": "Licensed under [A-Z]", "path": "text"}}), "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE regexp_matches(text, 'Licensed under [A-Z]')"),
    "search_exists": (text_query({"exists": {"path": "text"}}), "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL"),
    "search_in_equals": (text_query({"compound": {"must": [{"in": {"path": "lang", "value": ["de", "fr"]}}], "filter": [{"equals": {"path": "source", "value": "src0"}}]}}), "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE lang IN ('de', 'fr') AND source = 'src0'"),
    "search_range": (text_query({"range": {"path": "n_chars", "gte": 100, "lt": 1000}}), "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE n_chars >= 100 AND n_chars < 1000"),
    "search_near": (text_query({"near": {"path": "n_chars", "origin": 1000, "pivot": 200}}), "SELECT doc_id, round(1 + 1 / (1 + abs(n_chars - 1000) / 200), 6) AS score FROM documents WHERE abs(n_chars - 1000) <= 200"),
    "search_compound": (text_query({"compound": {"must": [{"text": {"query": "the", "path": "text"}}], "mustNot": [{"text": {"query": "license", "path": "text"}}], "should": [{"text": {"query": "thing", "path": "text"}}, {"range": {"path": "n_chars", "lt": 2000}}]}}), f"{TOKENS} SELECT doc_id, CAST(1 + {count_of('thing')} + CAST({count_of('thing')} > 0 AS INTEGER) + 2 * CAST(n_chars < 2000 AS INTEGER) AS DOUBLE) AS score FROM d WHERE {count_of('the')} > 0 AND {count_of('license')} = 0"),
    "search_meta": (c("documents", lambda x: x.aggregate([{"$searchMeta": {"exists": {"path": "text"}, "count": {"type": "total"}}}, {"$project": {"n": "$count.total"}}])), "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL"),
    "search_facet": (c("documents", lambda x: x.aggregate([{"$searchMeta": {"facet": {"operator": {"exists": {"path": "text"}}, "facets": {"langs": {"type": "string", "path": "lang"}}}, "count": {"type": "total"}}}, {"$project": {"b": "$facet.langs.buckets"}}, {"$unwind": "$b"}, {"$replaceRoot": {"newRoot": "$b"}}])), "SELECT lang AS _id, count(*) AS count FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1"),
    "search_highlight": (c("documents", lambda x: x.aggregate([{"$search": {"text": {"query": "license", "path": "text"}, "highlight": {"path": "text"}}}, {"$project": {"doc_id": 1, "n": {"$size": {"$meta": "searchHighlights"}}}}])), f"{TOKENS} SELECT doc_id, CAST(1 AS BIGINT) AS n FROM d WHERE {count_of('license')} > 0"),
    "classic_text": (c("documents", classic), f"{TOKENS} SELECT doc_id, CAST({count_of('thing')} AS DOUBLE) AS score FROM d WHERE {count_of('thing')} > 0 AND {count_of('license')} = 0"),
    "vector_cosine": (vector("cosine"), vector_sql(f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {V_SQL}::DOUBLE[])")),
    "vector_dot": (vector("dotProduct"), vector_sql(f"list_inner_product(CAST(embedding AS DOUBLE[]), {V_SQL}::DOUBLE[])")),
    "vector_euclidean": (vector("euclidean"), vector_sql(f"-list_distance(CAST(embedding AS DOUBLE[]), {V_SQL}::DOUBLE[])")),
    "vector_filtered": (vector("cosine", {"filter": {"label": {"$in": [1, 2]}}}), vector_sql(f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {V_SQL}::DOUBLE[])", "label IN (1, 2)")),
    "stream_match_project": (stream_match_project, "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50"),
}

