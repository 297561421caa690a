"""`$lookup` in all its forms, `$unionWith` and `$merge`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.collection import merged
from . import database
from . import pipeline_query as q

NATION = {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}


def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    old = db["nation"].aggregate([{"$match": {"n_nationkey": {"$lt": 15}}}, {"$project": {"_id": "$n_nationkey", "name": "$n_name", "n": {"$literal": 0}}}])
    new = db["customer"].aggregate([{"$match": {"c_nationkey": {"$gte": 5}}}, {"$group": {"_id": "$c_nationkey", "n": {"$sum": 1}}}])
    return merged(old, new)


QUERIES = {
    "lookup_equi": (q("nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$c"}, "top": {"$max": "$c.c_custkey"}}}]), "SELECT n_nationkey, count(c_custkey) AS n, max(c_custkey) AS top FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1"),
    "lookup_unwind": (q("customer", [{"$lookup": NATION}, {"$unwind": "$n"}, {"$project": {"c_custkey": 1, "name": "$n.n_name"}}]), "SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "lookup_unwind_preserve": (q("customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "k": "$o.o_orderkey"}}]), "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "lookup_semi": (q("customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$project": {"c_custkey": 1}}]), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "lookup_anti": (q("customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_custkey": 1}}]), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "lookup_pipeline_uncorrelated": (q("region", [{"$lookup": {"from": "nation", "pipeline": [{"$group": {"_id": None, "n": {"$sum": 1}}}], "as": "x"}}, {"$project": {"r_name": 1, "n": {"$first": "$x.n"}}}]), "SELECT r_name, (SELECT count(*) FROM nation) AS n FROM region"),
    "lookup_let_equality": (q("nation", [{"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$k"]}, {"$gt": ["$s_acctbal", 0]}]}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}], "as": "s"}}, {"$project": {"n_nationkey": 1, "n": {"$ifNull": [{"$first": "$s.n"}, 0]}}}]), "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1"),
    "lookup_let_theta": (q("region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$n_regionkey", "$$r"]}}}], "as": "x"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$x"}}}]), "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey < r_regionkey GROUP BY 1"),
    "lookup_let_top": (q("nation", [{"$lookup": {"from": "customer", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$k"]}}}, {"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$limit": 2}, {"$project": {"c_custkey": 1}}], "as": "c"}}, {"$project": {"n_nationkey": 1, "c": "$c.c_custkey"}}]), "SELECT n_nationkey, coalesce((list(c_custkey ORDER BY c_acctbal DESC, c_custkey) FILTER (c_custkey IS NOT NULL))[1:2], []) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "lookup_both": (q("nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "pipeline": [{"$match": {"c_mktsegment": "BUILDING"}}, {"$count": "n"}], "as": "c"}}, {"$project": {"n_nationkey": 1, "n": {"$first": "$c.n"}}}]), "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1"),
    "lookup_let_count": (q("part", [{"$lookup": {"from": "nation", "let": {"k": "$p_size"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$n_nationkey", "$$k"]}}}, {"$count": "n"}], "as": "x"}}, {"$project": {"p_partkey": 1, "n": {"$first": "$x.n"}}}]), "SELECT p_partkey, count(n_nationkey) AS n FROM part LEFT JOIN nation ON n_nationkey = p_size GROUP BY 1"),
    "lookup_window": (q("region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "pipeline": [{"$setWindowFields": {"sortBy": {"n_nationkey": 1}, "output": {"i": {"$documentNumber": {}}}}}, {"$match": {"i": {"$lte": 2}}}, {"$project": {"n_nationkey": 1}}], "as": "n"}}, {"$project": {"r_regionkey": 1, "s": {"$sum": "$n.n_nationkey"}}}]), "SELECT n_regionkey AS r_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 2 GROUP BY 1"),
    "lookup_array_local": (q("orders", [{"$group": {"_id": "$o_custkey", "prios": {"$addToSet": {"$mod": ["$o_orderkey", 5]}}}}, {"$lookup": {"from": "region", "localField": "prios", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"_id": 1, "n": {"$size": "$r"}}}]), "SELECT o_custkey AS _id, count(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1"),
    "lookup_nested": (q("region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "pipeline": [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$project": {"m": {"$size": "$c"}}}], "as": "n"}}, {"$project": {"r_name": 1, "n": {"$sum": "$n.m"}}}]), "SELECT r_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "join_revenue_by_nation": (q("lineitem", [{"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}}, {"$unwind": "$o"}, {"$lookup": {"from": "customer", "localField": "o.o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_nationkey", "rev": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}}, {"$project": {"rev": {"$round": ["$rev", 2]}}}]), "SELECT c_nationkey AS _id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "union_with": (q("customer", [{"$project": {"k": "$c_custkey", "n": "$c_name"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"k": "$s_suppkey", "n": "$s_name"}}]}}]), "SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "union_with_other_fields": (q("region", [{"$unionWith": "nation"}, {"$project": {"r_name": 1, "n_name": 1}}]), "SELECT r_name, NULL AS n_name FROM region UNION ALL SELECT NULL, n_name FROM nation"),
    "merge_into": (merge_query, "WITH a AS (SELECT n_nationkey AS _id, n_name AS name FROM nation WHERE n_nationkey < 15), b AS (SELECT c_nationkey AS _id, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY 1) SELECT coalesce(a._id, b._id) AS _id, name, coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a._id = b._id"),
}
