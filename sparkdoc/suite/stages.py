"""Pipeline stages."""

from __future__ import annotations

import datetime

from . import pipeline_query as q
from .filters import ARRAYS

D = datetime.datetime

HOURS = [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", "unit": "hour"}}, "v": {"$max": "$event_id"}}}]
HOURS_SQL = "h AS (SELECT date_trunc('hour', ts) AS _id, max(event_id) AS v FROM events GROUP BY 1)"
#: Every third value of v is null.
HOLES = [{"$project": {"id": "$event_id", "g": {"$mod": ["$event_id", 4]}, "v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$event_id", None]}}}]
HOLES_SQL = "WITH e AS (SELECT event_id AS id, event_id % 4 AS g, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events)"

QUERIES = {
    "project_fields": (q("nation", [{"$project": {"n_name": 1, "n_regionkey": 1}}]), "SELECT n_name, n_regionkey FROM nation"),
    "project_exclude": (q("nation", [{"$project": {"n_name": 0}}]), "SELECT n_nationkey, n_regionkey FROM nation"),
    "project_computed": (q("lineitem", [{"$project": {"k": "$l_orderkey", "n": "$l_linenumber", "net": {"$round": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, 4]}}}]), "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"),
    "project_nested": (q("nation", [{"$project": {"o": {"name": "$n_name", "in": {"r": "$n_regionkey"}}}}, {"$project": {"a": "$o.name", "r": "$o.in.r"}}]), "SELECT n_name AS a, n_regionkey AS r FROM nation"),
    "project_remove": (q("nation", [{"$project": {"n_name": 1, "x": "$$REMOVE"}}]), "SELECT n_name FROM nation"),
    "add_fields": (q("part", [{"$addFields": {"dear": {"$gt": ["$p_retailprice", 1500]}, "p_size": {"$add": ["$p_size", 1]}}}, {"$project": {"p_partkey": 1, "dear": 1, "p_size": 1}}]), "SELECT p_partkey, p_retailprice > 1500 AS dear, CAST(p_size + 1 AS BIGINT) AS p_size FROM part"),
    "set_nested": (q("nation", [{"$set": {"o.a": "$n_name"}}, {"$set": {"o.b": "$n_regionkey"}}, {"$project": {"x": "$o.a", "y": "$o.b"}}]), "SELECT n_name AS x, n_regionkey AS y FROM nation"),
    "unset": (q("customer", [{"$unset": ["c_name", "c_acctbal"]}]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "unset_nested": (q("nation", [{"$project": {"o": {"a": "$n_name", "b": "$n_regionkey"}}}, {"$unset": "o.a"}, {"$replaceRoot": {"newRoot": "$o"}}]), "SELECT n_regionkey AS b FROM nation"),
    "replace_root": (q("nation", [{"$replaceRoot": {"newRoot": {"name": "$n_name", "r": "$n_regionkey"}}}]), "SELECT n_name AS name, n_regionkey AS r FROM nation"),
    "replace_with": (q("region", [{"$replaceWith": {"k": "$r_regionkey"}}]), "SELECT r_regionkey AS k FROM region"),
    "redact": (q("customer", [{"$redact": {"$cond": [{"$gt": ["$c_acctbal", 9000]}, "$$KEEP", "$$PRUNE"]}}, {"$project": {"c_custkey": 1}}]), "SELECT c_custkey FROM customer WHERE c_acctbal > 9000"),
    "redact_descend": (q("nation", [{"$project": {"n_nationkey": 1, "level": {"$literal": 1}, "o": {"level": "$n_regionkey", "name": "$n_name"}}}, {"$redact": {"$cond": [{"$lte": ["$level", 2]}, "$$DESCEND", "$$PRUNE"]}}, {"$project": {"n_nationkey": 1, "name": "$o.name"}}]), "SELECT n_nationkey, CASE WHEN n_regionkey <= 2 THEN n_name END AS name FROM nation"),
    "unwind": (q("lineitem", [*ARRAYS, {"$unwind": "$nums"}, {"$project": {"_id": 1, "nums": 1}}]), "SELECT l_orderkey AS _id, l_linenumber AS nums FROM lineitem"),
    "unwind_index": (q("nation", [{"$project": {"k": "$n_nationkey", "a": {"$range": [0, "$n_regionkey"]}}}, {"$unwind": {"path": "$a", "includeArrayIndex": "i"}}]), "SELECT n_nationkey AS k, unnest(range(n_regionkey)) AS a, unnest(range(n_regionkey)) AS i FROM nation"),
    "unwind_preserve": (q("nation", [{"$project": {"k": "$n_nationkey", "a": {"$range": [0, "$n_regionkey"]}}}, {"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True}}]), "SELECT n_nationkey AS k, a FROM nation LEFT JOIN (SELECT n_nationkey AS j, unnest(range(n_regionkey)) AS a FROM nation) ON j = n_nationkey"),
    "unwind_scalar": (q("region", [{"$unwind": {"path": "$r_name", "includeArrayIndex": "i"}}]), "SELECT r_regionkey, r_name, CAST(NULL AS BIGINT) AS i FROM region"),
    "sort_limit": (q("orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 25}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "sort_skip_limit": (q("orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": -1}}, {"$skip": 40}, {"$limit": 20}, {"$project": {"o_orderkey": 1}}]), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 20 OFFSET 40"),
    "skip": (q("nation", [{"$sort": {"n_nationkey": 1}}, {"$skip": 20}, {"$project": {"n_nationkey": 1}}]), "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "limit_zero": (q("nation", [{"$limit": 0}, {"$project": {"n_nationkey": 1}}]), "SELECT n_nationkey FROM nation LIMIT 0"),
    "sample": (q("orders", [{"$sample": {"size": 50}}, {"$count": "n"}]), "SELECT CAST(50 AS BIGINT) AS n"),
    "count": (q("lineitem", [{"$match": {"l_returnflag": "R"}}, {"$count": "n"}]), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "count_empty": (q("lineitem", [{"$match": {"l_returnflag": "none"}}, {"$count": "n"}]), "SELECT CAST(0 AS BIGINT) AS n"),
    "sort_by_count": (q("customer", [{"$sortByCount": "$c_mktsegment"}]), "SELECT c_mktsegment AS _id, count(*) AS count FROM customer GROUP BY 1"),
    "bucket": (q("part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 40], "default": 99, "output": {"n": {"$sum": 1}, "top": {"$max": "$p_retailprice"}}}}]), "WITH b(_id, lo, hi) AS (VALUES (0, 0, 10), (10, 10, 20), (20, 20, 40), (99, 40, 1000)) SELECT CAST(_id AS BIGINT) AS _id, count(p_partkey) AS n, max(p_retailprice) AS top FROM b LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY 1"),
    "bucket_empty": (q("part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [-10, 0, 100]}}]), "SELECT CAST(-10 AS BIGINT) AS _id, CAST(0 AS BIGINT) AS count UNION ALL SELECT 0, count(*) FROM part"),
    "bucket_auto": (q("part", [{"$bucketAuto": {"groupBy": "$p_partkey", "buckets": 7}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "count": 1}}]), "WITH t AS (SELECT p_partkey AS k, ntile(7) OVER (ORDER BY p_partkey) AS b FROM part), g AS (SELECT b, min(k) AS lo, max(k) AS top, count(*) AS n FROM t GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), top) AS hi, n AS count FROM g"),
    "facet": (q("orders", [{"$facet": {"f": [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "dear": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}, {"$project": {"o_orderkey": 1}}]}}, {"$project": {"f": {"$first": "$f.n"}, "a": {"$arrayElemAt": ["$dear.o_orderkey", 0]}, "c": {"$arrayElemAt": ["$dear.o_orderkey", 2]}}}]), "WITH d AS (SELECT list(o_orderkey) AS l FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)) SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, l[1] AS a, l[3] AS c FROM d"),
    "documents": (q("region", [{"$documents": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}]), "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b UNION ALL SELECT 2, NULL"),
    "densify_numeric": (q("nation", [{"$match": {"n_nationkey": {"$in": [2, 5, 11]}}}, {"$project": {"n_nationkey": 1, "n_name": 1}}, {"$densify": {"field": "n_nationkey", "range": {"step": 3, "bounds": "full"}}}]), "SELECT CAST(g AS BIGINT) AS n_nationkey, n_name FROM generate_series(2, 11, 3) t(g) LEFT JOIN nation ON n_nationkey = g AND n_nationkey IN (2, 5, 11)"),
    "densify_date": (q("events", [*HOURS, {"$densify": {"field": "_id", "range": {"step": 1, "unit": "hour", "bounds": "full"}}}]), f"WITH {HOURS_SQL}, g AS (SELECT unnest(generate_series((SELECT min(_id) FROM h), (SELECT max(_id) FROM h), INTERVAL 1 HOUR)) AS t) SELECT t AS _id, v FROM g LEFT JOIN h ON _id = t"),
    "densify_partitions": (q("nation", [{"$match": {"n_regionkey": {"$lte": 1}, "n_nationkey": {"$lt": 6}}}, {"$project": {"n_nationkey": 1, "n_regionkey": 1, "n_name": 1}}, {"$densify": {"field": "n_nationkey", "partitionByFields": ["n_regionkey"], "range": {"step": 1, "bounds": [0, 6]}}}]), "WITH n AS (SELECT * FROM nation WHERE n_regionkey <= 1 AND n_nationkey < 6), r AS (SELECT DISTINCT n_regionkey AS r FROM n) SELECT CAST(g AS BIGINT) AS n_nationkey, r AS n_regionkey, n_name FROM r CROSS JOIN generate_series(0, 6, 1) t(g) LEFT JOIN n ON n_nationkey = g AND n_regionkey = r"),
    "fill_value": (q("events", [*HOLES, {"$fill": {"sortBy": {"id": 1}, "output": {"v": {"value": -1}}}}]), f"{HOLES_SQL} SELECT id, g, coalesce(v, -1) AS v FROM e"),
    "fill_locf": (q("events", [*HOLES, {"$fill": {"sortBy": {"id": 1}, "partitionByFields": ["g"], "output": {"v": {"method": "locf"}}}}]), f"{HOLES_SQL} SELECT id, g, last_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY id ROWS UNBOUNDED PRECEDING) AS v FROM e"),
    "fill_linear": (q("events", [*HOLES, {"$fill": {"sortBy": {"id": 1}, "output": {"v": {"method": "linear"}}}}, {"$project": {"id": 1, "g": 1, "v": {"$round": ["$v", 6]}}}]), f"{HOLES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM e), w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS n0, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1, last_value(v IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS v0, first_value(v IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM r) SELECT id, g, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (n - n0) / (n1 - n0) END, 6) AS v FROM w"),
}
