"""Filter operators."""

from __future__ import annotations

import datetime
import re

from . import pipeline_query

D = datetime.datetime


def f(table: str, spec: dict, key: str, where: str) -> tuple:
    keys = key.split(",")
    return pipeline_query(table, [{"$match": spec}, {"$project": {"_id": 0} | dict.fromkeys(keys, 1)}]), f"SELECT {key} FROM {table} WHERE {where}"


#: Orders with their line numbers and quantities as arrays, and a nested object.
ARRAYS = [
    {"$group": {"_id": "$l_orderkey", "parts": {"$push": "$l_partkey"}, "nums": {"$push": "$l_linenumber"}, "lines": {"$push": {"n": "$l_linenumber", "q": "$l_quantity"}}}},
]
ARRAYS_SQL = "WITH a AS (SELECT l_orderkey AS _id, list(l_partkey) AS parts, list(l_linenumber) AS nums, list({'n': l_linenumber, 'q': l_quantity}) AS lines FROM lineitem GROUP BY 1)"


def a(spec: dict, where: str) -> tuple:
    return pipeline_query("lineitem", [*ARRAYS, {"$match": spec}, {"$project": {"_id": 1}}]), f"{ARRAYS_SQL} SELECT _id FROM a WHERE {where}"


QUERIES = {
    "match_all": f("nation", {}, "n_nationkey,n_name", "true"),
    "match_eq": f("orders", {"o_orderstatus": "F"}, "o_orderkey", "o_orderstatus = 'F'"),
    "match_ne": f("orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderkey", "o_orderstatus <> 'F'"),
    "match_gt": f("part", {"p_size": {"$gt": 30}}, "p_partkey", "p_size > 30"),
    "match_gte": f("part", {"p_size": {"$gte": 30}}, "p_partkey", "p_size >= 30"),
    "match_lt": f("part", {"p_retailprice": {"$lt": 1000.5}}, "p_partkey", "p_retailprice < 1000.5"),
    "match_lte": f("part", {"p_size": {"$lte": 10}}, "p_partkey", "p_size <= 10"),
    "match_range_dates": f("orders", {"o_orderdate": {"$gte": D(1995, 1, 1), "$lt": D(1996, 1, 1)}}, "o_orderkey", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "match_cross_type": f("part", {"p_name": {"$gt": 5}}, "p_partkey", "p_name IS NOT NULL"),
    "match_in": f("customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_custkey", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "match_in_mixed": f("customer", {"c_custkey": {"$in": [1, 2, None, "x"]}}, "c_custkey", "c_custkey IN (1, 2) OR c_custkey IS NULL"),
    "match_nin": f("customer", {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, "c_custkey", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "match_mod": f("orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey", "o_orderkey % 7 = 3"),
    "match_regex": f("part", {"p_name": {"$regex": "[0-9]+5$"}}, "p_partkey", "regexp_matches(p_name, '[0-9]+5$')"),
    "match_regex_options": f("part", {"p_type": {"$regex": "^promo", "$options": "i"}}, "p_partkey", "p_type ILIKE 'promo%'"),
    "match_regex_literal": f("customer", {"c_name": re.compile("00000001")}, "c_custkey", "contains(c_name, '00000001')"),
    "match_not": f("part", {"p_size": {"$not": {"$gt": 20}}}, "p_partkey", "NOT p_size > 20"),
    "match_exists": f("part", {"p_brand": {"$exists": True}, "nothing": {"$exists": False}}, "p_partkey", "p_brand IS NOT NULL"),
    "match_type": f("part", {"p_size": {"$type": "number"}, "p_name": {"$type": ["string", "null"]}}, "p_partkey", "true"),
    "match_bits_all_set": f("part", {"p_partkey": {"$bitsAllSet": 5}}, "p_partkey", "p_partkey & 5 = 5"),
    "match_bits_any_set": f("part", {"p_partkey": {"$bitsAnySet": [1, 3]}}, "p_partkey", "p_partkey & 10 <> 0"),
    "match_bits_all_clear": f("part", {"p_partkey": {"$bitsAllClear": 12}}, "p_partkey", "p_partkey & 12 = 0"),
    "match_bits_any_clear": f("part", {"p_partkey": {"$bitsAnyClear": [0, 1]}}, "p_partkey", "p_partkey & 3 <> 3"),
    "match_and": f("lineitem", {"$and": [{"l_quantity": {"$gt": 45}}, {"l_discount": {"$gte": 0.05}}]}, "l_orderkey,l_linenumber", "l_quantity > 45 AND l_discount >= 0.05"),
    "match_or": f("lineitem", {"$or": [{"l_returnflag": "A"}, {"l_linestatus": "O"}], "l_quantity": {"$lte": 3}}, "l_orderkey,l_linenumber", "(l_returnflag = 'A' OR l_linestatus = 'O') AND l_quantity <= 3"),
    "match_nor": f("customer", {"$nor": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, "c_custkey", "NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)"),
    "match_expr": f("lineitem", {"$expr": {"$gt": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, 5000]}}, "l_orderkey,l_linenumber", "l_extendedprice * l_discount > 5000"),
    "match_comment": f("region", {"$comment": "all of Asia", "r_name": "ASIA"}, "r_regionkey", "r_name = 'ASIA'"),
    "match_json_schema": f("customer", {"$jsonSchema": {"required": ["c_name"], "properties": {"c_acctbal": {"bsonType": "double", "minimum": 0, "maximum": 5000}, "c_name": {"pattern": "^Customer", "minLength": 3}, "c_mktsegment": {"enum": ["BUILDING", "HOUSEHOLD"]}}}}, "c_custkey", "c_acctbal BETWEEN 0 AND 5000 AND starts_with(c_name, 'Customer') AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')"),
    "match_where": f("part", {"$where": "this.p_size > 40 and this.p_partkey % 2 == 0"}, "p_partkey", "p_size > 40 AND p_partkey % 2 = 0"),
    "match_array_member": a({"nums": 7}, "list_contains(nums, 7)"),
    "match_array_comparison": a({"nums": {"$gt": 6}}, "list_max(nums) > 6"),
    "match_array_all": a({"nums": {"$all": [1, 5]}}, "list_contains(nums, 1) AND list_contains(nums, 5)"),
    "match_array_size": a({"nums": {"$size": 4}}, "len(nums) = 4"),
    "match_elem_match": a({"lines": {"$elemMatch": {"n": {"$lte": 2}, "q": {"$gt": 45}}}}, "len(list_filter(lines, lambda x: x.n <= 2 AND x.q > 45)) > 0"),
    "match_dotted_array": a({"lines.q": {"$gt": 49}}, "len(list_filter(lines, lambda x: x.q > 49)) > 0"),
    "match_geo_within_box": (
        pipeline_query("customer", [{"$project": {"k": "$c_custkey", "at": ["$c_acctbal", {"$toDouble": "$c_nationkey"}]}}, {"$match": {"at": {"$geoWithin": {"$box": [[0, 3], [4000, 12]]}}}}, {"$project": {"k": 1}}]),
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal BETWEEN 0 AND 4000 AND c_nationkey BETWEEN 3 AND 12",
    ),
    "match_geo_within_polygon": (
        pipeline_query("customer", [{"$project": {"k": "$c_custkey", "at": {"type": "Point", "coordinates": ["$c_acctbal", {"$toDouble": "$c_nationkey"}]}}}, {"$match": {"at": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0, 0], [5000, 0], [5000, 10], [0, 10], [0, 0]]]}}}}}, {"$project": {"k": 1}}]),
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 0 AND 10",
    ),
    "match_geo_intersects": (
        pipeline_query("nation", [{"$project": {"k": "$n_nationkey", "at": [{"$toDouble": "$n_nationkey"}, {"$toDouble": "$n_regionkey"}]}}, {"$match": {"at": {"$geoIntersects": {"$geometry": {"type": "LineString", "coordinates": [[0, 1], [20, 1]]}}}}}, {"$project": {"k": 1}}]),
        "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 AND n_nationkey BETWEEN 0 AND 20",
    ),
    "match_near": (
        pipeline_query("nation", [{"$project": {"k": "$n_nationkey", "at": [{"$toDouble": "$n_nationkey"}, {"$toDouble": "$n_regionkey"}]}}, {"$match": {"at": {"$near": {"$geometry": {"type": "Point", "coordinates": [10, 2]}, "$maxDistance": 5, "$minDistance": 1}}}}, {"$project": {"k": 1}}]),
        "SELECT n_nationkey AS k FROM nation WHERE sqrt((n_nationkey - 10) ** 2 + (n_regionkey - 2) ** 2) BETWEEN 1 AND 5",
    ),
    "match_near_sphere": (
        pipeline_query("nation", [{"$project": {"k": "$n_nationkey", "at": [{"$toDouble": "$n_nationkey"}, {"$toDouble": "$n_regionkey"}]}}, {"$match": {"at": {"$nearSphere": [4, 4], "$maxDistance": 3}}}, {"$project": {"k": 1}}]),
        "SELECT n_nationkey AS k FROM nation WHERE sqrt((n_nationkey - 4) ** 2 + (n_regionkey - 4) ** 2) <= 3",
    ),
}
