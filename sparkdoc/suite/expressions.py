"""Expression operators, by family: one query computes several of them."""

from __future__ import annotations

import datetime
from typing import Any

from . import pipeline_query

D = datetime.datetime


def e(table: str, key: str, *pairs: tuple[Any, str], where: dict | None = None, sql_where: str = "true") -> tuple:
    """Pairs of (expression, SQL)."""
    pipeline = [*([{"$match": where}] if where else []), {"$project": {"_id": 0, "k": "$" + key} | {f"x{i}": x for i, (x, _) in enumerate(pairs)}}]
    sql = f"SELECT {key} AS k, " + ", ".join(f"{s} AS x{i}" for i, (_, s) in enumerate(pairs)) + f" FROM {table} WHERE {sql_where}"
    return pipeline_query(table, pipeline), sql


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def r(x: Any, places: int = 6) -> dict:
    return {"$round": [x, places]}


P, N, O, T = "$p_partkey", "$p_name", "$p_size", "$ts"
#: An array of an order's line numbers, by way of the part's size.
A = {"$range": [0, {"$mod": ["$p_size", 7]}]}
A_SQL = "range(p_size % 7)"

QUERIES = {
    "expr_add_subtract": e("part", "p_partkey", ({"$add": [O, P, 1]}, big("p_size + p_partkey + 1")), ({"$subtract": [P, O]}, big("p_partkey - p_size")), (r({"$add": [O, 0.5]}, 2), "CAST(p_size + 0.5 AS DOUBLE)")),
    "expr_multiply_divide": e("part", "p_partkey", ({"$multiply": [O, 3]}, big("p_size * 3")), (r({"$divide": [P, 7]}), "round(p_partkey / 7, 6)"), ({"$mod": [P, 7]}, "p_partkey % 7"), ({"$mod": [{"$multiply": [P, -1]}, 7]}, "-p_partkey % 7")),
    "expr_abs_exp_log": e("part", "p_partkey", ({"$abs": {"$subtract": [O, 25]}}, big("abs(p_size - 25)")), (r({"$exp": {"$divide": [O, 50]}}), "round(exp(p_size / 50), 6)"), (r({"$ln": O}), "round(ln(p_size), 6)"), (r({"$log": [O, 3]}), "round(ln(p_size) / ln(3), 6)"), (r({"$log10": O}), "round(log10(p_size), 6)"), (r({"$sqrt": O}), "round(sqrt(p_size), 6)"), (r({"$pow": [O, 2]}), "CAST(p_size ** 2 AS DOUBLE)")),
    "expr_round_trunc": e("part", "p_partkey", ({"$round": [{"$divide": [P, 2]}, 0]}, big("round_even(p_partkey / 2, 0)")), ({"$round": ["$p_retailprice", 1]}, "round_even(p_retailprice, 1)"), ({"$trunc": ["$p_retailprice", 0]}, big("trunc(p_retailprice)")), ({"$floor": "$p_retailprice"}, big("floor(p_retailprice)")), ({"$ceil": "$p_retailprice"}, big("ceil(p_retailprice)")), ({"$round": [P, -1]}, big("round_even(p_partkey / 10, 0) * 10"))),
    "expr_list_statistics": e("part", "p_partkey", ({"$sum": [O, P, "x"]}, big("p_size + p_partkey")), (r({"$avg": [O, P]}), "round((p_size + p_partkey) / 2, 6)"), ({"$min": [O, 25]}, big("least(p_size, 25)")), ({"$max": [O, 25]}, big("greatest(p_size, 25)")), (r({"$stdDevPop": [O, P]}), "round(abs(p_size - p_partkey) / 2, 6)"), (r({"$stdDevSamp": [O, P]}), "round(abs(p_size - p_partkey) / sqrt(2), 6)"), ({"$median": {"input": [O, P, 25], "method": "approximate"}}, big("list_sort([p_size, p_partkey, 25])[2]")), ({"$percentile": {"input": [O, P, 25], "p": [0.1, 1], "method": "approximate"}}, "[least(p_size, p_partkey, 25), greatest(p_size, p_partkey, 25)]")),
    "expr_array_statistics": e("part", "p_partkey", ({"$sum": A}, big(f"coalesce(list_sum({A_SQL}), 0)")), ({"$max": A}, f"list_max({A_SQL})"), ({"$min": A}, f"list_min({A_SQL})"), (r({"$avg": A}), f"round(list_avg({A_SQL}), 6)")),
    "expr_bits": e("part", "p_partkey", ({"$bitAnd": [P, 12]}, "p_partkey & 12"), ({"$bitOr": [P, 12]}, "p_partkey | 12"), ({"$bitXor": [P, 12]}, "xor(p_partkey, 12)"), ({"$bitNot": P}, "~p_partkey")),
    "expr_rand": (pipeline_query("region", [{"$project": {"k": "$r_regionkey", "x": {"$let": {"vars": {"v": {"$rand": {}}}, "in": {"$and": [{"$gte": ["$$v", 0]}, {"$lt": ["$$v", 1]}]}}}}}]), "SELECT r_regionkey AS k, true AS x FROM region"),
    "expr_compare": e("part", "p_partkey", ({"$eq": [O, 10]}, "p_size = 10"), ({"$ne": [O, 10]}, "p_size <> 10"), ({"$gt": [O, 10]}, "p_size > 10"), ({"$gte": [O, 10]}, "p_size >= 10"), ({"$lt": [O, 10]}, "p_size < 10"), ({"$lte": [O, 10]}, "p_size <= 10"), ({"$cmp": [O, 10]}, big("sign(p_size - 10)")), ({"$gt": [N, O]}, "true"), ({"$gt": [O, None]}, "true")),
    "expr_logic": e("part", "p_partkey", ({"$and": [{"$gt": [O, 10]}, {"$lt": [P, 100]}]}, "p_size > 10 AND p_partkey < 100"), ({"$or": [{"$gt": [O, 40]}, {"$mod": [P, 2]}]}, "p_size > 40 OR p_partkey % 2 <> 0"), ({"$in": [O, [1, 2, 3]]}, "p_size IN (1, 2, 3)"), ({"$nin": ["$p_size", [1, 2]]}, "p_size NOT IN (1, 2)"), ({"$exists": ["$p_size", True]}, "true")),
    "expr_conditions": e("part", "p_partkey", ({"$cond": [{"$gt": [O, 25]}, "big", "small"]}, "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"), ({"$cond": {"if": O, "then": 1, "else": 0}}, big("1")), ({"$ifNull": ["$none", O]}, "p_size"), ({"$switch": {"branches": [{"case": {"$lt": [O, 10]}, "then": 1}, {"case": {"$lt": [O, 30]}, "then": 2}], "default": 3}}, big("CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END")), ({"$let": {"vars": {"a": O, "b": 2}, "in": {"$multiply": ["$$a", "$$b"]}}}, big("p_size * 2")), ({"$literal": "$x"}, "'$x'")),
    "expr_strings": e("part", "p_partkey", ({"$concat": [N, "-", "$p_brand"]}, "p_name || '-' || p_brand"), ({"$toUpper": N}, "upper(p_name)"), ({"$toLower": "$p_type"}, "lower(p_type)"), ({"$strLenCP": N}, "length(p_name)"), ({"$strLenBytes": N}, big("strlen(p_name)")), ({"$substrCP": [N, 1, 3]}, "substr(p_name, 2, 3)"), ({"$substrBytes": [N, 2, -1]}, "substr(p_name, 3)"), ({"$strcasecmp": [N, "Part#0000001"]}, big("CASE WHEN lower(p_name) < 'part#0000001' THEN -1 WHEN lower(p_name) > 'part#0000001' THEN 1 ELSE 0 END"))),
    "expr_string_search": e("part", "p_partkey", ({"$indexOfCP": [N, "0"]}, big("instr(p_name, '0') - 1")), ({"$indexOfBytes": [N, "1"]}, big("instr(p_name, '1') - 1")), ({"$split": ["$p_type", " "]}, "string_split(p_type, ' ')"), ({"$replaceOne": {"input": N, "find": "0", "replacement": "o"}}, "CASE WHEN instr(p_name, '0') > 0 THEN substr(p_name, 1, instr(p_name, '0') - 1) || 'o' || substr(p_name, instr(p_name, '0') + 1) ELSE p_name END"), ({"$replaceAll": {"input": N, "find": "0", "replacement": "oo"}}, "replace(p_name, '0', 'oo')"), ({"$trim": {"input": {"$concat": ["  ", N, " "]}}}, "p_name"), ({"$ltrim": {"input": {"$concat": ["xx", N]}, "chars": "x"}}, "ltrim('xx' || p_name, 'x')"), ({"$rtrim": {"input": {"$concat": [N, "yy"]}, "chars": "y"}}, "rtrim(p_name || 'yy', 'y')")),
    "expr_regex": e("part", "p_partkey", ({"$regexMatch": {"input": N, "regex": "[13]$"}}, "regexp_matches(p_name, '[13]$')"), ({"$getField": {"field": "match", "input": {"$regexFind": {"input": N, "regex": "[1-9]+"}}}}, "nullif(regexp_extract(p_name, '[1-9]+'), '')"), ({"$map": {"input": {"$regexFindAll": {"input": N, "regex": "[0-9]"}}, "as": "m", "in": "$$m.match"}}, "regexp_extract_all(p_name, '[0-9]')")),
    "expr_arrays": e("part", "p_partkey", ({"$size": A}, big(f"len({A_SQL})")), ({"$arrayElemAt": [A, 1]}, f"{A_SQL}[2]"), ({"$arrayElemAt": [A, -1]}, f"{A_SQL}[-1]"), ({"$first": A}, f"{A_SQL}[1]"), ({"$firstN": {"input": A, "n": 2}}, f"{A_SQL}[1:2]"), ({"$lastN": {"input": A, "n": 2}}, f"{A_SQL}[-2:]"), ({"$maxN": {"input": A, "n": 2}}, f"list_reverse_sort({A_SQL})[1:2]"), ({"$minN": {"input": A, "n": 2}}, f"{A_SQL}[1:2]"), ({"$slice": [A, 1, 2]}, f"{A_SQL}[2:3]"), ({"$slice": [A, -2]}, f"{A_SQL}[-2:]"), ({"$concatArrays": [A, [9]]}, f"list_concat({A_SQL}, [9])"), ({"$reverseArray": A}, f"list_reverse({A_SQL})"), ({"$isArray": [A]}, "true"), ({"$isArray": [O]}, "false"), ({"$indexOfArray": [A, 3]}, big(f"coalesce(list_position({A_SQL}, 3), 0) - 1")), ({"$in": [2, A]}, f"list_contains({A_SQL}, 2)")),
    "expr_higher_order": e("part", "p_partkey", ({"$map": {"input": A, "as": "v", "in": {"$multiply": ["$$v", 2]}}}, f"list_transform({A_SQL}, lambda v: v * 2)"), ({"$filter": {"input": A, "cond": {"$gt": ["$$this", 2]}}}, f"list_filter({A_SQL}, lambda v: v > 2)"), ({"$reduce": {"input": A, "initialValue": 100, "in": {"$add": ["$$value", "$$this"]}}}, big(f"100 + coalesce(list_sum({A_SQL}), 0)")), ({"$sortArray": {"input": A, "sortBy": -1}}, f"list_reverse_sort({A_SQL})"), ({"$map": {"input": {"$zip": {"inputs": [A, A]}}, "in": {"$sum": "$$this"}}}, f"list_transform({A_SQL}, lambda v: v * 2)"), ({"$allElementsTrue": [A]}, "p_size % 7 = 0"), ({"$anyElementTrue": [A]}, "p_size % 7 > 1"), ({"$range": [10, 0, -4]}, "range(10, 0, -4)")),
    "expr_sets": e("part", "p_partkey", ({"$setUnion": [A, [2, 50]]}, f"CASE WHEN p_size % 7 > 2 THEN list_concat({A_SQL}, [50]) ELSE list_concat({A_SQL}, [2, 50]) END"), ({"$setIntersection": [A, [2, 3]]}, f"list_filter({A_SQL}, lambda v: v IN (2, 3))"), ({"$setDifference": [A, [2, 3]]}, f"list_filter({A_SQL}, lambda v: v NOT IN (2, 3))"), ({"$setEquals": [A, [0, 1]]}, "p_size % 7 = 2"), ({"$setIsSubset": [[0, 1], A]}, "p_size % 7 >= 2")),
    "expr_objects": e("part", "p_partkey", ({"$getField": {"field": "b", "input": {"$mergeObjects": [{"a": O, "b": 1}, {"b": P}]}}}, "p_partkey"), ({"$getField": {"field": "z", "input": {"$setField": {"field": "z", "input": {"a": O}, "value": N}}}}, "p_name"), ({"$map": {"input": {"$objectToArray": {"a": O, "b": P}}, "in": "$$this.k"}}, "['a', 'b']"), ({"$size": {"$objectToArray": {"$unsetField": {"field": "a", "input": {"a": O, "b": P}}}}}, big("1")), ({"$bsonSize": {"a": P}}, big("16")), ({"$binarySize": N}, big("strlen(p_name)"))),
    "expr_array_to_object": e("part", "p_partkey", ({"$getField": {"field": "x", "input": {"$arrayToObject": {"$map": {"input": ["x", "y"], "in": {"k": "$$this", "v": N}}}}}}, "p_name")),
    "expr_types": e("part", "p_partkey", ({"$type": O}, "'int'"), ({"$type": P}, "'long'"), ({"$type": N}, "'string'"), ({"$type": "$none"}, "'missing'"), ({"$isNumber": O}, "true"), ({"$isNumber": N}, "false")),
    "expr_convert": e("part", "p_partkey", ({"$toString": O}, "CAST(p_size AS VARCHAR)"), ({"$toInt": "$p_retailprice"}, "CAST(trunc(p_retailprice) AS INTEGER)"), ({"$toLong": {"$toString": P}}, "p_partkey"), ({"$toDouble": P}, "CAST(p_partkey AS DOUBLE)"), ({"$toBool": {"$mod": [P, 2]}}, "p_partkey % 2 <> 0"), ({"$toDecimal": O}, "CAST(p_size AS DECIMAL(38, 18))"), ({"$convert": {"input": N, "to": "int", "onError": -1}}, big("-1")), ({"$convert": {"input": None, "to": "int", "onNull": 7}}, big("7")), ({"$toDate": {"$multiply": [P, 1000]}}, "make_timestamp(p_partkey * 1000000)"), ({"$toObjectId": "0123456789ABCDEF01234567"}, "'0123456789abcdef01234567'"), ({"$toUUID": "00112233445566778899aabbccddeeff"}, "'00112233-4455-6677-8899-aabbccddeeff'")),
    "expr_date_parts": e("events", "event_id", ({"$year": T}, big("year(ts)")), ({"$month": T}, big("month(ts)")), ({"$dayOfMonth": T}, big("day(ts)")), ({"$hour": T}, big("hour(ts)")), ({"$minute": T}, big("minute(ts)")), ({"$second": T}, big("second(ts)")), ({"$millisecond": T}, big("millisecond(ts) % 1000")), ({"$dayOfWeek": T}, big("dayofweek(ts) + 1")), ({"$isoDayOfWeek": T}, big("isodow(ts)")), ({"$dayOfYear": T}, big("dayofyear(ts)")), ({"$week": T}, "CAST(strftime(ts, '%U') AS BIGINT)"), ({"$isoWeek": T}, big("week(ts)")), ({"$isoWeekYear": T}, big("isoyear(ts)"))),
    "expr_date_arithmetic": e("events", "event_id", ({"$dateAdd": {"startDate": T, "unit": "month", "amount": 1}}, "ts + INTERVAL 1 MONTH"), ({"$dateSubtract": {"startDate": T, "unit": "hour", "amount": 5}}, "ts - INTERVAL 5 HOUR"), ({"$dateDiff": {"startDate": D(2023, 1, 1), "endDate": T, "unit": "day"}}, "date_diff('day', TIMESTAMP '2023-01-01', ts)"), ({"$dateDiff": {"startDate": D(2023, 1, 15), "endDate": T, "unit": "month"}}, "date_diff('month', TIMESTAMP '2023-01-15', ts)"), ({"$subtract": [T, D(2024, 1, 1)]}, big("floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000)")), ({"$add": [T, 1500]}, "ts + INTERVAL 1500 MILLISECOND")),
    "expr_date_trunc": e("events", "event_id", ({"$dateTrunc": {"date": T, "unit": "day"}}, "CAST(date_trunc('day', ts) AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "month"}}, "CAST(date_trunc('month', ts) AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "quarter"}}, "CAST(date_trunc('quarter', ts) AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "year"}}, "CAST(date_trunc('year', ts) AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "week"}}, "CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "week", "startOfWeek": "monday"}}, "CAST(date_trunc('week', ts) AS TIMESTAMP)"), ({"$dateTrunc": {"date": T, "unit": "minute", "binSize": 15}}, "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')")),
    "expr_date_text": e("events", "event_id", ({"$dateToString": {"date": T, "format": "%Y-%m-%d %H:%M:%S"}}, "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ({"$dateToString": {"date": T, "format": "%G/%V/%u"}}, "strftime(ts, '%G/%V/%u')"), ({"$dateFromString": {"dateString": {"$dateToString": {"date": T, "format": "%Y-%m-%d"}}, "format": "%Y-%m-%d"}}, "CAST(date_trunc('day', ts) AS TIMESTAMP)"), ({"$dateFromString": {"dateString": "no date", "onError": None}}, "CAST(NULL AS TIMESTAMP)"), ({"$toString": {"$dateTrunc": {"date": T, "unit": "second"}}}, "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z')")),
    "expr_date_assemble": e("events", "event_id", ({"$dateFromParts": {"year": {"$year": T}, "month": {"$month": T}, "day": {"$dayOfMonth": T}, "hour": {"$hour": T}}}, "CAST(date_trunc('hour', ts) AS TIMESTAMP)"), ({"$dateFromParts": {"isoWeekYear": {"$isoWeekYear": T}, "isoWeek": {"$isoWeek": T}, "isoDayOfWeek": {"$isoDayOfWeek": T}}}, "CAST(date_trunc('day', ts) AS TIMESTAMP)"), ({"$getField": {"field": "day", "input": {"$dateToParts": {"date": T}}}}, big("day(ts)")), ({"$getField": {"field": "isoWeek", "input": {"$dateToParts": {"date": T, "iso8601": True}}}}, big("week(ts)")), ({"$hour": {"date": T, "timezone": "+03:00"}}, big("hour(ts + INTERVAL 3 HOUR)"))),
}
