"""Groups and accumulators."""

from __future__ import annotations

import datetime

from . import pipeline_query as q

G = "$l_returnflag"


def g(output: dict, sql: str, table: str = "lineitem", key: str = G, column: str = "l_returnflag", shape: dict | None = None, before: list | None = None) -> tuple:
    pipeline = [*(before or []), {"$group": {"_id": key} | output}]
    if shape:
        pipeline.append({"$project": {"_id": 1} | shape})
    return q(table, pipeline), f"SELECT {column} AS _id, {sql} FROM {table} GROUP BY {column}"


def r(field: str, places: int = 4) -> dict:
    return {"$round": ["$" + field, places]}


BY_DATE = [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}]


def o(output: dict, sql: str, shape: dict | None = None) -> tuple:
    return g(output, sql, "orders", "$o_orderpriority", "o_orderpriority", shape, BY_DATE)


def ordered(what: str, desc: bool = False) -> str:
    way = " DESC" if desc else ""
    return f"list({what} ORDER BY o_orderdate{way}, o_orderkey{way})"


QUERIES = {
    "pricing_summary": (
        q("lineitem", [{"$match": {"l_shipdate": {"$lte": datetime.datetime(1998, 9, 2)}}}, {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "revenue": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "rf": "$_id.rf", "ls": "$_id.ls", "sum_qty": 1, "revenue": r("revenue", 2), "avg_disc": r("avg_disc", 6), "n": 1}}, {"$sort": {"rf": 1, "ls": 1}}]),
        "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "group_sum": g({"x": {"$sum": "$l_quantity"}}, "sum(l_quantity) AS x"),
    "group_sum_int": g({"x": {"$sum": "$l_linenumber"}}, "CAST(sum(l_linenumber) AS BIGINT) AS x"),
    "group_sum_non_numeric": g({"x": {"$sum": "$l_linestatus"}}, "CAST(0 AS BIGINT) AS x"),
    "group_count": g({"x": {"$count": {}}}, "count(*) AS x"),
    "group_avg": g({"x": {"$avg": "$l_discount"}}, "round(avg(l_discount), 6) AS x", shape={"x": r("x", 6)}),
    "group_min_max": g({"lo": {"$min": "$l_shipdate"}, "hi": {"$max": "$l_extendedprice"}}, "min(l_shipdate) AS lo, max(l_extendedprice) AS hi"),
    "group_first_last": o({"a": {"$first": "$o_orderkey"}, "b": {"$last": "$o_orderkey"}}, "arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS a, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS b"),
    "group_first_n": o({"x": {"$firstN": {"input": "$o_orderkey", "n": 3}}}, f"{ordered('o_orderkey')}[1:3] AS x"),
    "group_last_n": o({"x": {"$lastN": {"input": "$o_orderkey", "n": 3}}}, f"{ordered('o_orderkey')}[-3:] AS x"),
    "group_max_n": g({"x": {"$maxN": {"input": "$l_extendedprice", "n": 3}}}, "list(l_extendedprice ORDER BY l_extendedprice DESC)[1:3] AS x"),
    "group_min_n": g({"x": {"$minN": {"input": "$l_extendedprice", "n": 3}}}, "list(l_extendedprice ORDER BY l_extendedprice)[1:3] AS x"),
    "group_top_bottom": o({"a": {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "b": {"$bottom": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}}, "list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS a, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[-1] AS b"),
    "group_top_n": o({"x": {"$topN": {"n": 4, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}}, "list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:4] AS x"),
    "group_bottom_n": o({"x": {"$bottomN": {"n": 4, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}}, "list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[-4:] AS x"),
    "group_push": g({"x": {"$push": "$n_name"}}, "list(n_name ORDER BY n_name) AS x", "nation", "$n_regionkey", "n_regionkey", before=[{"$sort": {"n_name": 1}}]),
    "group_add_to_set": g({"x": {"$addToSet": "$l_linestatus"}}, "count(DISTINCT l_linestatus) AS x", shape={"x": {"$size": "$x"}}),
    "group_merge_objects": g({"x": {"$mergeObjects": {"name": "$n_name"}}}, "max(n_name) AS x", "nation", "$n_regionkey", "n_regionkey", {"x": "$x.name"}, [{"$sort": {"n_name": 1}}]),
    "group_std_dev": g({"p": {"$stdDevPop": "$l_quantity"}, "s": {"$stdDevSamp": "$l_quantity"}}, "round(stddev_pop(l_quantity), 6) AS p, round(stddev_samp(l_quantity), 6) AS s", shape={"p": r("p", 6), "s": r("s", 6)}),
    "group_median": g({"x": {"$median": {"input": "$l_extendedprice", "method": "approximate"}}}, "quantile_disc(l_extendedprice, 0.5) AS x"),
    "group_percentile": g({"x": {"$percentile": {"input": "$l_linenumber", "p": [0.1, 0.5, 0.9], "method": "approximate"}}}, "[quantile_disc(l_linenumber, 0.1), quantile_disc(l_linenumber, 0.5), quantile_disc(l_linenumber, 0.9)] AS x", shape={"x": {"$map": {"input": "$x", "in": {"$toInt": "$$this"}}}}),
    "group_all": (q("orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, {"$project": {"_id": 0}}]), "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders"),
    "group_expression_key": (q("orders", [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}]), "SELECT CAST(year(o_orderdate) AS BIGINT) AS _id, count(*) AS n FROM orders GROUP BY 1"),
    "group_distinct_count": (q("lineitem", [{"$group": {"_id": {"f": "$l_returnflag", "p": "$l_partkey"}}}, {"$group": {"_id": "$_id.f", "parts": {"$sum": 1}}}]), "SELECT l_returnflag AS _id, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "distinct_values": (q("customer", [{"$group": {"_id": "$c_mktsegment"}}]), "SELECT DISTINCT c_mktsegment AS _id FROM customer"),
}
