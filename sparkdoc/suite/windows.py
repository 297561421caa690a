"""`$setWindowFields`."""

from __future__ import annotations

from . import pipeline_query as q

W = "OVER (PARTITION BY user_id ORDER BY event_id"


def w(output: dict, sql: str, project: dict | None = None, sort: dict | None = None) -> tuple:
    sort = {"event_id": 1} if sort is None else sort
    pipeline = [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": sort, "output": output}}, {"$project": {"event_id": 1} | (project or dict.fromkeys(output, 1))}]
    return q("events", pipeline), f"SELECT event_id, {sql} FROM events"


def r(name: str, places: int = 6) -> dict:
    return {name: {"$round": ["$" + name, places]}}


QUERIES = {
    "window_document_number": w({"x": {"$documentNumber": {}}}, f"row_number() {W}) AS x"),
    "window_rank": w({"x": {"$rank": {}}}, "rank() OVER (PARTITION BY user_id ORDER BY event_type) AS x", sort={"event_type": 1}),
    "window_dense_rank": w({"x": {"$denseRank": {}}}, "dense_rank() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS x", sort={"event_type": -1}),
    "window_shift": w({"a": {"$shift": {"output": "$event_type", "by": 1, "default": "none"}}, "b": {"$shift": {"output": "$event_id", "by": -2}}}, f"lead(event_type, 1, 'none') {W}) AS a, lag(event_id, 2) {W}) AS b"),
    "window_running_sum": w({"x": {"$sum": "$value", "window": {"documents": ["unbounded", "current"]}}}, f"round(sum(value) {W} ROWS UNBOUNDED PRECEDING), 6) AS x", r("x")),
    "window_moving_avg": w({"x": {"$avg": "$value", "window": {"documents": [-3, 1]}}}, f"round(avg(value) {W} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS x", r("x")),
    "window_count_partition": w({"x": {"$count": {}}}, "count(*) OVER (PARTITION BY user_id) AS x"),
    "window_min_max": w({"a": {"$min": "$value", "window": {"documents": [-2, 2]}}, "b": {"$max": "$value"}}, f"min(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a, max(value) OVER (PARTITION BY user_id) AS b"),
    "window_range": w({"x": {"$count": {}, "window": {"range": [-500, 100]}}}, f"count(*) {W} RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS x"),
    "window_std_dev": w({"p": {"$stdDevPop": "$value"}, "s": {"$stdDevSamp": "$value"}}, "round(stddev_pop(value) OVER (PARTITION BY user_id), 6) AS p, round(stddev_samp(value) OVER (PARTITION BY user_id), 6) AS s", r("p") | r("s")),
    "window_first_last": w({"a": {"$first": "$event_id", "window": {"documents": [-1, 1]}}, "b": {"$last": "$event_id"}}, f"first_value(event_id) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a, max(event_id) OVER (PARTITION BY user_id) AS b"),
    "window_push": w({"x": {"$push": "$event_id", "window": {"documents": [-2, "current"]}}}, f"list(event_id) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x"),
    "window_add_to_set": w({"x": {"$addToSet": "$event_type"}}, "count(DISTINCT event_type) OVER (PARTITION BY user_id) AS x", {"x": {"$size": "$x"}}),
    "window_n_ends": w({"a": {"$firstN": {"input": "$event_id", "n": 2}, "window": {"documents": ["unbounded", "current"]}}, "b": {"$lastN": {"input": "$event_id", "n": 2}, "window": {"documents": ["unbounded", "current"]}}}, f"(list(event_id) {W} ROWS UNBOUNDED PRECEDING))[1:2] AS a, (list(event_id) {W} ROWS UNBOUNDED PRECEDING))[-2:] AS b"),
    "window_n_extremes": w({"a": {"$minN": {"input": "$event_id", "n": 2}}, "b": {"$maxN": {"input": "$event_id", "n": 2}}}, "(list_sort(list(event_id) OVER (PARTITION BY user_id)))[1:2] AS a, (list_reverse_sort(list(event_id) OVER (PARTITION BY user_id)))[1:2] AS b"),
    "window_top": w({"a": {"$top": {"sortBy": {"value": -1, "event_id": 1}, "output": "$event_id"}}, "b": {"$bottomN": {"n": 2, "sortBy": {"event_id": 1}, "output": "$event_id"}}}, "first_value(event_id) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, (list_sort(list(event_id) OVER (PARTITION BY user_id)))[-2:] AS b"),
    "window_median": w({"x": {"$median": {"input": "$value", "method": "approximate"}}, "y": {"$percentile": {"input": "$value", "p": [0.25], "method": "approximate"}}}, "quantile_disc(value, 0.5) OVER (PARTITION BY user_id) AS x, [quantile_disc(value, 0.25) OVER (PARTITION BY user_id)] AS y"),
    "window_derivative": w({"x": {"$derivative": {"input": "$value"}, "window": {"documents": [-1, 0]}}}, f"(value - lag(value) {W})) / (event_id - lag(event_id) {W})) AS x"),
    "window_integral": w({"x": {"$integral": {"input": "$value"}, "window": {"documents": [-1, "current"]}}}, f"round((event_id - lag(event_id) {W})) * (value + lag(value) {W})) / 2, 6) AS x", r("x")),
    "window_locf": (q("events", [{"$addFields": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$event_id", None]}}}, {"$setWindowFields": {"partitionBy": "$event_type", "sortBy": {"event_id": 1}, "output": {"x": {"$locf": "$v"}}}}, {"$project": {"event_id": 1, "x": 1}}]), "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM events"),
    "window_linear_fill": (
        q("events", [{"$addFields": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 5]}, 0]}, "$event_id", None]}}}, {"$setWindowFields": {"sortBy": {"event_id": 1}, "output": {"x": {"$linearFill": "$v"}}}}, {"$project": {"event_id": 1, "x": {"$round": ["$x", 6]}}}]),
        "WITH e AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events WHERE event_id % 5 = 0) SELECT event_id, CASE WHEN event_id BETWEEN lo AND hi THEN CAST(event_id AS DOUBLE) END AS x FROM events, e",
    ),
    "window_exp_moving_avg": (
        q("events", [{"$setWindowFields": {"sortBy": {"event_id": 1}, "output": {"x": {"$expMovingAvg": {"input": "$value", "N": 5}}}}}, {"$project": {"event_id": 1, "x": {"$round": ["$x", 6]}}}]),
        "WITH RECURSIVE e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS n FROM events), m AS (SELECT event_id, n, value AS x FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.n, e.value / 3 + m.x * (1 - 1.0 / 3) FROM m JOIN e ON e.n = m.n + 1) SELECT event_id, round(x, 6) AS x FROM m",
    ),
    "window_exp_moving_avg_by_user": (
        q("events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"x": {"$expMovingAvg": {"input": "$value", "N": 5}}}}}, {"$project": {"event_id": 1, "x": {"$round": ["$x", 6]}}}]),
        "WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), m AS (SELECT event_id, user_id, n, value AS x FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, e.value / 3 + m.x * (1 - 1.0 / 3) FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1) SELECT event_id, round(x, 6) AS x FROM m",
    ),
    "window_nested_output": w({"s.a": {"$documentNumber": {}}}, f"row_number() {W}) AS a", {"a": "$s.a"}),
}
