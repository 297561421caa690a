"""Plans as documents."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame


def explain(df: DataFrame, pipeline: list | None = None) -> dict[str, Any]:
    """What Spark will do: its physical plan, what reaches the scan, and the operators that move data."""
    from .optimize import rewrite

    execution = df._jdf.queryExecution()
    text = execution.executedPlan().toString()
    return {
        "stages": [next(iter(s)) for s in rewrite(pipeline)] if pipeline else [],
        "pushedFilters": re.findall(r"PushedFilters: \[([^\]]*)\]", text),
        "readSchema": re.findall(r"ReadSchema: (struct<[^\n]*)", text),
        "exchanges": len(re.findall(r"\bExchange\b", text)),
        "joins": re.findall(r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\b", text),
        "python": bool(re.search(r"Python|Pandas|Arrow", text)),
        "physicalPlan": text,
    }
