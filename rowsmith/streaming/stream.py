"""Queries over streams: the stateless part of the language, and windowed counts with watermarks.

SELECT, WHERE, EXCEPT, UPDATE, UNNEST and a join with a static table lower to the same plan as for a table. What needs
an order or all rows (ORDER BY, TOP, DISTINCT, NR, aggregates) is refused, since a stream has no end.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import QueryResult, query
from ..errors import ParsingError
from ..operators.lower import Lowering
from ..plans.clauses import parse


def query_stream(spark: SparkSession, text: str, stream: DataFrame, tables: dict[str, DataFrame] | None = None, **options: Any) -> QueryResult:
    """A query whose input is a streaming DataFrame; ``tables`` are static and may be joined."""
    q, _ = parse(text)
    names = {"ORDER BY": q.order, "TOP": q.top is not None, "DISTINCT": q.distinct, "GROUP BY": q.group}
    for word, used in names.items():
        if used:
            raise ParsingError(f'"{word}" is not possible over a stream')
    if any(Lowering._aggregate_call(i.text) for i in q.items if not i.star):
        raise ParsingError("Aggregates are not possible over a stream without a window: see windowed")
    if any("NR" in t for t in (q.where or "", *(i.text for i in q.items), *(e for _, e in q.updates))):
        raise ParsingError('"NR" is not possible over a stream')
    if q.join and (q.is_update or q.join.kind == "strict"):
        raise ParsingError("Joins that count matches are not possible over a stream")
    return query(spark, text, {"a": stream} | (tables or {}), **options)


def windowed(stream: DataFrame, time_col: str, length: str, late: str, keys: list[str], value_col: str | None = None) -> DataFrame:
    """Counts (and sums) by key and tumbling window of event time; rows later than ``late`` are dropped."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value_col).alias("total")] if value_col else [])
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    out = timed.groupBy(F.window(time_col, length), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), *keys, "n", *(["total"] if value_col else []))
