"""Tables in memory: lists of records and pandas frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..operators.lower import Input


def _column_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int, bool} and kinds:
        return T.BooleanType() if kinds == {bool} else T.LongType()
    if kinds <= {int, float, bool} and kinds:
        return T.DoubleType()
    if kinds <= {list, tuple} and kinds:
        return T.ArrayType(_column_type([x for v in values if v is not None for x in v]))
    return T.StringType()


def from_rows(spark: SparkSession, rows: list, columns: list[str] | None = None) -> Input:
    width = max([len(r) for r in rows] + [len(columns or [])])
    padded = [[*r, *[None] * (width - len(r))] for r in rows]
    types = [_column_type([r[k] for r in padded]) for k in range(width)]
    fix = lambda v, t: v if v is None else float(v) if isinstance(t, T.DoubleType) else int(v) if isinstance(t, T.LongType) else str(v) if isinstance(t, T.StringType) else v
    schema = T.StructType([*(T.StructField(f"c{k}", t) for k, t in enumerate(types)), T.StructField("_rs_nf", T.LongType())])
    data = [(*(fix(v, t) for v, t in zip(p, types, strict=True)), len(r)) for p, r in zip(padded, rows, strict=True)]
    return Input(spark.createDataFrame(data, schema).coalesce(1), columns)


def from_pandas(spark: SparkSession, frame: Any) -> Input:
    import pandas as pd

    plain = isinstance(frame.columns, pd.RangeIndex)
    named = frame.rename(columns=lambda c: f"c{c}" if plain else str(c))
    rows = [[None if v is None or v is pd.NaT or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in r] for r in named.itertuples(index=False, name=None)]
    return from_rows(spark, rows, None if plain else list(named.columns))
