"""Delimited text as a source and a sink.

Lines are read by Spark and split natively; only lines with quotes go through an Arrow UDF. Records that span lines
(``quoted_rfc``) are assembled per file. Records may differ in length: the table is as wide as the longest, shorter
records read NULL, and ``_rs_nf`` holds each one's own number of fields.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import HandlingError
from ..functions.compiler import python_text
from ..operators.lower import Input
from ..plans.names import Value, kind_of
from . import dialect as D

BOM = "﻿"
LATIN = "ï»¿"


def _lines(spark: SparkSession, path: str, encoding: str, policy: str, comment_prefix: str | None = None) -> DataFrame:
    """(value): lines, or whole records for ``quoted_rfc``, in file order."""
    if encoding == "latin-1" or policy == "quoted_rfc":
        charset = "ISO-8859-1" if encoding == "latin-1" else "UTF-8"

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for data in frame["content"]:
                    try:
                        text = data.decode("latin-1" if charset != "UTF-8" else "utf-8")
                    except UnicodeDecodeError as e:
                        raise HandlingError("Unable to decode input as UTF-8. Try to use latin-1 encoding") from e
                    lines = re.split("\r\n|\r|\n", text)
                    lines = lines[:-1] if lines and not lines[-1] else lines
                    yield pd.DataFrame({"value": D.records(lines, comment_prefix) if policy == "quoted_rfc" else lines})

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "value string")
    return spark.read.text(path)


def _split(policy: str, delim: str) -> Column:
    """(fields, warn) of column ``value``."""
    none = F.lit(False)
    if policy == "simple":
        return F.struct(F.split("value", re.sub(r"([^\w\s])", r"\\\1", delim), -1).alias("fields"), none.alias("warn"))
    if policy == "whitespace":
        return F.struct(F.filter(F.split("value", " +"), lambda x: x != "").alias("fields"), none.alias("warn"))
    if policy == "monocolumn":
        return F.struct(F.array("value").alias("fields"), none.alias("warn"))
    kind = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("warn", T.BooleanType())])
    slow = F.udf(lambda line: None if line is None else D.split_quoted(line, delim), kind, useArrow=True)
    plain = F.struct(F.split("value", re.sub(r"([^\w\s])", r"\\\1", delim), -1).alias("fields"), none.alias("warn"))
    # lines without a quote never reach Python's splitting
    return F.when(F.contains("value", F.lit('"')), slow(F.when(F.contains("value", F.lit('"')), F.col("value")))).otherwise(plain)


def read(
    spark: SparkSession, path: str, delim: str = ",", policy: str | None = None, encoding: str = "utf-8", has_header: bool = False, comment_prefix: str | None = None
) -> tuple[Input, list[str]]:
    """A table from a file, a folder or a glob, and warnings about it."""
    delim = D.delimiter(delim)
    policy = policy or D.default_policy(delim)
    D.check(delim, policy)
    if encoding not in ("utf-8", "latin-1"):
        raise HandlingError(f'Unknown encoding "{encoding}"')
    lines = _lines(spark, path, encoding, policy, comment_prefix).withColumn("_rs_line", F.monotonically_increasing_id())
    warnings, head = [], lines.orderBy("_rs_line").limit(1).collect()
    bom = bool(head) and (head[0]["value"].startswith(BOM) or encoding == "latin-1" and head[0]["value"].startswith(LATIN))
    if bom:
        warnings.append("UTF-8 Byte Order Mark (BOM) was found and skipped")
        lines = lines.withColumn("value", F.when(F.col("_rs_line") == head[0]["_rs_line"], F.regexp_replace("value", f"^({BOM}|{LATIN})", "")).otherwise(F.col("value")))
    if comment_prefix and policy != "quoted_rfc":  # there they go before lines are joined
        lines = lines.filter(~F.startswith("value", F.lit(comment_prefix)))
    rows = lines.select("_rs_line", _split(policy, delim).alias("s")).select("_rs_line", "s.*", F.size("s.fields").alias("nf"))
    facts = rows.agg(F.min("nf").alias("low"), F.max("nf").alias("high"), F.min("_rs_line").alias("first"), F.min(F.when(F.col("warn"), F.col("_rs_line"))).alias("bad")).first()
    if facts["bad"] is not None:
        if policy == "quoted_rfc":
            raise HandlingError("Inconsistent double quote escaping")
        warnings.append("Inconsistent double quote escaping in the input table")
    width, header = facts["high"] or 0, None
    if width and facts["low"] != width:
        warnings.append(f"Number of fields is not consistent: from {facts['low']} to {width}")
    if has_header and width:
        first = rows.filter(F.col("_rs_line") == facts["first"]).select("fields").first()["fields"]
        header = [*first, *(f"col{k + 1}" for k in range(len(first), width))]
        rows = rows.filter(F.col("_rs_line") != facts["first"])
    df = rows.select(*(F.get("fields", F.lit(k)).alias(f"c{k}") for k in range(width)), F.col("nf").cast("long").alias("_rs_nf"))
    return Input(df, header if has_header else None), warnings


def _list_text(c: Column, t: T.ArrayType, inner: str) -> Column:
    """A list's items joined; items that are lists likewise."""
    kind = kind_of(t.elementType)
    one = (lambda x: _list_text(x, t.elementType, inner)) if kind == "list" else (lambda x: python_text(Value(x, kind)))
    return F.array_join(F.transform(c, lambda x: F.coalesce(one(x), F.lit(""))), inner)


def rendered(df: DataFrame, delim: str, policy: str) -> tuple[DataFrame, Column, Column]:
    """(value) lines of the output, and conditions for its warnings: a NULL, and a delimiter inside a field."""
    inner = ";" if delim == "|" else "|"
    cols, nulls, inside = [], F.lit(False), F.lit(False)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nulls = nulls | c.isNull()
        if isinstance(f.dataType, T.ArrayType):
            text = _list_text(c, f.dataType, inner)
        else:
            text = python_text(Value(c, kind_of(f.dataType)))
        text = F.coalesce(text, F.lit(""))
        if policy in ("quoted", "quoted_rfc"):
            special = F.contains(text, F.lit(delim)) | F.contains(text, F.lit('"'))
            if policy == "quoted_rfc":
                special = special | text.rlike("[\n\r]")
            text = F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
        elif policy != "monocolumn":
            inside = inside | F.contains(text, F.lit(delim))
        cols.append(text)
    if policy == "monocolumn" and len(cols) > 1:
        raise HandlingError("Unable to use the monocolumn output: the result has more than one column")
    return df.select(F.concat_ws(delim, *cols).alias("value"), nulls.alias("n"), inside.alias("i")), F.col("n"), F.col("i")


def write(df: DataFrame, path: str, header: list[str] | None, delim: str = ",", policy: str | None = None) -> list[str]:
    """Write the result as one file at ``path``, in order, a partition at a time; returns warnings."""
    delim = D.delimiter(delim)
    policy = policy or D.default_policy(delim)
    D.check(delim, policy)
    lines, *_ = rendered(df, delim, policy)
    null = inside = False
    with open(os.path.expanduser(path), "w", encoding="utf-8", newline="\n") as out:
        if header:
            out.write(delim.join(D.quote(h, delim, policy) for h in header) + "\n")
        for row in lines.toLocalIterator():
            out.write(row["value"] + "\n")
            null |= row["n"]
            inside |= row["i"]
    return ["None values in output were replaced by empty strings"] * null + ["Some output fields contain the separator"] * inside


def write_distributed(df: DataFrame, path: str, delim: str = ",", policy: str | None = None, header: list[str] | None = None) -> None:
    """Write the lines as a folder of text files, in parallel; a header is the only line of the first file."""
    delim = D.delimiter(delim)
    policy = policy or D.default_policy(delim)
    D.check(delim, policy)
    lines = rendered(df, delim, policy)[0].select("value")
    if header:
        top = df.sparkSession.createDataFrame([(delim.join(D.quote(h, delim, policy) for h in header),)], "value string").coalesce(1)
        lines = top.union(lines)
    lines.write.mode("overwrite").text(path)
