"""Checks and rewrites of delimited text: lint, align, shrink, dialect detection."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import HandlingError
from .sources import dialect as D

PARTS = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("warn", T.BooleanType())])


def _parts(spark: SparkSession, path: str, delim: str, policy: str | None, keep: bool) -> tuple[DataFrame, str, str]:
    delim = D.delimiter(delim)
    policy = policy or D.default_policy(delim)
    D.check(delim, policy)
    if policy == "quoted_rfc":
        raise HandlingError("Records of several lines can't be checked line by line")
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    cut = F.udf(lambda x: D.split(x, delim, policy, keep), PARTS, useArrow=True)
    return lines.select("id", cut("value").alias("s")).select("id", "s.*"), delim, policy


def _line_number(df: DataFrame, bad: int) -> int:
    return df.filter(F.col("id") <= bad).count()


def lint(spark: SparkSession, path: str, delim: str = ",", policy: str | None = None) -> str | None:
    """The first problem, if any: a misplaced quote, or a line with another number of fields than the first."""
    df, *_ = _parts(spark, path, delim, policy, keep=True)
    first = df.orderBy("id").limit(1).collect()
    if not first:
        return None
    width = len(first[0]["fields"])
    found = df.agg(F.min(F.when(F.col("warn"), F.col("id"))).alias("quote"), F.min(F.when(F.size("fields") != width, F.struct("id", F.size("fields").alias("n")))).alias("width")).first()
    quote, other = found["quote"], found["width"]
    if quote is not None and (other is None or quote <= other["id"]):
        return f"Line {_line_number(df, quote)} has formatting error: double quote chars are not consistent"
    if other is not None:
        return f"Number of fields is not consistent: e.g. line 1 has {width} fields, and line {_line_number(df, other['id'])} has {other['n']} fields"
    return None


def align(spark: SparkSession, path: str, delim: str = ",", policy: str | None = None) -> DataFrame:
    """(value): lines with every field but the last padded to its column's widest and one space."""
    df, delim, _ = _parts(spark, path, delim, policy, keep=True)
    if df.filter("warn").limit(1).count():
        raise HandlingError("Unable to align: the table has lines with misplaced quotes")
    stripped = df.select("id", F.transform("fields", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("fields"))
    each = stripped.select(F.posexplode("fields").alias("k", "x")).groupBy("k").agg(F.max(F.char_length("x")).alias("w")).collect()  # a row for each column
    widths = [w for _, w in sorted((r["k"], r["w"]) for r in each)]
    if not widths:
        return stripped.select(F.lit("").alias("value")).limit(0)
    table = F.array(*(F.lit(w) for w in widths))
    pad = lambda x, k: F.when(k < F.size("fields") - 1, F.rpad(x, F.get(table, k) + 1, " ")).otherwise(x)
    return stripped.orderBy("id").select(F.array_join(F.transform("fields", pad), delim).alias("value"))


def shrink(spark: SparkSession, path: str, delim: str = ",", policy: str | None = None) -> DataFrame:
    """(value): lines with the spaces around every field removed; quotes stay."""
    df, delim, _ = _parts(spark, path, delim, policy, keep=True)
    fields = F.transform("fields", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return df.orderBy("id").select(F.array_join(fields, delim).alias("value"))


def detect_ends(spark: SparkSession, path: str, least: int = 5) -> tuple[str, str] | None:
    """Delimiter and policy: remembered for the path, or from the first and last ten lines and the ending."""
    if known := recall_dialect(path):
        return known
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    head = [r["value"] for r in lines.orderBy("id").limit(10).collect()]
    tail = [r["value"] for r in reversed(lines.orderBy(F.desc("id")).limit(10).collect())] if len(head) == 10 else []
    return D.guess_ends(head, tail, path, least)


#: A text file with a path, the delimiter's code points and the policy in each line, separated by tabs.
DIALECT_INDEX = "~/.rowsmith_dialects"
MAX_DIALECTS = 100


def _dialects(index: str) -> dict[str, tuple[str, str]]:
    where = os.path.expanduser(index)
    if not os.path.exists(where):
        return {}
    with open(where, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f]
    return {r[0]: ("".join(chr(int(x, 16)) for x in r[1].split("-")), r[2]) for r in rows if len(r) == 3}


def remember_dialect(path: str, delim: str, policy: str, index: str = DIALECT_INDEX) -> None:
    """Keep the dialect chosen for a file; of more than MAX_DIALECTS the oldest are forgotten."""
    D.check(D.delimiter(delim), policy)
    known = {k: v for k, v in _dialects(index).items() if k != path} | {path: (D.delimiter(delim), policy)}
    with open(os.path.expanduser(index), "w", encoding="utf-8") as f:
        f.writelines(f"{k}\t{'-'.join(f'{ord(c):x}' for c in d)}\t{p}\n" for k, (d, p) in list(known.items())[-MAX_DIALECTS:])


def recall_dialect(path: str, index: str = DIALECT_INDEX) -> tuple[str, str] | None:
    return _dialects(index).get(path)


def detect(spark: SparkSession, path: str, least: int = 2) -> tuple[str, str] | None:
    """Delimiter and policy of a file, from its first ten lines and its ending."""
    return D.guess([r["value"] for r in spark.read.text(path).limit(10).collect()], path, least)
