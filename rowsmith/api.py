"""Entry points: queries over DataFrames, pandas frames, lists, SQLite tables and delimited text."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import HandlingError, ParsingError
from .operators.lower import Input, Lowering, Options
from .plans.clauses import parse


@dataclass
class QueryResult:
    """The result; ``header`` is None when neither table has names and no alias is given."""

    df: DataFrame
    header: list[str] | None
    warnings: list[str] = field(default_factory=list)


Resolver = Callable[[str], Input]


def as_input(table: DataFrame | Input, has_header: bool = True) -> Input:
    return table if isinstance(table, Input) else Input(table, [c for c in table.columns if c != "_rs_nf"] if has_header else None)


def query(
    spark: SparkSession,
    text: str,
    tables: Mapping[str, DataFrame | Input] | Resolver | None = None,
    has_header: bool = True,
    bare_names: bool = False,
    init_code: str = "",
    functions: dict[str, Any] | None = None,
    in_order: bool = False,
) -> QueryResult:
    """Run a query.

    ``in_order``: results come in the input's order also after JOIN and DISTINCT, which costs a sort. What is written
    to a file, and queries over lists and pandas frames, ask for it.

    ``tables`` maps names to tables, or is a function that finds one. If it holds ``a``, that is the input; otherwise
    FROM names it. JOIN tables are looked up there (any case), then among temporary views and catalog tables.
    """
    find: Resolver | None = tables if callable(tables) else None
    known = {} if tables is None or callable(tables) else dict(tables)
    q, _ = parse(text, bound="a" in known)
    header = has_header if q.has_header is None else q.has_header

    def table(name: str) -> Input:
        for key in (name, name.lower()):
            if key in known:
                return as_input(known[key], header)
        if find:
            return find(name)
        if spark.catalog.tableExists(name):
            return as_input(spark.table(name), header)
        raise HandlingError(f'Unable to find table "{name}"')

    if "a" in known:
        source = as_input(known["a"], header)
    elif q.source:
        source = table(q.source)
    else:
        raise ParsingError('There is no input table: give one or add "FROM"')
    joined = table(q.join.table) if q.join else None
    low = Lowering(q, source, joined, Options(bare_names, init_code, {"udf": _Space(functions)} | functions if functions else {}, in_order))
    df = low.run()
    return QueryResult(df, low.header, [f'Unknown modifier in WITH is ignored: "{w}"' for w in q.ignored])


class _Space:
    """``udf.name`` for functions handed over by the caller."""

    def __init__(self, functions: dict[str, Any] | None):
        self.__dict__.update(functions or {})


def query_table(spark: SparkSession, text: str, rows: list, join_rows: list | None = None, columns: list[str] | None = None, join_columns: list[str] | None = None, **options: Any) -> QueryResult:
    """Query lists of records; records may differ in length."""
    from .sources.memory import from_rows

    tables = {"a": from_rows(spark, rows, columns)}
    if join_rows is not None:
        tables["b"] = from_rows(spark, join_rows, join_columns)
    return query(spark, text, tables, **{"in_order": True, **options})


def query_pandas(spark: SparkSession, text: str, frame: Any, join_frame: Any = None, **options: Any) -> Any:
    """Query pandas frames, giving a pandas frame. Frames whose columns are a plain range have no header."""
    from .sources.memory import from_pandas

    tables = {"a": from_pandas(spark, frame)} | ({"b": from_pandas(spark, join_frame)} if join_frame is not None else {})
    return query(spark, text, tables, **{"in_order": True, **options}).df.toPandas()


def query_csv(
    spark: SparkSession,
    text: str,
    input_path: str,
    delim: str = ",",
    policy: str | None = None,
    output_path: str | None = None,
    output_delim: str | None = None,
    output_policy: str | None = None,
    encoding: str = "utf-8",
    has_header: bool = False,
    comment_prefix: str | None = None,
    **options: Any,
) -> QueryResult:
    """Query a file of delimited text; JOIN names other files of the same dialect. All fields are texts.

    With ``output_path`` the result is written there, by default in the input's dialect.
    """
    from .sources import csv, dialect, registry

    q, _ = parse(text)
    header = has_header if q.has_header is None else q.has_header
    delim = dialect.delimiter(delim)
    policy = policy or dialect.default_policy(delim)
    a, warnings = csv.read(spark, input_path, delim, policy, encoding, header, comment_prefix)
    tables: dict[str, Input] = {"a": a}
    if q.join:
        path = registry.find_path(q.join.table, input_path)
        tables[q.join.table], more = csv.read(spark, path, delim, policy, encoding, header, comment_prefix)
        warnings += [f"{w} (join table)" for w in more]
    result = query(spark, text, tables, header, **{"in_order": output_path is not None, **options})
    result.warnings = warnings + result.warnings
    if output_path:
        result.warnings += csv.write(result.df, output_path, result.header, output_delim or delim, output_policy or (policy if output_delim in (None, delim) else None))
    return result


def query_sqlite(spark: SparkSession, text: str, database: str, table: str | None = None, output_path: str | None = None, delim: str = ",", policy: str = "quoted", **options: Any) -> QueryResult:
    """Query a table of an SQLite file; JOIN and FROM name its other tables. The sink is delimited text."""
    from .sources import csv, registry

    q, _ = parse(text, bound=table is not None)
    tables = {} if q.source and table is None else {"a": registry.sqlite_table(spark, database, table)}
    for name in filter(None, (q.source, q.join.table if q.join else None)):
        tables[name] = registry.sqlite_table(spark, database, name)
    result = query(spark, text, tables, **{"in_order": output_path is not None, **options})
    if output_path:
        result.warnings += csv.write(result.df, output_path, result.header, delim, policy)
    return result
