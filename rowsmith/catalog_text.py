"""Registered queries over delimited text, other sources, sinks, tools, streams and the grammar, with equivalent SQL.

Text tables are made from the Parquet tables: written as lines to the shared folder, and read back by the engine.
"""

from __future__ import annotations

import io
import os
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, tools
from .api import query, query_csv, query_pandas, query_sqlite, query_table
from .errors import describe
from .operators.lower import Input
from .plans.clauses import parse
from .sources import csv, dialect, registry
from .sources.memory import from_rows
from .sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_lines(spark: SparkSession, lines: DataFrame, **options: str) -> str:
    path = shared_folder(spark, "lines")
    lines.select("value").write.options(**options).text(path)
    return path


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def through_text(name: str, made: Callable[[], list[Column]], delim: str, policy: str, text: str) -> Query:
    """Columns of a table, written by the sink in a dialect, read by the source in the same, and queried."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "table")
        csv.write_distributed(table(spark, sf_dir, name).select(*made()), path, delim, policy)
        return query_csv(spark, text, path, delim, policy).df

    return run


def of_lines(name: str, line: Callable[[], Column], delim: str, policy: str, text: str, write: dict | None = None, **read) -> Query:
    """Lines made from a table, read by the source and queried."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = put_lines(spark, table(spark, sf_dir, name).select(line().alias("value")), **(write or {}))
        return query_csv(spark, text, path, delim, policy, **read).df

    return run


def csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "latin")
    table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é§ü"))).write.option("encoding", "ISO-8859-1").csv(path)
    return query_csv(spark, "select int(a1) as k, a2 as name", path + "/*.csv", ",", "quoted", encoding="latin-1").df


def csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header names the columns; the join table of the same dialect has one too, found beside the input."""
    folder = tempfile.mkdtemp(prefix="rowsmith-") if spark.sparkContext.master.startswith("local[") else None
    base = f"file://{folder}" if folder else shared_folder(spark, "header")
    for name in ("nation", "region"):
        t = table(spark, sf_dir, name)
        csv.write_distributed(t.coalesce(1), f"{base}/{name}", ",", "quoted", t.columns)
    tables = {side: csv.read(spark, f"{base}/{name}/part-*", ",", "quoted", has_header=True)[0] for side, name in (("a", "nation"), ("b", "region"))}
    return query(spark, "select a.n_name, b['r_name'] join b on a.n_regionkey == b.r_regionkey where b.r_name != 'ASIA'", tables).df


def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are written: numbers and truth values as Python prints them, lists joined, NULL empty, quotes where needed."""
    df = query(spark, "select a.p_partkey, a.p_size > 25, None, a.p_name.split(' '), a.p_size / 2, a.p_name + ',\"'", {"a": table(spark, sf_dir, "part")}).df
    return csv.rendered(df, ",", "quoted")[0].select("value")


def sink_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have a NULL, and how many a separator inside a field."""
    df = query(spark, "select a.p_name, None if a.p_size > 25 else a.p_size", {"a": table(spark, sf_dir, "part")}).df
    lines, null, inside = csv.rendered(df, " ", "simple")
    return lines.agg(F.count_if(null).alias("nulls"), F.count_if(inside).alias("separators"))


def _written(spark: SparkSession, run: Callable[[str], object]) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # the driver's own output file
        run(os.path.join(folder, "out"))
        with open(os.path.join(folder, "out"), encoding="utf-8") as f:
            return rows(spark, [(k, line.rstrip("\n")) for k, line in enumerate(f)], "k bigint, line string")


def sink_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with a header, in the order of the input: DISTINCT keeps first occurrences in their place."""
    df = query(spark, "select distinct a.n_regionkey, a.n_regionkey * 2 as twice", {"a": table(spark, sf_dir, "nation")}, in_order=True)
    return _written(spark, lambda path: csv.write(df.df, path, df.header))


def sink_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    path = shared_folder(spark, "colour")

    def run(to: str) -> None:
        csv.write(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path := to + ".csv", None)
        cli.show(path, ",", "quoted", True, out)
        with open(to, "w", encoding="utf-8") as f:
            f.write(out.getvalue())

    del path
    return _written(spark, run)


def sink_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed form: a folder of files, the first of which is the header."""
    path = shared_folder(spark, "folder")
    csv.write_distributed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "|", "simple", ["key", "status"])
    return spark.read.text(path).select(F.col("value").alias("line"))


def memory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of records of different lengths; a field beyond a record's end is NULL."""
    lists = [[r.n_nationkey, r.n_name][: 1 + r.n_nationkey % 2] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    return query_table(spark, "select a1 as k, a2 as name, NF as nf, NR as nr", lists).df


def pandas_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "nation").toPandas()
    return spark.createDataFrame(query_pandas(spark, "select n_name, n_regionkey + 1 as r where n_regionkey > 1", frame, bare_names=True))


def _database(spark: SparkSession, sf_dir: str, folder: str) -> str:
    path = os.path.join(folder, "tables.db")
    with sqlite3.connect(path) as db:
        for name in ("nation", "region"):
            t = table(spark, sf_dir, name)
            db.execute(f"create table {name} ({', '.join(t.columns)})")
            db.executemany(f"insert into {name} values ({', '.join('?' * len(t.columns))})", [tuple(r) for r in t.collect()])
    return path


def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver
        return query_sqlite(spark, "select a.n_name, b.r_name from nation join region on a.n_regionkey == b.r_regionkey", _database(spark, sf_dir, folder)).df


def sqlite_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        db = _database(spark, sf_dir, folder)
        return _written(spark, lambda out: query_sqlite(spark, "update a.r_name = a.r_name + '!' where a.r_regionkey > 2", db, "region", out))


def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's finds tables by name."""
    find = lambda name: Input(table(spark, sf_dir, name.removeprefix("my_")), table(spark, sf_dir, name.removeprefix("my_")).columns)
    return query(spark, "select a.n_name, b.r_name from my_nation join my_region on a.n_regionkey == b.r_regionkey", find).df


def names_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table names and dialects that are remembered: the newest hundred."""
    with tempfile.TemporaryDirectory() as folder:
        index, dialects = os.path.join(folder, "names"), os.path.join(folder, "dialects")
        for k in range(105):
            registry.remember(f"t{k}", f"{folder}/{k}", index)
            tools.remember_dialect(f"{folder}/{k}", "\t" if k % 2 else "##", "simple", dialects)
        names = registry.names(index)
        known = [(k, f"t{k}" in names, (tools.recall_dialect(f"{folder}/{k}", dialects) or ("", ""))[0]) for k in range(105)]
    return rows(spark, known, "k bigint, named boolean, delim string")


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    for delim, policy in dialect.DIALECTS:
        path = shared_folder(spark, "detect")
        csv.write_distributed(t, path, delim, policy)
        out.append((delim, *(tools.detect(spark, path) or ("", "")), *(tools.detect_ends(spark, path) or ("", ""))))
    out.append(("few", *(dialect.guess(["a;b", "c;d"], "x.csv") or ("", "")), *(dialect.guess_ends(["a;b;;", "c;d"], [], "x.csv") or ("", ""))))
    out.append(("none", *(dialect.guess(["a", "b"], "x.txt") or ("", "")), *(dialect.guess_ends(["a"] * 9, [], "x.tsv") or ("", ""))))
    return rows(spark, out, "case string, head_delim string, head_policy string, ends_delim string, ends_policy string")


def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").coalesce(1)
    good = put_lines(spark, t.select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")))
    wide = put_lines(spark, t.select(F.concat_ws(",", "n_nationkey", "n_name", F.when(F.col("n_nationkey") == 7, "x")).alias("value")))
    quote = put_lines(spark, t.select(F.when(F.col("n_nationkey") == 4, 'a"b,c').otherwise(F.concat_ws(",", "n_nationkey", "n_name")).alias("value")))
    return rows(spark, [(n, tools.lint(spark, p)) for n, p in (("good", good), ("wide", wide), ("quote", quote))], "case string, problem string")


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = put_lines(spark, table(spark, sf_dir, "part").select(F.concat_ws(",", F.concat(F.lit(" "), "p_partkey"), "p_name", "p_size").alias("value")))
    return tools.align(spark, path).select(F.col("value").alias("line"))


def shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = put_lines(spark, table(spark, sf_dir, "part").select(F.concat_ws(" ,  ", "p_partkey", "p_name", "p_size").alias("value")))
    return tools.shrink(spark, path).select(F.col("value").alias("line"))


def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateless query over a stream of files, joined with a static table, drained into a table."""
    from .streaming.stream import query_stream

    schema = table(spark, sf_dir, "customer").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/custome[r].parquet")
    out = query_stream(spark, "select a.c_custkey, b.n_name join b on a.c_nationkey == b.n_nationkey where a.c_acctbal > 0", stream, {"b": table(spark, sf_dir, "nation")}).df
    path = shared_folder(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _category(run: Callable[[], object]) -> str:
    try:
        run()
    except Exception as e:
        return describe(e)[0]
    return "none"


#: Statements and what becomes of them.
GRAMMAR = [
    ("select a1", "none"), ("  SELECT a1 ; ", "none"), ("# note\nselect a1", "none"), ("select top 3 distinct count a1", "none"), ("select a1 where a2 == 'select b from c'", "none"),
    ("select distinct top 3 a1", "syntax error"), ("a1 select", "query parsing"), ("where a1", "query parsing"), ("update a1 = 2 select a1", "query parsing"), ("select a1 select a2", "query parsing"),
    ("select a1 where a1 where a2", "query parsing"), ("select", "query parsing"), ("select a1 limit x", "query parsing"), ("select a1 limit -1", "query parsing"), ("select a1 where a1 = 2", "query parsing"),
    ("select a1 order by a1 desc", "none"), ("update a1 = 1 order by a1", "query parsing"), ("select a1 join b on a1 == b1", "none"), ("select a1 join b", "query parsing"), ("select a1 join b on a1", "query parsing"),
    ("select * except a1 join b on a1 == b1", "query parsing"), ("select a1 from t", "query parsing"), ("select a1 from a", "none"), ("select a1 group by a1 order by a1", "query parsing"), ("select a1 where a1 having a2", "syntax error"),
    ("update a1", "query parsing"), ("update set a1 = 2, a2 = 3 where a1 > 1", "none"), ("select a1,, a2", "query parsing"), ("select a1 with (header)", "none"),
]


def grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    def check(text: str) -> str:
        def run() -> None:
            q, _ = parse(text)
            for i in q.items:
                if not i.star:
                    compile(i.text, "<item>", "eval")

        try:
            run()
        except SyntaxError:
            return "syntax error"
        except Exception as e:
            return describe(e)[0]
        return "none"

    return rows(spark, [(text, check(text)) for text, _ in GRAMMAR], "query string, error string")


#: Queries over three records of two fields that fail, and how.
FAILURES = [
    ("select a.nope", "query parsing"), ("select a1 +", "syntax error"), ("select int(a2)", "query execution"), ("update a9 = 1", "query execution"), ("select a1 join none on a1 == b1", "IO handling"),
    ("select 1 + COUNT(a1)", "query parsing"), ("select max(a1) + 1", "query parsing"), ("select a2, count(1)", "query execution"), ("select UNNEST([1]), UNNEST([2])", "query parsing"), ("select * except a7", "query parsing"),
    ("select a1 strict left join b on a1 == b1 where a1 == 1", "query execution"), ("update a2 = b2 join b on a2 == b2", "query execution"), ("select a1 / 0", "query execution"), ("select count(1) order by a1", "query parsing"),
]


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = from_rows(spark, [[1, "x"], [2, "y"], [3, "z"]], ["i", "t"]), from_rows(spark, [[1, "x"], [1, "x"]], ["i", "t"])
    run = lambda text: query(spark, text, {"a": a, "b": b}).df.collect()
    return rows(spark, [(text, _category(lambda text=text: run(text))) for text, _ in FAILURES], "query string, error string")


def read_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of the source, and of the sink, over lines with ragged records and a misplaced quote."""
    t = table(spark, sf_dir, "nation").coalesce(1)
    path = put_lines(spark, t.select(F.when(F.col("n_nationkey") == 3, 'a"b').otherwise(F.concat_ws(",", "n_nationkey", "n_name")).alias("value")))
    with tempfile.TemporaryDirectory() as folder:
        found = query_csv(spark, "select a1, a2", path, ",", "quoted", os.path.join(folder, "out")).warnings
    return rows(spark, [(w,) for w in found], "warning string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over a file and over a database; standard output, line by line."""
    out = []
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "region.csv")
        csv.write(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path, ["key", "name"])
        for k, args in enumerate(
            [
                ["--input", path, "--delim", ",", "--with-headers", "--query", "select a.name, int(a.key) + 1 as next order by int(a.key) desc", "--out-format", "tsv"],
                ["--input", path, "--query", "select NR, a2 where NR > 4"],
                ["--input", path, "--preview", "--out-delim", ";"],
                ["--database", _database(spark, sf_dir, folder), "--input", "region", "--query", "select a.r_name where a.r_regionkey < 2"],
            ]
        ):
            said = io.StringIO()
            code = cli.main(args, spark, said)
            out += [(k, code, n, line) for n, line in enumerate(said.getvalue().splitlines())]
    return rows(spark, out, "run bigint, code bigint, n bigint, line string")


def _values(pairs: list[tuple[str, str]]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ") AS t(query, error)"


QUOTED_NAME = lambda: [F.col("p_partkey"), F.concat("p_name", F.lit(', "new"'))]
LINE = lambda: F.concat_ws(",", "c_custkey", "c_name")

TEXT: dict[str, tuple[Query, str]] = {
    "csv_simple": (through_text("part", lambda: [F.col("p_partkey"), F.col("p_name")], "TAB", "simple", "select int(a1) as k, a2 as name, NF as nf"), "SELECT p_partkey AS k, p_name AS name, 2 AS nf FROM part"),
    "csv_multichar": (through_text("part", lambda: [F.col("p_partkey"), F.col("p_name")], "##", "simple", "select int(a1) as k, a2 as name"), "SELECT p_partkey AS k, p_name AS name FROM part"),
    "csv_quoted": (through_text("part", QUOTED_NAME, ",", "quoted", "select int(a1) as k, a2 as name"), "SELECT p_partkey AS k, p_name || ', \"new\"' AS name FROM part"),
    "csv_quoted_rfc": (through_text("part", lambda: [F.col("p_partkey"), F.concat("p_name", F.lit('\n"x"\n,'))], ",", "quoted_rfc", "select int(a1) as k, a2 as name"), "SELECT p_partkey AS k, p_name || chr(10) || '\"x\"' || chr(10) || ',' AS name FROM part"),
    "csv_whitespace": (of_lines("part", lambda: F.concat(F.lit("  "), "p_name", F.lit("   x ")), " ", "whitespace", "select a1 as x, a2 as y, a3 as z, NF as nf"), "SELECT split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y, 'x' AS z, 3 AS nf FROM part"),
    "csv_monocolumn": (of_lines("part", lambda: F.concat("p_name", F.lit(',"')), ",", "monocolumn", "select a1 as line"), "SELECT p_name || ',\"' AS line FROM part"),
    "csv_line_ends": (of_lines("customer", LINE, ",", "quoted", "select int(a1) as k, a2 as name", {"lineSep": "\r\n"}), "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "csv_old_line_ends": (of_lines("customer", LINE, ",", "quoted", "select int(a1) as k, a2 as name", {"lineSep": "\r"}), "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "csv_comments": (of_lines("customer", lambda: F.concat(F.lit("# no \"comment\n"), LINE()), ",", "quoted", "select int(a1) as k, a2 as name", comment_prefix="#"), "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "csv_rfc_comments": (of_lines("customer", lambda: F.concat(F.lit("# don\"t\n"), F.concat_ws(",", "c_custkey", F.lit('"# in\n# field"'))), ",", "quoted_rfc", "select int(a1) as k, a2 as name", comment_prefix="#"), "SELECT c_custkey AS k, '# in' || chr(10) || '# field' AS name FROM customer"),
    "csv_latin1": (csv_latin1, "SELECT c_custkey AS k, c_name || ' é§ü' AS name FROM customer"),
    "csv_header": (csv_header, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"),
    "csv_with_clause": (of_lines("region", lambda: F.concat(F.when(F.col("r_regionkey") == 0, F.lit("key,name\n")).otherwise(""), F.concat_ws(",", "r_regionkey", "r_name")), ",", "quoted", "select a.name as name, int(a.key) as key with (header)"), "SELECT r_name AS name, r_regionkey AS key FROM region"),
    "csv_bom": (of_lines("region", lambda: F.concat(F.when(F.col("r_regionkey") == 0, F.lit("﻿")).otherwise(""), F.concat_ws(",", "r_regionkey", "r_name")), ",", "quoted", "select int(a1) as k"), "SELECT r_regionkey AS k FROM region"),
    "csv_ragged": (of_lines("customer", lambda: F.concat_ws(",", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))), ",", "quoted", "select int(a1) as k, a2 as name, NF as nf"), "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, 2 - c_custkey % 2 AS nf FROM customer"),
    "csv_aggregate": (through_text("orders", lambda: [F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_totalprice")], ",", "quoted", "select a1 as p, sum(a2) as s, max(a2) as m, min(a3) as low, avg(a2) as v group by a1"), "SELECT o_orderpriority AS p, sum(o_custkey)::BIGINT AS s, max(o_custkey) AS m, min(o_totalprice) AS low, avg(o_custkey) AS v FROM orders GROUP BY 1"),
    "sink_text": (sink_text, "SELECT p_partkey || ',' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || ',,' || replace(p_name, ' ', '|') || ',' || (p_size // 2)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN '.0' ELSE '.5' END || ',\"' || p_name || ',\"\"\"' AS value FROM part"),
    "sink_warnings": (sink_warnings, "SELECT count(*) FILTER (p_size > 25) AS nulls, count(*) FILTER (contains(p_name, ' ')) AS separators FROM part"),
    "sink_file": (sink_file, "SELECT 0 AS k, 'n_regionkey,twice' AS line UNION ALL SELECT row_number() OVER (ORDER BY f), n_regionkey || ',' || 2 * n_regionkey FROM (SELECT n_regionkey, min(n_nationkey) AS f FROM nation GROUP BY 1)"),
    "sink_colour": (sink_colour, "SELECT r_regionkey::BIGINT AS k, chr(27) || '[31m' || r_regionkey || chr(27) || '[0m,' || chr(27) || '[32m' || r_name || chr(27) || '[0m' AS line FROM region"),
    "sink_folder": (sink_folder, "SELECT 'key|status' AS line UNION ALL SELECT o_orderkey || '|' || o_orderstatus FROM orders"),
    "memory_scan": (memory_scan, "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS name, 1 + n_nationkey % 2 AS nf, row_number() OVER (ORDER BY n_nationkey) AS nr FROM nation"),
    "pandas_scan": (pandas_scan, "SELECT n_name, n_regionkey + 1 AS r FROM nation WHERE n_regionkey > 1"),
    "sqlite_scan": (sqlite_scan, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sqlite_to_text": (sqlite_to_text, "SELECT 0 AS k, 'r_regionkey,r_name' AS line UNION ALL SELECT r_regionkey + 1, r_regionkey || ',' || r_name || CASE WHEN r_regionkey > 2 THEN '!' ELSE '' END FROM region"),
    "custom_source": (custom_source, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "names_registry": (names_registry, "SELECT k, k >= 5 AS named, CASE WHEN k < 5 THEN '' WHEN k % 2 = 1 THEN chr(9) ELSE '##' END AS delim FROM (SELECT unnest(range(105)) AS k)"),
    "detect": (detect, "SELECT * FROM (VALUES (chr(9), chr(9), 'simple', chr(9), 'simple'), (',', ',', 'quoted', ',', 'quoted'), (';', ';', 'quoted', ';', 'quoted'), ('|', '|', 'simple', '|', 'simple'), ('few', ';', 'quoted', ';', 'quoted'), ('none', '', '', chr(9), 'simple')) AS t(\"case\", head_delim, head_policy, ends_delim, ends_policy)"),
    "lint": (lint, "SELECT * FROM (VALUES ('good', NULL), ('wide', 'Number of fields is not consistent: e.g. line 1 has 2 fields, and line 8 has 3 fields'), ('quote', 'Line 5 has formatting error: double quote chars are not consistent')) AS t(\"case\", problem)"),
    "align": (align, "SELECT rpad(p_partkey::VARCHAR, (SELECT max(length(p_partkey::VARCHAR)) + 1 FROM part)::INT, ' ') || ',' || rpad(p_name, (SELECT max(length(p_name)) + 1 FROM part)::INT, ' ') || ',' || p_size AS line FROM part"),
    "shrink": (shrink, "SELECT p_partkey || ',' || p_name || ',' || p_size AS line FROM part"),
    "stream_select": (stream_select, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"),
    "grammar": (grammar, _values(GRAMMAR)),
    "failures": (failures, _values(FAILURES)),
    "read_warnings": (read_warnings, "SELECT * FROM (VALUES ('Inconsistent double quote escaping in the input table'), ('Number of fields is not consistent: from 1 to 2'), ('None values in output were replaced by empty strings')) AS t(warning)"),
    "command_line": (
        command_line,
        "SELECT 0 AS run, 0 AS code, 0 AS n, 'name' || chr(9) || 'next' AS line UNION ALL SELECT 0, 0, 5 - r_regionkey, r_name || chr(9) || r_regionkey + 1 FROM region "
        "UNION ALL SELECT 1, 0, r_regionkey - 3, (r_regionkey + 2) || ',' || r_name FROM region WHERE r_regionkey >= 3 "
        "UNION ALL SELECT 2, 0, 0, 'key;name' UNION ALL SELECT 2, 0, r_regionkey + 1, r_regionkey || ';' || r_name FROM region "
        "UNION ALL SELECT 3, 0, 0, 'r_name' UNION ALL SELECT 3, 0, r_regionkey + 1, r_name FROM region WHERE r_regionkey < 2",
    ),
}
