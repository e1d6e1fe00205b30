"""Command line: queries over files of delimited text and SQLite tables."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .errors import describe

INIT_FILE = "~/.rowsmith_init.py"
#: Output formats by name.
FORMATS = {"csv": (",", "quoted"), "tsv": ("\t", "simple"), "monocolumn": ("\t", "monocolumn"), "input": (None, None)}
COLOURS = [31, 32, 33, 34, 35, 36]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowsmith", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--input", help="file of delimited text, or table of the database")
    p.add_argument("--database", help="SQLite file")
    p.add_argument("--query")
    p.add_argument("--output")
    p.add_argument("--delim")
    p.add_argument("--policy", choices=("simple", "quoted", "quoted_rfc", "whitespace", "monocolumn"))
    p.add_argument("--with-headers", action="store_true")
    p.add_argument("--comment-prefix")
    p.add_argument("--encoding", default="utf-8", choices=("utf-8", "latin-1"))
    p.add_argument("--out-format", default="input", choices=tuple(FORMATS))
    p.add_argument("--out-delim")
    p.add_argument("--out-policy")
    p.add_argument("--error-format", default="hr", choices=("hr", "json"))
    p.add_argument("--init-source-file")
    p.add_argument("--color", action="store_true")
    p.add_argument("--preview", action="store_true", help="show the first 10 records and stop")
    return p


def init_code(path: str | None) -> str:
    where = os.path.expanduser(path or INIT_FILE)
    if path is None and not os.path.exists(where):
        return ""
    with open(where, encoding="utf-8") as f:
        return f.read()


def show(path: str, delim: str, policy: str, colour: bool, out) -> None:
    from .sources.dialect import split

    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.rstrip("\n")
            if colour:
                line = delim.join(f"\033[{COLOURS[k % len(COLOURS)]}m{x}\033[0m" for k, x in enumerate(split(line, delim, policy, keep=True)[0]))
            print(line, file=out)


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    import tempfile

    from . import api, tools
    from .sources import csv, dialect

    args, out = parser().parse_args(argv), out or sys.stdout
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("rowsmith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    target = args.output or tempfile.NamedTemporaryFile(suffix=".out", delete=False).name
    try:
        source = args.input
        if not args.database and source in (None, "-"):  # standard input is small enough for one file
            with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False, encoding="utf-8") as f:
                f.write(sys.stdin.read())
            source = f.name
        delim, policy = args.delim, args.policy
        if not args.database and delim is None:
            delim, policy = tools.detect(spark, source) or ("\t", "simple")
        delim = dialect.delimiter(delim or ",")
        policy = policy or dialect.default_policy(delim)
        out_delim, out_policy = FORMATS[args.out_format]
        out_delim, out_policy = args.out_delim or out_delim or delim, args.out_policy or out_policy or policy
        if args.preview and not args.database:
            table, warnings = csv.read(spark, source, delim, policy, args.encoding, args.with_headers, args.comment_prefix)
            warnings += csv.write(table.df.drop("_rs_nf").limit(10), target, table.header, out_delim, out_policy)
        elif args.query is None:
            raise SystemExit("--query is needed")
        elif args.database:
            warnings = api.query_sqlite(spark, args.query, args.database, args.input, target, out_delim, out_policy, init_code=init_code(args.init_source_file)).warnings
        else:
            warnings = api.query_csv(
                spark, args.query, source, delim, policy, target, out_delim, out_policy, args.encoding, args.with_headers, args.comment_prefix, init_code=init_code(args.init_source_file)
            ).warnings
    except Exception as e:
        kind, message = describe(e)
        if args.error_format == "json":
            import json

            print(json.dumps({"error_type": kind, "error": message}), file=sys.stderr)
        else:
            print(f"Error [{kind}]: {message}", file=sys.stderr)
        return 1
    if not args.output:
        show(target, out_delim, out_policy, args.color, out)
        os.unlink(target)
    for w in warnings:
        print(f"Warning: {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
