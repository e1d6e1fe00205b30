"""Finding tables by name: paths, an index file of names, SQLite tables."""

from __future__ import annotations

import os
import re
import sqlite3

from pyspark.sql import SparkSession

from ..errors import HandlingError
from ..operators.lower import Input
from .memory import from_rows

#: A text file with a name and a path in each line, separated by a tab.
INDEX = "~/.rowsmith_table_names"
MAX_NAMES = 100


def names(index: str = INDEX) -> dict[str, str]:
    path = os.path.expanduser(index)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return dict(line.rstrip("\n").split("\t", 1) for line in f if "\t" in line)


def remember(name: str, path: str, index: str = INDEX) -> None:
    """Give a table a name; of more than MAX_NAMES the oldest are forgotten."""
    known = {k: v for k, v in names(index).items() if k != name} | {name: path}
    with open(os.path.expanduser(index), "w", encoding="utf-8") as f:
        f.writelines(f"{k}\t{v}\n" for k, v in list(known.items())[-MAX_NAMES:])


def find_path(name: str, beside: str | None = None, index: str = INDEX) -> str:
    """A path as given, beside the main table, or from the index."""
    own = os.path.expanduser(name)
    options = [own, os.path.join(os.path.dirname(os.path.expanduser(beside)), name)] if beside else [own]
    for path in [*options, names(index).get(name, "")]:
        if path and os.path.exists(os.path.expanduser(path)):
            return os.path.expanduser(path)
    raise HandlingError(f'Unable to find join table "{name}"')


def sqlite_table(spark: SparkSession, database: str, table: str | None = None) -> Input:
    """A table of an SQLite file; without a name, its only one."""
    with sqlite3.connect(os.path.expanduser(database)) as db:
        held = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        if table is None:
            if len(held) != 1:
                raise HandlingError(f"Name one of the tables: {', '.join(held)}")
            table = held[0]
        if not re.fullmatch("[a-zA-Z0-9_]*", table):
            raise HandlingError(f'Unable to use "{table}": table names have letters, digits and underscores')
        if table not in held:
            raise HandlingError(f'Unable to find table "{table}"')
        cursor = db.execute(f"SELECT * FROM {table}")
        return from_rows(spark, [list(r) for r in cursor], [d[0] for d in cursor.description])
