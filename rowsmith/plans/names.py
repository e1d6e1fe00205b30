"""Names of fields and counters: ordinals, attributes, keys and bare column names."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParsingError

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(t: T.DataType) -> str:
    """The value kind of a Spark type: str, int, float, bool, list, time or any."""
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, NUMBERS):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "list"
    return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "any"


@dataclass
class Value:
    """A compiled expression: its column, its kind, and what it is named after, if it is a plain field."""

    col: Column
    kind: str
    field: tuple[str, int] | None = None
    element: str = "str"


@dataclass
class Table:
    """A table in a query: the names that users see, and the inner columns ``{side}{k}`` that hold the fields."""

    side: str
    header: list[str] | None
    types: list[T.DataType]

    def inner(self, k: int) -> str:
        return f"{self.side}{k}"

    def value(self, k: int) -> Value:
        if not 0 <= k < len(self.types):  # past the end of the record
            return Value(F.lit(None).cast("string"), "str", (self.side, k))
        t = self.types[k]
        return Value(F.col(self.inner(k)), kind_of(t), (self.side, k), kind_of(t.elementType) if isinstance(t, T.ArrayType) else "str")

    def find(self, name: str) -> int:
        if self.header is None or name not in self.header:
            raise ParsingError(f'Unable to find column "{name}" in table "{self.side}"')
        return len(self.header) - 1 - self.header[::-1].index(name)  # of equal names the last


@dataclass
class Names:
    tables: dict[str, Table]
    bare: bool = False
    uses_counters: bool = False
    updates: bool = False

    def counter(self, name: str) -> Value | None:
        if name == "NU" and self.updates:
            return Value(F.col("aNU"), "int", ("a", -1))
        side, what = {"NR": ("a", "NR"), "NF": ("a", "NF"), "aNR": ("a", "NR"), "aNF": ("a", "NF"), "bNR": ("b", "NR"), "bNF": ("b", "NF")}.get(name, (None, None))
        if side is None or side not in self.tables:
            return None
        self.uses_counters = True
        return Value(F.col(f"{side}{what}"), "int", (side, -1))

    def name(self, name: str) -> Value | None:
        """A plain name: ``a1``, ``NR`` or, when allowed, a column's own name."""
        if found := self.counter(name):
            return found
        if m := re.fullmatch(r"([ab])([1-9]\d*)", name):
            if m[1] in self.tables:
                return self.tables[m[1]].value(int(m[2]) - 1)
        if self.bare:
            sides = [t for t in self.tables.values() if t.header and name in t.header]
            if len(sides) > 1:
                raise ParsingError(f'Ambiguous variable name: "{name}" is present both in input and in join tables')
            if sides:
                return sides[0].value(sides[0].find(name))
        return None

    def member(self, side: str, key: object) -> Value:
        """``a[1]``, ``a["name"]``, ``a.name``; NR and NF are reserved."""
        if side not in self.tables:
            raise ParsingError(f'There is no table "{side}" in this query')
        if isinstance(key, int) and not isinstance(key, bool):
            if key < 1:
                raise ParsingError("Fields are numbered from 1")
            return self.tables[side].value(key - 1)
        if key in ("NR", "NF") and (self.tables[side].header is None or key not in self.tables[side].header):
            return self.counter(f"{side}{key}")
        return self.tables[side].value(self.tables[side].find(str(key)))

    def resolve(self, node: ast.AST) -> Value | None:
        if isinstance(node, ast.Name):
            return self.name(node.id)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in ("a", "b"):
            return self.member(node.value.id, node.attr)
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in ("a", "b") and isinstance(node.slice, ast.Constant):
            return self.member(node.value.id, node.slice.value)
        return None
