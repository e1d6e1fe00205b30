"""Runs a Python expression in Arrow-fed Python workers, where it has no Spark form.

The expression sees the fields it names, ``NR``-like counters, the usual modules and what the init code defines.
"""

from __future__ import annotations

import ast
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError
from ..plans.names import Names, Value, kind_of

MODULES = ("datetime", "math", "os", "random", "re", "sys", "time", "json")
CASTS = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "len": T.LongType()}


def sql_like(text: str | None, pattern: str) -> bool:
    body = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern)
    return text is not None and re.match(f"^{body}$", text) is not None


def environment(init_code: str, extra: dict[str, Any] | None) -> dict[str, Any]:
    env: dict[str, Any] = {m: __import__(m) for m in MODULES} | {"LIKE": sql_like, "like": sql_like}
    if init_code:
        exec(init_code, env)  # the user's own code, as with any expression
    return env | (extra or {})


class _Replace(ast.NodeTransformer):
    """Puts parameters in the place of fields."""

    def __init__(self, names: Names):
        self.names, self.values, self.keys = names, [], {}

    def visit(self, node: ast.AST) -> ast.AST:
        found = self.names.resolve(node)
        if found is None:
            return self.generic_visit(node)
        key = str(found.field)
        if key not in self.keys:
            self.keys[key] = len(self.values)
            self.values.append(found)
        return ast.copy_location(ast.Name(f"field_{self.keys[key]}", ast.Load()), node)


def _type_of(value: Any) -> T.DataType | None:
    if isinstance(value, bool):
        return T.BooleanType()
    for kind, t in ((int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
        if isinstance(value, kind):
            return t
    if isinstance(value, (list, tuple)):
        inner = {_type_of(v) for v in value if v is not None} or {T.StringType()}
        return T.ArrayType(inner.pop() if len(inner) == 1 else T.StringType())
    return None


def _codes(value: Any) -> list[str]:
    """The types found in a value, as texts: b, i, f, s, and for a list a, then a with each of its elements' codes."""
    if value is None:
        return []
    if isinstance(value, (list, tuple)):
        return sorted({"a"} | {"a" + c for v in value for c in _codes(v)})
    return ["b" if isinstance(value, bool) else "i" if isinstance(value, int) else "f" if isinstance(value, float) else "s"]


def _common(codes: set[str]) -> T.DataType:
    """The type that holds all values of these codes: text, where nothing narrower does."""
    if codes and all(c[0] == "a" for c in codes):
        return T.ArrayType(_common({c[1:] for c in codes} - {""}))
    if codes and codes <= {"i", "f"}:
        return T.DoubleType() if "f" in codes else T.LongType()
    return T.BooleanType() if codes == {"b"} else T.StringType()


def _fit(value: Any, t: T.DataType) -> Any:
    """A value as one of a type found over all rows; another type (of an expression that changes from run to run) is an error."""
    if value is None:
        return None
    if isinstance(t, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(t, T.ArrayType) and isinstance(value, (list, tuple)):
        return [_fit(v, t.elementType) for v in value]
    found = _common(set(_codes(value)))
    if found == t or isinstance(t, T.DoubleType) and isinstance(found, T.LongType):
        return float(value) if isinstance(t, T.DoubleType) else value
    raise TypeError(f"{value!r} is not of the type {t.simpleString()} that the other results have")


def compile_in_python(tree: ast.expr, names: Names, df: DataFrame, init_code: str = "", extra: dict[str, Any] | None = None, want: T.DataType | None = None) -> Value:
    """A value computed by workers. Its type is that of an outermost cast, else the one that holds the results of all rows of ``df``."""
    replace = _Replace(names)
    body = ast.fix_missing_locations(ast.Expression(replace.visit(tree)))
    text, count = ast.unparse(body), len(replace.values)

    def run(*args: Any) -> Any:
        key = (text, init_code)
        code = _CODE.get(key)
        if code is None:
            code = _CODE[key] = (compile(text, "<expression>", "eval"), environment(init_code, extra))
        scope = dict(zip((f"field_{k}" for k in range(count)), args, strict=True))
        return eval(code[0], code[1] | scope)

    def found_types() -> set[str]:
        def codes(*args: Any) -> list[str]:
            try:
                return _codes(run(*args))
            except Exception as e:  # the row may be one that the query leaves out; if not, its value is an error again
                return [f"!{e}"]

        if count:
            types = F.udf(codes, T.ArrayType(T.StringType()), useArrow=True)(*(v.col for v in replace.values))
            found = {r.c for r in df.select(F.explode(types).alias("c")).distinct().collect()}
        else:
            found = set(codes())
        good = {c for c in found if c[0] != "!"}
        if found and not good:
            raise ExecutionError(f"At record 1, Details: {min(found)[1:]}")
        return good

    t = want
    if t is None and isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name):
        t = CASTS.get(tree.func.id)
    inferred = t is None
    if inferred:
        t = _common(found_types())
    as_text = isinstance(t, T.StringType)

    def safe(*args: Any) -> Any:
        out = run(*args)
        if inferred:
            return _fit(out, t)
        if isinstance(t, T.BooleanType):
            return bool(out)
        if isinstance(t, T.DoubleType) and isinstance(out, int):
            return float(out)
        return str(out) if as_text and out is not None and not isinstance(out, str) else list(out) if isinstance(out, tuple) else out

    call = F.udf(safe, t, useArrow=True)
    col = call(*(v.col for v in replace.values)) if count else call()
    return Value(col, kind_of(t), element=kind_of(t.elementType) if isinstance(t, T.ArrayType) else "str")


_CODE: dict[tuple[str, str], tuple[Any, dict[str, Any]]] = {}
