"""Compiles Python expressions to Spark columns, with Python's meaning.

Kinds are tracked statically (str, int, float, bool, list, time, any). What is not covered raises ``NotNative``, and the
caller runs the expression in Python workers instead (see ``fallback``).
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParsingError, SyntaxProblem
from ..plans.names import Names, Value


class NotNative(Exception):
    """The expression has no Spark form."""


def parse_expression(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise SyntaxProblem(f'Unable to parse "{text}": {e.msg}') from None


def truthy(v: Value) -> Column:
    """Python's truth of a value; NULL is false."""
    c = v.col
    if v.kind in ("bool", "match"):
        return F.coalesce(c, F.lit(False))
    if v.kind == "str":
        return F.coalesce(c != "", F.lit(False))
    if v.kind in ("int", "float"):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False)) if v.kind == "list" else c.isNotNull()


def _fails(bad: Column, message: str | Column, col: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message) if isinstance(message, str) else message)).otherwise(col)


def python_text(v: Value) -> Column:
    """str(value), as Python prints it; NULL stays NULL."""
    c = v.col
    if v.kind == "bool":
        return F.when(c, "True").when(~c, "False")
    if v.kind == "float":
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e16)
        # Spark switches to exponents at 1e7 and 1e-3, Python at 1e16 and 1e-4
        plain = F.rtrim(F.regexp_replace(F.format_string("%.17f", d), "0+$", ""))
        text = F.when(d == 0, d.cast("string")).when(whole, F.concat(d.cast("decimal(38,0)").cast("string"), F.lit(".0")))
        text = text.when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").when(F.isnan(d), "nan")
        text = text.when((F.abs(d) < 1e-3) & (F.abs(d) >= 1e-4), plain)
        short = d.cast("string")
        mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
        power = F.substring_index(short, "E", -1).cast("int")
        big = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        middle = (F.abs(d) >= 1e7) & (F.abs(d) < 1e16)
        return text.when(middle, F.regexp_replace(d.cast("decimal(38,12)").cast("string"), "0+$", "")).when(short.contains("E"), big).otherwise(short)
    return c.cast("string")


def to_int(v: Value) -> Column:
    if v.kind == "str":
        text = F.trim(v.col)
        ok = text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")
        return _fails(v.col.isNull() | ~ok, F.concat(F.lit("invalid literal for int(): "), F.coalesce(v.col, F.lit("None"))), F.regexp_replace(text, "_", "").cast("long"))
    if v.kind == "float":
        return F.when(v.col < 0, F.ceil(v.col)).otherwise(F.floor(v.col)).cast("long")
    if v.kind in ("int", "bool"):
        return v.col.cast("long")
    raise NotNative("int")


def to_float(v: Value) -> Column:
    if v.kind == "str":
        text = F.trim(v.col)
        ok = text.rlike(r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|(?i)^\s*[+-]?(inf|infinity|nan)\s*$")
        return _fails(v.col.isNull() | ~ok, F.concat(F.lit("could not convert string to float: "), F.coalesce(v.col, F.lit("None"))), F.regexp_replace(text, "_", "").cast("double"))
    if v.kind in ("int", "float", "bool"):
        return v.col.cast("double")
    raise NotNative("float")


def like(text: Value, pattern: str) -> Column:
    """% is any run, _ any one character, both within a line; there is no escape character."""
    body = "".join({"%": ".*", "_": "."}.get(c, re.escape(c) if not c.isalnum() else c) for c in pattern)
    return F.coalesce(text.col.rlike(f"^(?d:{body})$(?!\\n)"), F.lit(False))


NUMERIC = ("int", "float", "bool")
SIMPLE_PATTERN = re.compile(r"^(?:[\w\s,:;@#%&=<>!~/'\"-]|\\[dDwWsSbt.\\()\[\]{}^$|?*+/-]|[.^$|()?*+]|\[[^\[\]&]*\]|\{\d+(,\d*)?\})*$")
#: What Python takes for white space: the property, and four control characters.
SPACE = r"[\s\x1c-\x1f]"


def java_pattern(p: str) -> str:
    """The pattern with Python's meaning: classes cover Unicode, and only a line feed ends a line."""
    return ("(?dU)" if re.search(r"\\[wWdDsSb]", p) else "(?d)") + p


DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}  # fixed values


class Compiler:
    def __init__(self, names: Names):
        self.names = names

    def compile(self, text: str) -> Value:
        return self.node(parse_expression(text))

    def node(self, n: ast.expr) -> Value:
        if (found := self.names.resolve(n)) is not None:
            return found
        method = getattr(self, f"_{type(n).__name__}", None)
        if method is None:
            raise NotNative(type(n).__name__)
        return method(n)

    def _Constant(self, n: ast.Constant) -> Value:
        kinds = {bool: "bool", int: "int", float: "float", str: "str"}
        if n.value is None:
            return Value(F.lit(None), "none")
        if type(n.value) not in kinds or isinstance(n.value, int) and not -(2**63) <= n.value < 2**63:
            raise NotNative("constant")
        col = F.lit(n.value).cast("long") if type(n.value) is int else F.lit(n.value)
        return Value(col, kinds[type(n.value)])

    def _List(self, n: ast.List | ast.Tuple) -> Value:
        items = [self.node(e) for e in n.elts]
        if not items or len({i.kind for i in items}) > 1:
            raise NotNative("list of several kinds")
        return Value(F.array(*(i.col for i in items)), "list", element=items[0].kind)

    _Tuple = _List

    def _UnaryOp(self, n: ast.UnaryOp) -> Value:
        v = self.node(n.operand)
        if isinstance(n.op, ast.Not):
            return Value(~truthy(v), "bool")
        if v.kind not in ("int", "float") or isinstance(n.op, ast.Invert):
            raise NotNative("unary")
        return Value(-v.col if isinstance(n.op, ast.USub) else v.col, v.kind)

    def _BinOp(self, n: ast.BinOp) -> Value:
        x, y = self.node(n.left), self.node(n.right)
        if x.kind == y.kind == "str" and isinstance(n.op, ast.Add):
            return Value(F.concat(x.col, y.col), "str")
        if x.kind == "str" and y.kind == "int" and isinstance(n.op, ast.Mult):
            return Value(F.repeat(x.col, y.col.cast("int")), "str")
        if x.kind == y.kind == "list" and x.element == y.element and isinstance(n.op, ast.Add):
            return Value(F.concat(x.col, y.col), "list", element=x.element)
        if x.kind not in NUMERIC or y.kind not in NUMERIC:
            raise NotNative("operands")
        a, b = (v.col.cast("long" if v.kind != "float" else "double") for v in (x, y))
        kind = "float" if "float" in (x.kind, y.kind) else "int"
        zero = "division by zero"
        if isinstance(n.op, (ast.Add, ast.Sub, ast.Mult)):
            return Value({ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}[type(n.op)], kind)
        if isinstance(n.op, ast.Div):
            return Value(_fails(b == 0, zero, a.cast("double") / b.cast("double")), "float")
        if isinstance(n.op, ast.FloorDiv):
            if kind == "float":
                low = self._mod(a, b)
                whole = (a - low) / b  # nearly whole: the nearest below, or the one that rounding has just missed
                return Value(_fails(b == 0, zero, F.floor(whole).cast("double") + F.when(whole - F.floor(whole) > 0.5, 1.0).otherwise(0.0)), kind)
            return Value(_fails(b == 0, zero, self._floor_div(a, b)), kind)
        if isinstance(n.op, ast.Mod):
            return Value(_fails(b == 0, zero, self._mod(a, b)), kind)
        if isinstance(n.op, ast.Pow) and kind == "float":
            return Value(F.pow(a, b).cast("double"), kind)
        if isinstance(n.op, ast.Pow) and isinstance(n.right, ast.Constant) and 0 <= n.right.value <= 64:
            return Value(self._power(a, int(n.right.value)), kind)
        raise NotNative("operator")

    @staticmethod
    def _mod(a: Column, b: Column) -> Column:
        """The remainder, with the sign of the divisor."""
        r = a % b
        return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)

    @staticmethod
    def _power(a: Column, n: int) -> Column:
        """Whole powers by squaring, exact to 64 bits; beyond, an error."""
        out = None
        while n:
            if n & 1:
                out = a if out is None else out * a
            n >>= 1
            a = a * a if n else a
        return F.lit(1).cast("long") if out is None else out

    def _floor_div(self, a: Column, b: Column) -> Column:
        low = self._mod(a, b)
        return ((a - low).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")

    def _BoolOp(self, n: ast.BoolOp) -> Value:
        values = [self.node(v) for v in n.values]
        if all(v.kind == "bool" for v in values):
            cols = [truthy(v) for v in values]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if isinstance(n.op, ast.And) else out | c
            return Value(out, "bool")
        kinds = {v.kind for v in values}
        if len(kinds) == 1:  # the value that decides
            out = values[-1].col
            for v in reversed(values[:-1]):
                out = F.when(truthy(v), out if isinstance(n.op, ast.And) else v.col).otherwise(v.col if isinstance(n.op, ast.And) else out)
            return Value(out, kinds.pop(), element=values[0].element)
        raise NotNative("values of several kinds")

    def condition(self, n: ast.expr) -> Column:
        """The truth of an expression, where only its truth matters."""
        if isinstance(n, ast.BoolOp) and self.names.resolve(n) is None:
            cols = [self.condition(v) for v in n.values]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if isinstance(n.op, ast.And) else out | c
            return out
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~self.condition(n.operand)
        return truthy(self.node(n))

    def _IfExp(self, n: ast.IfExp) -> Value:
        x, y = self.node(n.body), self.node(n.orelse)
        kind = self._common(x, y)
        return Value(F.when(self.condition(n.test), x.col).otherwise(y.col), kind, element=x.element)

    @staticmethod
    def _common(x: Value, y: Value) -> str:
        if x.kind == y.kind or y.kind == "none":
            return x.kind
        if x.kind == "none":
            return y.kind
        if {x.kind, y.kind} <= {"int", "float"}:
            return "float"
        raise NotNative("values of several kinds")

    def _Compare(self, n: ast.Compare) -> Value:
        out, left = None, self.node(n.left)
        for op, right_node in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                c = self._member(left, right_node)
                c = ~c if isinstance(op, ast.NotIn) else c
                right = left
            else:
                right = self.node(right_node)
                c = self._compare(op, left, right)
            out = c if out is None else out & c
            left = right
        return Value(out, "bool")

    def _compare(self, op: ast.cmpop, x: Value, y: Value) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if "none" not in (x.kind, y.kind):
                raise NotNative("is")
            v = x if y.kind == "none" else y
            c = ~v.col if v.kind == "match" else v.col.isNull()  # no match is None
            return c if isinstance(op, ast.Is) else ~c
        comparable = "none" in (x.kind, y.kind) or x.kind == y.kind or x.kind in NUMERIC and y.kind in NUMERIC
        if isinstance(op, (ast.Eq, ast.NotEq)):
            if not comparable:
                c = F.lit(False)  # a text never equals a number
            else:
                a, b = (v.col.cast("double") if v.kind in NUMERIC and x.kind != y.kind else v.col for v in (x, y))
                c = a.eqNullSafe(b)
            return c if isinstance(op, ast.Eq) else ~c
        if not comparable or "any" in (x.kind, y.kind):
            raise NotNative("order of different kinds")
        a, b = x.col, y.col
        c = {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]
        return F.coalesce(c, F.lit(False))

    def _member(self, x: Value, n: ast.expr) -> Column:
        if isinstance(n, (ast.List, ast.Tuple, ast.Set)):
            out = F.lit(False)
            for e in n.elts:
                out = out | self._compare(ast.Eq(), x, self.node(e))
            return out
        y = self.node(n)
        if y.kind == "str" and x.kind == "str":
            return F.coalesce(F.contains(y.col, x.col), F.lit(False))
        if y.kind == "list" and y.element == x.kind:
            return F.coalesce(F.array_contains(y.col, x.col), F.lit(False))
        raise NotNative("in")

    def _JoinedStr(self, n: ast.JoinedStr) -> Value:
        parts = []
        for v in n.values:
            if isinstance(v, ast.FormattedValue):
                if v.format_spec is not None or v.conversion not in (-1, 115):
                    raise NotNative("format")
                x = self.node(v.value)
                if x.kind in ("any", "list", "time"):
                    raise NotNative("format")
                parts.append(F.coalesce(python_text(x), F.lit("None")))
            else:
                parts.append(F.lit(v.value))
        return Value(F.concat(*parts), "str")

    def _Subscript(self, n: ast.Subscript) -> Value:
        v = self.node(n.value)
        if v.kind not in ("str", "list"):
            raise NotNative("subscript")
        size = F.char_length(v.col) if v.kind == "str" else F.size(v.col)
        if isinstance(n.slice, ast.Slice):
            if n.slice.step is not None:
                raise NotNative("step")
            place = lambda e, default: default if e is None else self._place(self.node(e), size)
            lo, hi = place(n.slice.lower, F.lit(0)), place(n.slice.upper, size)
            length = F.greatest(hi - lo, F.lit(0))
            if v.kind == "str":
                return Value(F.when(length > 0, v.col.substr(lo + 1, length)).when(v.col.isNotNull(), F.lit("")), "str")
            return Value(F.slice(v.col, lo + 1, length), "list", element=v.element)
        i = self.node(n.slice)
        if i.kind != "int":
            raise NotNative("subscript")
        at = F.when(i.col < 0, i.col + size).otherwise(i.col)
        bad = (at < 0) | (at >= size)
        if v.kind == "str":
            return Value(_fails(bad, "string index out of range", v.col.substr(at.cast("int") + 1, F.lit(1))), "str")
        return Value(_fails(bad, "list index out of range", F.get(v.col, at.cast("int"))), v.element)

    def _place(self, i: Value, size: Column) -> Column:
        if i.kind != "int":
            raise NotNative("slice")
        at = i.col.cast("int")
        return F.least(F.greatest(F.when(at < 0, at + size).otherwise(at), F.lit(0)), size)

    def _Attribute(self, n: ast.Attribute) -> Value:
        v = self.node(n.value)
        if v.kind == "time" and n.attr in ("year", "month", "day", "hour", "minute"):
            return Value(getattr(F, {"day": "dayofmonth"}.get(n.attr, n.attr))(v.col).cast("long"), "int")
        raise NotNative("attribute")

    def _Call(self, n: ast.Call) -> Value:
        if n.keywords:
            raise NotNative("keyword arguments")
        f = n.func
        if isinstance(f, ast.Name):
            return self._function(f.id, n.args)
        if isinstance(f, ast.Attribute):
            path = ast.unparse(f)
            if f.attr == "join" and isinstance(f.value, ast.Constant) and isinstance(f.value.value, str) and len(n.args) == 1:
                x = self.node(n.args[0])
                if x.kind == "list" and x.element == "str":
                    return Value(F.array_join(x.col, f.value.value), "str")
            if isinstance(f.value, ast.Name) and f.value.id in ("math", "re", "random", "datetime") or path.startswith("datetime.datetime"):
                return self._module(path, n.args)
            return self._method(self.node(f.value), f.attr, n.args)
        raise NotNative("call")

    def _function(self, name: str, nodes: list[ast.expr]) -> Value:
        if name in ("LIKE", "like") and len(nodes) == 2:
            text = self.node(nodes[0])
            if text.kind == "str" and isinstance(nodes[1], ast.Constant) and isinstance(nodes[1].value, str):
                return Value(like(text, nodes[1].value), "bool")
            raise NotNative("like")
        args = [self.node(a) for a in nodes]
        if name in ("min", "max", "sum") and len(args) == 1 and args[0].kind in ("str", "int", "float", "bool"):
            raise ParsingError("Aggregate functions are not allowed inside of expressions, and only in SELECT")
        if len(args) == 1:
            v = args[0]
            if name == "int":
                return Value(to_int(v), "int")
            if name == "float":
                return Value(to_float(v), "float")
            if name == "str" and v.kind in ("str", "int", "float", "bool"):
                return Value(F.coalesce(python_text(v), F.lit("None")), "str")
            if name == "bool":
                return Value(truthy(v), "bool")
            if name == "len" and v.kind in ("str", "list"):
                return Value((F.char_length(v.col) if v.kind == "str" else F.size(v.col)).cast("long"), "int")
            if name == "abs" and v.kind in ("int", "float"):
                return Value(F.abs(v.col), v.kind)
            if name == "round" and v.kind == "float":
                return Value(F.bround(v.col, 0).cast("long"), "int")
            if name == "round" and v.kind == "int":
                return v
            if name == "sorted" and v.kind == "list":
                return Value(F.array_sort(v.col), "list", element=v.element)
            if name in ("min", "max") and v.kind == "list":
                return Value((F.array_min if name == "min" else F.array_max)(v.col), v.element)
            if name == "sum" and v.kind == "list" and v.element in ("int", "float"):
                start = F.lit(0).cast("long" if v.element == "int" else "double")
                return Value(F.aggregate(v.col, start, lambda x, y: x + y), v.element)
        if name == "round" and len(nodes) == 2 and isinstance(nodes[1], ast.Constant) and args[0].kind == "float":
            return Value(F.bround(args[0].col, nodes[1].value), "float")
        if name in ("min", "max") and len(args) > 1 and len({a.kind for a in args}) == 1:
            return Value((F.least if name == "min" else F.greatest)(*(a.col for a in args)), args[0].kind)
        raise NotNative(name)

    def _module(self, path: str, nodes: list[ast.expr]) -> Value:
        if path == "random.random" and not nodes:
            return Value(F.rand(), "float")
        if path == "datetime.datetime.strptime" and len(nodes) == 2 and isinstance(nodes[1], ast.Constant):
            form = nodes[1].value
            for code, letters in DATE_CODES.items():
                form = form.replace(code, letters)
            if "%" in form:
                raise NotNative("date format")
            return Value(F.to_timestamp_ntz(self.node(nodes[0]).col, F.lit(form)), "time")
        args = [self.node(a) for a in nodes]
        if path in ("math.sqrt", "math.exp", "math.log", "math.sin", "math.cos", "math.log10", "math.log2") and len(args) == 1 and args[0].kind in NUMERIC:
            x = args[0].col.cast("double")
            bad = {"math.sqrt": x < 0, "math.log": x <= 0, "math.log10": x <= 0, "math.log2": x <= 0}.get(path)
            name = path.split(".")[1]
            out = (F.ln if name == "log" else getattr(F, name))(x)
            return Value(_fails(bad, "math domain error", out) if bad is not None else out, "float")
        if path in ("math.floor", "math.ceil") and len(args) == 1 and args[0].kind in NUMERIC:
            return Value(getattr(F, path.split(".")[1])(args[0].col).cast("long"), "int")
        if path in ("re.search", "re.match", "re.sub", "re.findall") and isinstance(nodes[0], ast.Constant) and SIMPLE_PATTERN.match(str(nodes[0].value)):
            p, text = str(nodes[0].value), args[-1]
            if text.kind != "str":
                raise NotNative("re")
            plain, p = p, java_pattern(p)
            if path in ("re.search", "re.match") and len(args) == 2:  # only their truth is of use here
                return Value(F.coalesce(text.col.rlike(p if path == "re.search" else java_pattern(f"^(?:{plain})")), F.lit(False)), "match")
            if path == "re.sub" and len(args) == 3 and isinstance(nodes[1], ast.Constant) and not re.search(r"[\\$]", nodes[1].value):
                return Value(F.regexp_replace(text.col, p, nodes[1].value), "str")
            if path == "re.findall" and len(args) == 2 and "(" not in plain:
                return Value(F.regexp_extract_all(text.col, F.lit(p), F.lit(0)), "list", element="str")
        raise NotNative(path)

    def _method(self, v: Value, name: str, nodes: list[ast.expr]) -> Value:
        args = [self.node(a) for a in nodes]
        if v.kind != "str":
            raise NotNative(name)
        c, n = v.col, len(args)
        texts = all(a.kind == "str" for a in args)
        if n == 0:
            simple = {"upper": F.upper, "lower": F.lower}
            if name in simple:
                return Value(simple[name](c), "str")
            ends = {"strip": rf"(?U)^{SPACE}+|{SPACE}+\z", "lstrip": rf"(?U)^{SPACE}+", "rstrip": rf"(?U){SPACE}+\z"}
            if name in ends:
                return Value(F.regexp_replace(c, ends[name], ""), "str")
            if name == "split":
                t = F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")
                return Value(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"(?U){SPACE}+")), "list", element="str")
            if name in ("isdigit", "isalpha"):
                return Value(F.coalesce(c.rlike(r"^\p{Nd}+$" if name == "isdigit" else r"^\p{L}+$"), F.lit(False)), "bool")
        if not texts:
            if name == "zfill" and n == 1 and args[0].kind == "int":
                pad = F.greatest(args[0].col.cast("int") - F.char_length(c), F.lit(0))
                sign = F.when(c.rlike("^[+-]"), F.substring(c, 1, 1)).otherwise("")
                return Value(F.concat(sign, F.repeat(F.lit("0"), pad), F.when(sign != "", c.substr(F.lit(2), F.char_length(c))).otherwise(c)), "str")
            raise NotNative(name)
        if n == 1:
            x = args[0].col
            if name in ("startswith", "endswith"):
                return Value(F.coalesce(getattr(F, name)(c, x), F.lit(False)), "bool")
            if name == "find":
                return Value((F.when(x == "", 1).otherwise(F.instr(c, x)) - 1).cast("long"), "int")
            if name == "count" and isinstance(nodes[0], ast.Constant) and nodes[0].value:
                return Value(((F.char_length(c) - F.char_length(F.replace(c, x, F.lit("")))) / len(nodes[0].value)).cast("long"), "int")
            if name == "split" and isinstance(nodes[0], ast.Constant) and nodes[0].value:
                return Value(F.split(c, re.sub(r"([^\w\s])", r"\\\1", nodes[0].value), -1), "list", element="str")
        if n == 2 and name == "replace" and isinstance(nodes[0], ast.Constant) and nodes[0].value:
            return Value(F.replace(c, args[0].col, args[1].col), "str")
        raise NotNative(name)
