"""Lowers a parsed query to DataFrame operations.

Order: scan, JOIN, WHERE, then UPDATE or SELECT with UNNEST or aggregates, then sort, DISTINCT, TOP. Record numbers and
order columns are added only where the query's result depends on them.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError, HandlingError, ParsingError, SyntaxProblem
from ..functions.compiler import Compiler, NotNative, parse_expression, python_text
from ..functions.fallback import compile_in_python
from ..plans.clauses import Item, Query
from ..plans.names import Names, Table, Value
from .aggregates import AGGREGATES, aggregate, median, number, whole_texts
from .counters import with_order, with_record_number, with_running_count


@dataclass
class Input:
    """A DataFrame with its header (None: no names)."""

    df: DataFrame
    header: list[str] | None


@dataclass
class Options:
    bare_names: bool = False
    init_code: str = ""
    functions: dict[str, Any] = field(default_factory=dict)
    #: Rows come in the order of the input also after a JOIN or DISTINCT, at the price of a sort.
    in_order: bool = False


def mentions(text: str, *names: str) -> bool:
    """Whether an expression uses one of the counters, other than inside a literal."""
    try:
        tree = parse_expression(text)
    except SyntaxProblem:
        return False  # reported where the expression is compiled
    return any(isinstance(n, ast.Name) and n.id in names or isinstance(n, ast.Attribute) and n.attr in names for n in ast.walk(tree))


def prepare(source: Input, side: str, counters: bool, ordered: bool) -> tuple[DataFrame, Table]:
    """Rename fields to ``{side}{k}`` and add the counters that are asked for."""
    df = source.df
    width = [f for f in df.schema if f.name != "_rs_nf"]
    cols = [F.col(f"`{f.name}`") if f.name.count("`") == 0 else df[f.name] for f in width]
    if len(set(df.columns)) < len(df.columns):
        df, cols = df.toDF(*(f"_c{k}" for k in range(len(df.columns)))), [F.col(f"_c{k}") for k in range(len(width))]
    nf = F.col("_rs_nf") if "_rs_nf" in source.df.columns else F.lit(len(width))
    out = df.select(*(c.alias(f"{side}{k}") for k, c in enumerate(cols)), nf.cast("long").alias(f"{side}NF"))
    if counters:
        out = with_record_number(out, f"{side}NR")
    elif ordered:
        out = with_order(out, f"{side}NR")
    return out, Table(side, source.header, [f.dataType for f in width])


class Lowering:
    def __init__(self, query: Query, a: Input, b: Input | None, options: Options):
        self.q, self.options = query, options
        if b is not None and (a.header is None) != (b.header is None):
            raise HandlingError("Inconsistent modes: the input and the join table must both have a header, or neither")
        texts = [*(i.text for i in query.items), *query.order, *query.group, query.where or "", *(e for _, e in query.updates), *(x for p in (query.join.pairs if query.join else []) for x in p)]
        numbers = any(mentions(t, "NR", "aNR", "bNR") for t in texts)
        self.aggregated = any(self._aggregate_call(i.text) for i in query.items if not i.star)
        unordered = not query.order and query.top is None and not any("ARRAY_AGG" in t.upper() for t in texts)
        self.ordered = not unordered or query.distinct and query.top is not None or options.in_order and bool(query.distinct or query.join)
        df, ta = prepare(a, "a", numbers, self.ordered)
        self.names = Names({"a": ta}, bare=options.bare_names)
        self.check: tuple[Column, str] | None = None
        if query.join:
            right, tb = prepare(b, "b", numbers, self.ordered)
            self.names.tables["b"] = tb
            df = self._join(df, right)
        self.df = df
        self.header: list[str] | None = None

    # expressions

    def _checked(self, condition: Column) -> Column:
        """The condition, which fails where the join's check does: as one expression it can't be moved below the join."""
        if self.check is None:
            return condition
        ok, message = self.check
        return F.when(ok, condition).otherwise(F.raise_error(F.lit(message)).cast("boolean"))

    def value(self, text: str | ast.expr, want: T.DataType | None = None) -> Value:
        tree = parse_expression(text) if isinstance(text, str) else text
        self._no_aggregates(tree)
        try:
            return Compiler(self.names).node(tree)
        except NotNative:
            return compile_in_python(tree, self.names, self.df, self.options.init_code, self.options.functions, want)

    def condition(self, text: str) -> Column:
        tree = parse_expression(text)
        self._no_aggregates(tree)
        try:
            return Compiler(self.names).condition(tree)
        except NotNative:
            return compile_in_python(tree, self.names, self.df, self.options.init_code, self.options.functions, T.BooleanType()).col

    @staticmethod
    def _aggregate_call(text: str) -> ast.Call | None:
        try:
            tree = parse_expression(text)
        except Exception:
            return None
        if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name) and tree.func.id in AGGREGATES and len(tree.args) in (1, 2):
            name = tree.func.id
            # lower-case min, max and sum are Python's own for several arguments or a list
            if name in ("min", "max", "sum") and (len(tree.args) > 1 or isinstance(tree.args[0], (ast.List, ast.Tuple, ast.ListComp, ast.GeneratorExp)) or _splits(tree.args[0])):
                return None
            return tree
        return None

    @staticmethod
    def _no_aggregates(tree: ast.expr) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in AGGREGATES and n.func.id not in ("min", "max", "sum"):
                raise ParsingError("Aggregate functions are not allowed inside of expressions, and only in SELECT")

    # join

    def _join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        on: Column | None = None
        keys: list[Column] = []
        for x, y in self.q.join.pairs:
            vx, vy = (self.names.resolve(parse_expression(s)) for s in (x, y))
            if vx is None or vy is None or {vx.field[0], vy.field[0]} != {"a", "b"}:
                raise ParsingError(f'Invalid join condition "{x} == {y}": one side must be a field of the input table, the other of the join table')
            if vx.field[0] == "b":
                vx, vy = vy, vx
            for v in (vx, vy):
                if v.field[1] >= len(self.names.tables[v.field[0]].types):
                    raise ExecutionError(f'No "{v.field[0]}{v.field[1] + 1}" field at record 1')
            numeric = ("int", "float", "bool")
            if vx.kind != vy.kind and not (vx.kind in numeric and vy.kind in numeric):
                same = F.lit(False)  # a text never equals a number
            else:
                same = vx.col.eqNullSafe(vy.col)
            on = same if on is None else on & same
            keys.append(vy.col)
        kind = self.q.join.kind
        updates = self.q.is_update
        if kind == "strict" or updates:
            right = right.withColumn("_rs_matches", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        if not updates:
            right = right.withColumn("_rs_hit", F.lit(True)) if kind in ("left", "strict") else right
        else:
            right = right.withColumn("_rs_hit", F.lit(True))
        out = left.join(right, on, "inner" if kind == "inner" and not updates else "left")
        if kind == "strict":  # part of the filter, so that it is neither pruned nor run after WHERE
            self.check = F.coalesce("_rs_matches", F.lit(0)) == 1, 'In "STRICT LEFT JOIN" each record of the input table must have exactly one match in the join table'
        if updates:
            one = F.coalesce("_rs_matches", F.lit(0)) <= 1
            out = out.filter(F.when(one, F.lit(True)).otherwise(F.raise_error(F.lit("More than one record in UPDATE query matched a key from the input table in the join table")).cast("boolean")))
        if kind == "left" and not updates:
            width = len(self.names.tables["b"].types)
            out = out.withColumn("bNF", F.coalesce("bNF", F.lit(width).cast("long")))
        return out

    # statements

    def run(self) -> DataFrame:
        q = self.q
        if q.is_update:
            return self._update()
        if q.where or self.check:
            self.df = self.df.filter(self._checked(self.condition(q.where) if q.where else F.lit(True)))
        if q.excluded is not None:
            return self._finish(self._except())
        if self.aggregated:
            return self._aggregate()
        return self._finish(self._items())

    def _update(self) -> DataFrame:
        table, q = self.names.tables["a"], self.q
        hit = self.condition(q.where) if q.where else F.lit(True)
        if q.join and q.join.kind == "inner":
            hit = F.coalesce("_rs_hit", F.lit(False)) & hit
        if any(mentions(e, "NU") for _, e in q.updates):
            self.df = with_running_count(self.df.withColumn("_rs_where", hit), F.col("_rs_where"), "aNU")
            hit, self.names.updates = F.col("_rs_where"), True
        new: dict[int, Value] = {}
        for target, text in q.updates:
            v = self.names.resolve(parse_expression(target))
            if v is None or v.field[0] != "a" or v.field[1] < 0:
                raise ParsingError(f'Unable to update "{target}": it is not a field of the input table')
            if v.field[1] >= len(table.types):
                raise ExecutionError(f'No "a{v.field[1] + 1}" field at record 1')
            new[v.field[1]] = self.value(text)
        cols = []
        for k, t in enumerate(table.types):
            old = F.col(table.inner(k))
            if k in new:
                v = new[k]
                old = F.when(hit, self._as(v, t)).otherwise(old)
            cols.append(old)
        self.header = table.header
        return self._output(self.df, cols, [None] * len(cols), [f"a{k + 1}" for k in range(len(cols))])

    @staticmethod
    def _as(v: Value, t: T.DataType) -> Column:
        return python_text(v) if isinstance(t, T.StringType) and v.kind in ("int", "float", "bool") else v.col.cast(t)

    def _except(self) -> tuple[list[Column], list[str | None]]:
        table, gone = self.names.tables["a"], set()
        for text in self.q.excluded:
            v = self.names.resolve(parse_expression(text))
            if v is None or v.field[1] < 0 or v.field[1] >= len(table.types):
                raise ParsingError(f'Unknown field in EXCEPT expression: "{text}"')
            gone.add(v.field[1])
        keep = [k for k in range(len(table.types)) if k not in gone]
        return [F.col(table.inner(k)) for k in keep], [table.header[k] if table.header else None for k in keep]

    def _named(self, v: Value, item: Item) -> str | None:
        if item.alias:
            return item.alias
        if v.field and v.field[1] >= 0:
            header = self.names.tables[v.field[0]].header
            return header[v.field[1]] if header and v.field[1] < len(header) else None
        if v.field:
            return item.text if item.text in ("NR", "NF", "aNR", "bNR", "aNF", "bNF") else None
        return None

    def _items(self) -> tuple[list[Column], list[str | None]]:
        cols, names, unnested = [], [], False
        for item in self.q.items:
            if item.star:
                for side in item.star:
                    if side not in self.names.tables:
                        if item.star == side:
                            raise ParsingError(f'There is no table "{side}" in this query')
                        continue
                    t = self.names.tables[side]
                    cols += [F.col(t.inner(k)) for k in range(len(t.types))]
                    names += t.header or [None] * len(t.types)
                continue
            tree = parse_expression(item.text)
            if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name) and tree.func.id.lower() in ("unnest", "unfold"):
                if unnested or len(tree.args) != 1:
                    raise ParsingError("Only one UNNEST is allowed per query, with one list")
                unnested = True
                v = self.value(tree.args[0])
                if v.kind == "str":
                    v = Value(F.filter(F.split(v.col, ""), lambda c: c != ""), "list")
                if v.kind != "list":
                    raise ExecutionError("UNNEST needs a list")
                self.df = self.df.select("*", F.posexplode(v.col).alias("_rs_pos", "_rs_el"))
                cols.append(F.col("_rs_el"))
                names.append(item.alias)
                continue
            v = self.value(tree)
            if item.unpack:
                width = self.df.agg(F.max(F.size(v.col))).first()[0] or 0  # the widest list names the columns
                cols += [F.get(v.col, F.lit(k)) for k in range(width)]
                names += [None] * width
                continue
            cols.append(v.col)
            names.append(self._named(v, item))
        return cols, names

    def _finish(self, made: tuple[list[Column], list[str | None]]) -> DataFrame:
        cols, names = made
        q = self.q
        keys = [self.value(k).col for k in q.order]
        ties = [F.col(c) for c in ("aNR", "bNR", "_rs_pos") if c in self.df.columns]
        order = keys + ties if self.ordered else []
        df = self.df.select(*(c.alias(f"_o{k}") for k, c in enumerate(cols)), *(c.alias(f"_s{k}") for k, c in enumerate(order)))
        out, sort = [f"_o{k}" for k in range(len(cols))], [f"_s{k}" for k in range(len(order))]
        if q.distinct:
            extra = [F.count(F.lit(1)).alias("_n")] if q.distinct_count else []
            if sort:
                first = (F.max if q.descending else F.min)(F.struct(*sort))
                df = df.groupBy(*out).agg(first.alias("_first"), *extra).select(*out, "_first.*", *(["_n"] if extra else []))
            else:
                df = df.groupBy(*out).agg(*extra) if extra else df.distinct()
            if q.distinct_count:
                out, names = ["_n", *out], ["count", *names]
        if sort:
            df = df.orderBy(*(F.col(s).desc() if q.descending else F.col(s).asc() for s in sort))
        if q.top is not None:
            df = df.limit(q.top)
        return self._output(df, [F.col(c) for c in out], names, None)

    def _aggregate(self) -> DataFrame:
        q = self.q
        if q.order or q.distinct:
            raise ParsingError('"ORDER BY" and "DISTINCT" are not allowed in aggregate queries')
        keys = [self.value(k).col.alias(f"_k{n}") for n, k in enumerate(q.group)]
        made: list[tuple[ast.Call, Value] | None] = []
        texts = [ast.dump(parse_expression(k)) for k in q.group]
        cols, names = [], []
        for item in q.items:
            if item.star or item.unpack:
                raise ParsingError("A star is not allowed in aggregate queries")
            call = self._aggregate_call(item.text)
            if call:
                v = self.value(call.args[0])
                made.append((call, v))
                cols.append(None)
                names.append(item.alias)
            else:
                v = self.value(item.text)
                made.append(None)
                names.append(self._named(v, item))
                if ast.dump(parse_expression(item.text)) in texts:
                    cols.append(F.first(v.col))
                    continue
                low, high = F.min(v.col), F.max(v.col)
                same = low.eqNullSafe(high) & ((F.count(v.col) == 0) | (F.count(v.col) == F.count(F.lit(1))))
                cols.append(F.when(same, low).otherwise(F.raise_error(F.lit(f'Invalid aggregate expression: non-constant values in output column "{item.text}"'))))
        # texts that are all whole numbers are summed and compared as such: one pass tells, and gives the columns' types
        texts = {k: v for k, m in enumerate(made) if m and (v := m[1]).kind == "str" and AGGREGATES[m[0].func.id] in ("min", "max", "sum")}
        whole = self.df.agg(*(whole_texts(v).alias(f"w{k}") for k, v in texts.items())).first().asDict() if texts else {}
        late = {}
        for k, m in enumerate(made):
            if m and keys and AGGREGATES[m[0].func.id] == "median" and len(m[0].args) == 1:
                late[k] = number(m[1]).cast("double")
            elif m:
                cols[k] = aggregate(*m, self.options, F.col("aNR") if "aNR" in self.df.columns else None, bool(whole.get(f"w{k}")))
        named = [c.alias(f"_o{k}") for k, c in enumerate(cols) if c is not None]
        if keys:
            groups = [f"_k{n}" for n in range(len(keys))]
            df = self.df.groupBy(*keys).agg(*(named or [F.count(F.lit(1)).alias("_rows")]))
            for k, c in late.items():  # a row for each group
                part = median(self.df.select(*keys, c.alias(f"_o{k}")), groups, f"_o{k}").withColumnsRenamed({g: f"{g}_m" for g in groups})
                df = df.join(part, [F.col(g).eqNullSafe(F.col(f"{g}_m")) for g in groups], "left").drop(*(f"{g}_m" for g in groups))
            df = df.orderBy(*groups)
        else:
            df = self.df.agg(*named, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")  # no records, no result
        if q.top is not None:
            df = df.limit(q.top)
        return self._output(df, [F.col(f"_o{k}") for k in range(len(cols))], names, None)

    def _output(self, df: DataFrame, cols: list[Column], names: list[str | None], ordinal: list[str] | None) -> DataFrame:
        """Name the columns: their headers and aliases, ``col1`` ... for the others; repeated names get a number."""
        if self.header is None and not self.q.is_update:
            named = any(t.header for t in self.names.tables.values()) or any(i.alias for i in self.q.items)
            self.header = [n or f"col{k + 1}" for k, n in enumerate(names)] if named else None
        shown = self.header or ordinal or [f"col{k + 1}" for k in range(len(cols))]
        used: dict[str, int] = {}
        final = []
        for n in shown:
            used[n.lower()] = used.get(n.lower(), 0) + 1
            final.append(n if used[n.lower()] == 1 else f"{n}_{used[n.lower()]}")
        return df.select(*(c.alias(n) for c, n in zip(cols, final, strict=True)))


def _splits(node: ast.expr) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "split"
