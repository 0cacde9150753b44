"""Expression trees to Columns, with the numeric semantics of vectorized array expressions.

Where Spark SQL differs from arrays: integers divide to floors, a float divided by zero is inf or nan, remainders take the
divisor's sign, nan equals nothing and orders after nothing, & | ^ ~ act on the bits of integers and the truth of booleans,
and calling a column indexes inside its rows. Integer division or remainder by zero gives 0. Null stays null.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions import registry as reg
from skyframe.plans.parser import QueryError

FLOATS = (T.FloatType, T.DoubleType)


def _is_truth(n: ast.expr) -> bool:
    """Whether an expression is true or false by its form."""
    if isinstance(n, ast.BinOp):
        return isinstance(n.op, (ast.BitAnd, ast.BitOr)) and _is_truth(n.left) and _is_truth(n.right)
    if isinstance(n, ast.UnaryOp):
        return isinstance(n.op, ast.Not) or isinstance(n.op, ast.Invert) and _is_truth(n.operand)
    return isinstance(n, (ast.Compare, ast.BoolOp)) or isinstance(n, ast.Call) and ast.unparse(n.func).rpartition(".")[2] in ("in1d", "isin")


class Lookup:
    """In-query map: ``table`` (DataFrame or dict) by ``key`` to ``values``; what is not there is ``missing`` (zero)."""

    def __init__(self, table, key: str = "key", values: tuple[str, ...] = ("value",), missing=None):
        self.table, self.key, self.values, self.missing = table, key, tuple(values), missing

    def frame(self, spark) -> DataFrame:
        if isinstance(self.table, dict):
            return spark.createDataFrame(list(self.table.items()), [self.key, self.values[0]])
        return self.table


class Translator:
    """Translates expressions over ``frame``. ``resolve(name)`` gives the Column of a plain name or None; ``member(table,
    name)`` that of a qualified one. A lookup joins its table to ``frame``, so use ``frame`` afterwards."""

    def __init__(self, frame: DataFrame, resolve: Callable, member: Callable, functions: reg.Registry, variables: dict, fetch: Callable | None = None):
        self.frame, self.resolve, self.member = frame, resolve, member
        self.functions, self.variables, self.lookups, self.fetch = functions, variables, 0, fetch

    # -------------------------------------------------------------- types
    def kind(self, c: Column) -> T.DataType:
        return self.frame.select(c.alias("x")).schema[0].dataType

    def _both(self, a: Column, b: Column) -> tuple[T.DataType, T.DataType]:
        s = self.frame.select(a.alias("a"), b.alias("b")).schema
        return s[0].dataType, s[1].dataType

    # -------------------------------------------------------------- entry
    def columns(self, tree: ast.expr, label: str) -> list[tuple[str, Column]]:
        """A selected item as named columns: tuples give label[0], label[1]..., structs their fields' names."""
        if isinstance(tree, ast.Tuple):
            return [(f"{label}[{i}]", self.column(e)) for i, e in enumerate(tree.elts)]
        c = self.column(tree)
        kind = self.kind(c)
        if isinstance(kind, T.StructType):
            return [(f.name, c.getField(f.name)) for f in kind.fields]
        return [(label, c)]

    def column(self, tree: ast.expr) -> Column:
        value = self.visit(tree)
        if isinstance(value, Column):
            return value
        if isinstance(value, (int, float, str, bool)) or value is None:
            return F.lit(value)
        raise QueryError(f"{ast.unparse(tree)} is not a column")

    def conditions(self, tree: ast.expr) -> list[Column]:
        """A WHERE clause as conditions that must all be true (null is not), as plain as they can be."""
        if isinstance(tree, ast.BoolOp) and isinstance(tree.op, ast.And):
            return [c for v in tree.values for c in self.conditions(v)]
        if isinstance(tree, ast.BinOp) and isinstance(tree.op, ast.BitAnd) and _is_truth(tree):
            return self.conditions(tree.left) + self.conditions(tree.right)
        if isinstance(tree, ast.Compare) and len(tree.ops) == 1 and type(tree.ops[0]) not in (ast.In, ast.NotIn):
            plain, extra = self._comparison(tree)
            if type(tree.ops[0]) is not ast.NotEq:
                return [plain, *[~bad for bad in extra]]
        return [self.column(tree).cast("boolean")]

    def visit(self, node: ast.expr):
        f = getattr(self, f"_{type(node).__name__}", None)
        if f is None:
            raise QueryError(f"{type(node).__name__} is not supported: {ast.unparse(node)}")
        return f(node)

    # -------------------------------------------------------------- leaves
    def _Constant(self, n: ast.Constant):
        if n.value is None or isinstance(n.value, (bool, int, float, str)):
            return n.value if not isinstance(n.value, int) or isinstance(n.value, bool) or n.value < 1 << 63 else n.value - (1 << 64)
        if isinstance(n.value, bytes):
            return n.value.decode()
        raise QueryError(f"constant {n.value!r} is not supported")

    def _Name(self, n: ast.Name):
        if (c := self.resolve(n.id)) is not None:
            return c
        if n.id in self.variables:
            v = self.variables[n.id]
            return v if not hasattr(v, "item") else v.item() if getattr(v, "ndim", 1) == 0 else v.tolist()
        if n.id in reg.CONSTANTS:
            return reg.CONSTANTS[n.id]
        raise QueryError(f"unknown name {n.id!r}")

    def _Attribute(self, n: ast.Attribute):
        name = ast.unparse(n)
        head, _, tail = name.partition(".")
        if (c := self.member(head, tail)) is not None:
            return c
        if head in ("np", "numpy") and tail in reg.CONSTANTS:
            return reg.CONSTANTS[tail]
        if isinstance(self.variables.get(head), dict) and tail in self.variables[head]:
            return self.variables[head][tail]
        if head not in self.variables and tail in reg.FLAGS.get(head, {}):
            return reg.FLAGS[head][tail]
        inner = self.visit(n.value)
        if isinstance(inner, Column) and isinstance(self.kind(inner), T.StructType):
            return inner.getField(n.attr)
        raise QueryError(f"unknown name {name!r}")

    def _Tuple(self, n: ast.Tuple):
        return [self.visit(e) for e in n.elts]

    _List = _Tuple

    # -------------------------------------------------------------- operators
    def _UnaryOp(self, n: ast.UnaryOp):
        v = self.visit(n.operand)
        if not isinstance(v, Column):
            return {ast.USub: lambda x: -x, ast.UAdd: lambda x: +x, ast.Invert: lambda x: (not x) if isinstance(x, bool) else ~x, ast.Not: lambda x: not x}[type(n.op)](v)
        if isinstance(n.op, ast.USub):
            return -v
        if isinstance(n.op, ast.UAdd):
            return v
        return ~v if isinstance(self.kind(v), T.BooleanType) else F.bitwise_not(v)

    def _BinOp(self, n: ast.BinOp):
        a, b = self.visit(n.left), self.visit(n.right)
        op = type(n.op)
        if not isinstance(a, Column) and not isinstance(b, Column):
            a, b = F.lit(a), F.lit(b)
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        ka, kb = self._both(a, b)
        for k in (ka, kb):
            if isinstance(k, T.StringType) and op is not ast.Add:
                raise QueryError(f"text in arithmetic: {ast.unparse(n)}")
        if isinstance(ka, T.StringType) and op is ast.Add:
            return F.concat(a, b.cast("string"))
        truth = isinstance(ka, T.BooleanType) and isinstance(kb, T.BooleanType)
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            if truth:
                return a & b if op is ast.BitAnd else a | b if op is ast.BitOr else a != b
            a, b = (x.cast("int") if isinstance(k, T.BooleanType) else x for x, k in ((a, ka), (b, kb)))
            if any(isinstance(k, FLOATS) for k in (ka, kb)):
                raise QueryError(f"bit operation on floats: {ast.unparse(n)}")
            return {ast.BitAnd: a.bitwiseAND, ast.BitOr: a.bitwiseOR, ast.BitXor: a.bitwiseXOR}[op](b)
        a, b = (x.cast("int") if isinstance(k, T.BooleanType) else x for x, k in ((a, ka), (b, kb)))
        whole = not any(isinstance(k, (*FLOATS, T.DecimalType)) for k in (ka, kb))
        if op is ast.Add:
            return a + b
        if op is ast.Sub:
            return a - b
        if op is ast.Mult:
            return a * b
        if op in (ast.Div, ast.FloorDiv):
            if whole:  # div truncates: one less where the signs differ and something is left over
                d = F.when(b != 0, b)
                t = F.try_divide(a - a % d, d).cast("long")
                return F.when(b == 0, F.lit(0)).otherwise(t - F.when((a % d != 0) & ((a < 0) != (d < 0)), 1).otherwise(0)).cast("long")
            value = reg.true_divide(a, b)
            return value if op is ast.Div else F.floor(value).cast("double")
        if op is ast.Mod:
            if whole:
                d = F.when(b != 0, b)
                return F.when(b == 0, F.lit(0)).otherwise(((a % d) + d) % d)
            return reg.floor_mod(a, b)
        if op is ast.Pow:
            return F.pow(a, b).cast("long") if whole and isinstance(n.right, ast.Constant) and n.right.value >= 0 else F.pow(a, b)
        if op in (ast.LShift, ast.RShift):
            f = F.call_function
            return f("shiftleft" if op is ast.LShift else "shiftright", a, b.cast("int"))
        raise QueryError(f"operator not supported: {ast.unparse(n)}")

    def _Compare(self, n: ast.Compare):
        a, b, op = self.visit(n.left), self.visit(n.comparators[0]), type(n.ops[0])
        if op in (ast.In, ast.NotIn):
            hit = self._among(a, b)
            return hit if op is ast.In else ~hit
        plain, nans = self._comparison(n)
        for bad in nans:
            plain = (plain | bad) if op is ast.NotEq else (plain & ~bad)
        return plain

    def _comparison(self, n: ast.Compare) -> tuple[Column, list[Column]]:
        """Spark's comparison, and the tests for NaN it needs: Spark orders NaN above all and equal to itself, here it is
        neither. Where the other side is a number, a NaN is already below or equal to nothing."""
        a, b, op = self.visit(n.left), self.visit(n.comparators[0]), type(n.ops[0])
        fixed = [not isinstance(x, Column) and x == x for x in (a, b)]
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        ka, kb = self._both(a, b)
        plain = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}.get(op)
        if plain is None:
            raise QueryError(f"comparison not supported: {ast.unparse(n)}")
        fa, fb = (isinstance(k, FLOATS) and not f for k, f in zip((ka, kb), fixed))
        if op in (ast.Gt, ast.GtE):
            return plain, [F.isnan(a)] if fa else []
        if op in (ast.Lt, ast.LtE):
            return plain, [F.isnan(b)] if fb else []
        return plain, [F.isnan(a)] if fa and fb else []

    def _IfExp(self, n: ast.IfExp):
        return F.when(self.column(n.test), self.column(n.body)).otherwise(self.column(n.orelse))

    def _Subscript(self, n: ast.Subscript):
        v = self.visit(n.value)
        if isinstance(v, Column) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            return v.getField(n.slice.value)
        raise QueryError("indexing a whole column has no meaning; call it to index inside its rows: col(i)")

    @staticmethod
    def _among(a, values) -> Column:
        if not isinstance(values, (list, tuple, set)):
            raise QueryError("in needs a list of values")
        c = a if isinstance(a, Column) else F.lit(a)
        known = [v for v in values if v is not None]
        return c.isNotNull() & c.isin(known) if known else F.lit(False)

    # -------------------------------------------------------------- calls
    def _Call(self, n: ast.Call):
        name = ast.unparse(n.func)
        plain = name.removeprefix("np.").removeprefix("numpy.")
        if isinstance(n.func, ast.Attribute) and n.func.attr == "astype":
            return self._astype(self.column(n.func.value), n)
        if plain in ("in1d", "isin"):
            return self._among(self.visit(n.args[0]), self.visit(n.args[1]))
        if name == "fitskw":
            return self._fitskw(n, self.column(n.args[0]))
        if name == "ffitskw":  # the same of files that the first argument names
            if self.fetch is None:
                raise QueryError("ffitskw needs a database")
            uri, text = f"__uri{self.lookups}", f"__file{self.lookups}"
            self.lookups += 1
            self.frame = self.fetch(self.frame.withColumn(uri, self.column(n.args[0])), uri, text)
            return self._fitskw(n, F.decode(F.col(text), "utf-8"))
        target = None
        if isinstance(n.func, ast.Name):
            target = self.variables.get(name)
            if target is None and (c := self.resolve(name)) is not None:
                return self._inside(c, n)
        elif isinstance(n.func, ast.Attribute):
            head, _, tail = name.partition(".")
            if (c := self.member(head, tail)) is not None:
                return self._inside(c, n)
        if isinstance(target, Lookup):
            return self._lookup(target, self.column(n.args[0]))
        found = self.functions.find(name) if target is None else (target, None)
        if found is None:
            if plain in reg.REDUCING:
                raise QueryError(f"{name} reduces a column to one value; use an aggregation on the result")
            raise QueryError(f"unknown function {name!r}")
        f, count = found
        if n.keywords and count is not None:
            raise QueryError(f"{name} takes no named arguments")
        if count is not None and len(n.args) != count:
            raise QueryError(f"{name} takes {count} argument(s), not {len(n.args)}")
        args = [self.column(a) for a in n.args]
        out = f(*args, **{k.arg: ast.literal_eval(k.value) for k in n.keywords})
        if isinstance(out, tuple):
            return F.struct(*[c.alias(f"{name}[{i}]") for i, c in enumerate(out)])
        return out if isinstance(out, Column) else F.lit(out)

    def _astype(self, c: Column, n: ast.Call) -> Column:
        from skyframe.types import spark_type

        arg = n.args[0]
        name = arg.value if isinstance(arg, ast.Constant) else ast.unparse(arg)
        kind = {"float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType(), "str": T.StringType()}.get(str(name)) or spark_type(str(name))
        return c.try_cast(kind)

    def _fitskw(self, n: ast.Call, header: Column) -> Column:
        if len(n.args) < 2 or not isinstance(n.args[1], ast.Constant):
            raise QueryError("fitskw(headers, 'KEYWORD', default) needs a constant keyword")
        default = self.visit(n.args[2]) if len(n.args) > 2 else 0
        kind = "boolean" if isinstance(default, bool) else "string" if isinstance(default, str) else "double"
        one = lambda h: reg.header_value(h, n.args[1].value, kind, default)
        return F.transform(header, one) if isinstance(self.kind(header), T.ArrayType) else one(header)

    def _inside(self, c: Column, n: ast.Call) -> Column:
        """col(i), col(i, j): elements (from 0, negative from the end); col((a, b)), col((a,)), col((a, b, step)): slices."""
        for arg in n.args:
            kind = self.kind(c)
            if not isinstance(kind, T.ArrayType):
                raise QueryError(f"{ast.unparse(n.func)} has no elements to index")
            if isinstance(arg, ast.Tuple):
                a, b, step = [self.visit(e) for e in arg.elts] + [None] * (3 - len(arg.elts))
                size = F.size(c)
                at = lambda v, otherwise: otherwise if v is None else F.when((v if isinstance(v, Column) else F.lit(v)) < 0, F.greatest(size + v, F.lit(0))).otherwise(F.least(v if isinstance(v, Column) else F.lit(v), size))  # noqa: E731, B023
                low, high = at(a, F.lit(0)), at(b, size)
                part = F.slice(c, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
                c = F.filter(part, lambda _, i: i % step == 0) if step not in (None, 1) else part  # noqa: B023
            else:
                i = self.column(arg)
                c = F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i).cast("int"))
        return c

    def _lookup(self, m: Lookup, key: Column) -> Column:
        from skyframe.plans.joins import lookup

        name = f"__map{self.lookups}"
        self.lookups += 1
        self.frame = lookup(self.frame, key, m.frame(self.frame.sparkSession), m.key, list(m.values), m.missing, name)
        got = [F.col(f"`{name}.{v}`") for v in m.values]
        return got[0] if len(got) == 1 else F.struct(*[c.alias(v) for c, v in zip(got, m.values)])
