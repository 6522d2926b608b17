"""SQL expressions as text.

A plan of many rules has thousands of nodes.  Made node by node they cost a call
to the JVM each; as text, the parser makes them all in one.  ``Sql`` has the
operators of a Column, ``X.name(...)`` is the SQL function of that name, with
Python lambdas for lambda arguments; ``column()`` gives the Column.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"
    return str(v)


def text_of(v) -> str:
    return v.sql if isinstance(v, Sql) else literal(v)


def _op(mark: str, swap: bool = False) -> Callable:
    def f(self: Sql, other) -> Sql:
        a, b = (text_of(other), self.sql) if swap else (self.sql, text_of(other))
        return Sql(f"({a} {mark} {b})")

    return f


class Sql:
    __slots__ = ("name", "sql")

    def __init__(self, sql: str, name: str | None = None):
        self.sql, self.name = sql, name

    __add__, __sub__, __mul__, __truediv__, __mod__ = _op("+"), _op("-"), _op("*"), _op("/"), _op("%")
    __radd__, __rsub__, __rmul__ = _op("+", True), _op("-", True), _op("*", True)
    __and__, __or__ = _op("AND"), _op("OR")
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = _op("="), _op("<>"), _op("<"), _op("<="), _op(">"), _op(">=")
    __hash__ = None
    eqNullSafe = _op("<=>")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.sql})")

    def __getitem__(self, key) -> Sql:
        return Sql(f"{self.sql}.`{key}`" if isinstance(key, str) else f"{self.sql}[{text_of(key)}]")

    def alias(self, name: str) -> Sql:
        return Sql(self.sql, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.sql} AS {kind})")

    def isNull(self) -> Sql:
        return Sql(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self.sql} IS NOT NULL)")

    def between(self, a, b) -> Sql:
        return Sql(f"({self.sql} BETWEEN {text_of(a)} AND {text_of(b)})")

    def isin(self, *values) -> Sql:
        return Sql(f"({self.sql} IN ({', '.join(map(text_of, values))}))") if values else Sql("false")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"rlike({self.sql}, {literal(pattern)})")

    def contains(self, other) -> Sql:
        return Sql(f"contains({self.sql}, {text_of(other)})")

    def column(self) -> Column:
        out = F.expr(self.sql)
        return out.alias(self.name) if self.name else out


class Case(Sql):
    """CASE whose branches can be added to; without ``otherwise`` it is null there."""

    __slots__ = ("branches",)

    def __init__(self, branches: str):
        super().__init__(f"(CASE {branches} END)")
        self.branches = branches

    def when(self, test: Sql, value) -> Case:
        return Case(f"{self.branches} WHEN {test.sql} THEN {text_of(value)}")

    def otherwise(self, value) -> Sql:
        return Sql(f"(CASE {self.branches} ELSE {text_of(value)} END)")


def _lambda(f: Callable) -> str:
    names = [f"v{next(_names)}" for _ in inspect.signature(f).parameters]
    left = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{left} -> {text_of(f(*map(Sql, names)))}"


class _Functions:
    def __getattr__(self, name: str) -> Callable[..., Sql]:
        def call(*args) -> Sql:
            return Sql(f"{name}({', '.join(_lambda(a) if callable(a) else text_of(a) for a in args)})")

        return call

    @staticmethod
    def lit(v) -> Sql:
        return Sql(literal(v))

    @staticmethod
    def col(name: str) -> Sql:
        return Sql(f"`{name}`", name)

    @staticmethod
    def struct(*parts: Sql) -> Sql:
        return Sql(f"named_struct({', '.join(f'{literal(p.name)}, {p.sql}' for p in parts)})")

    @staticmethod
    def when(test: Sql, value) -> Case:
        return Case(f"WHEN {test.sql} THEN {text_of(value)}")

    @staticmethod
    def create_map(*parts) -> Sql:
        return Sql(f"map({', '.join(map(text_of, parts))})")


X = _Functions()
