"""Predicates of `has`, `is_` and `has_id`, each a function from a column and its type to a boolean column; null means false, so that
filters reach the scan as they are, and whoever negates one says what null means.

Number predicates are false for anything but numbers, string predicates (negated ones too) for anything but strings. A
missing value satisfies only `neq` and `without`. `regex` matches from the start of the string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class P:
    name: str
    build: Callable[[Column, T.DataType], Column]

    def column(self, c: Column, kind: T.DataType) -> Column:
        return self.build(c, kind)


def _flat(values: tuple) -> list:
    if len(values) == 1 and isinstance(values[0], Iterable) and not isinstance(values[0], str):
        return list(values[0])
    return list(values)


def same(c: Column, kind: T.DataType, value) -> Column:
    """Equality that never compares across kinds: a string column equals only strings, a number only numbers."""
    if isinstance(value, bool) != isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType) != isinstance(value, str):
        return F.lit(False) if isinstance(kind, (T.StringType, T.NumericType)) else c == F.lit(value)
    return c == F.lit(value)


def _number(name: str, test: Callable[[Column], Column]) -> P:
    return P(name, lambda c, kind: test(c) if isinstance(kind, T.NumericType) else F.lit(False))


def _string(name: str, test: Callable[[Column], Column]) -> P:
    return P(name, lambda c, kind: test(c) if isinstance(kind, T.StringType) else F.lit(False))


def eq(v) -> P:
    return P("eq", lambda c, kind: same(c, kind, v))


def neq(v) -> P:
    return P("neq", lambda c, kind: c.isNull() | ~same(c, kind, v))


def gt(v) -> P:
    return _number("gt", lambda c: c > v)


def gte(v) -> P:
    return _number("gte", lambda c: c >= v)


def lt(v) -> P:
    return _number("lt", lambda c: c < v)


def lte(v) -> P:
    return _number("lte", lambda c: c <= v)


def inside(low, high) -> P:
    """Strictly between."""
    return _number("inside", lambda c: (c > low) & (c < high))


def between(low, high) -> P:
    """Between, both ends included."""
    return _number("between", lambda c: c.between(low, high))


def outside(low, high) -> P:
    return _number("outside", lambda c: (c < low) | (c > high))


def _any(c: Column, kind: T.DataType, values: list) -> Column:
    out = F.lit(False)
    if values and isinstance(kind, T.StringType):
        return c.isin([v for v in values if isinstance(v, str)])
    if values and isinstance(kind, T.NumericType):
        return c.isin([v for v in values if not isinstance(v, (str, bool))])
    for v in values:
        out = out | same(c, kind, v)
    return out


def within(*values) -> P:
    return P("within", lambda c, kind: _any(c, kind, _flat(values)))


def without(*values) -> P:
    return P("without", lambda c, kind: c.isNull() | ~_any(c, kind, _flat(values)))


def starting_with(s: str) -> P:
    return _string("starting_with", lambda c: c.startswith(s))


def not_starting_with(s: str) -> P:
    return _string("not_starting_with", lambda c: ~c.startswith(s))


def ends_with(s: str) -> P:
    return _string("ends_with", lambda c: c.endswith(s))


def not_ends_with(s: str) -> P:
    return _string("not_ends_with", lambda c: ~c.endswith(s))


def containing(s: str) -> P:
    return _string("containing", lambda c: c.contains(s))


def not_containing(s: str) -> P:
    return _string("not_containing", lambda c: ~c.contains(s))


def regex(pattern: str) -> P:
    return _string("regex", lambda c: c.rlike(f"^(?:{pattern})"))


def not_regex(pattern: str) -> P:
    return _string("not_regex", lambda c: ~c.rlike(f"^(?:{pattern})"))


def as_predicate(value) -> P:
    """A value means equality; a Python callable runs as a vectorised function on the column."""
    if isinstance(value, P):
        return value
    if callable(value):

        def run(c: Column, kind: T.DataType) -> Column:
            def test(batch):
                return batch.map(lambda x: bool(value(x)))

            import pandas as pd

            test.__annotations__ = {"batch": pd.Series, "return": pd.Series}
            return F.pandas_udf(test, "boolean")(c)

        return P("callable", run)
    return eq(value)
