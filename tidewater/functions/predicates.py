"""Comparisons of a column with a literal, and of two join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError

_NATIVE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def compare(column: Column, kind: T.DataType, op: str, value: int | str) -> Column:
    """``column op value``.

    Numbers come before strings, so comparing across the two is decided by the
    types alone; a null (external tables only) still compares as unknown.
    """
    if is_number(kind) and isinstance(value, int):
        return _NATIVE[op](column, F.lit(value))
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return _NATIVE[op](column, F.lit(value))
    if is_number(kind):
        holds = op in ("<", "<=", "!=")
    elif isinstance(kind, T.StringType):
        holds = op in (">", ">=", "!=")
    else:
        raise BindError(f"a {kind.simpleString()} column can't be compared with a literal")
    return column.isNotNull() if holds else F.lit(False)


def keys_equal(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Equality of join keys: as numbers if both are, else as their texts."""
    if is_number(a_kind) and is_number(b_kind) or a_kind == b_kind:
        return a == b
    return a.cast("string") == b.cast("string")
