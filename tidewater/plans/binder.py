"""Syntax trees to DataFrames.

Filters, pruning, join strategy and build side are Catalyst's; only the rows of
keys that give very many rows are laid out here (``spread``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError
from ..functions.predicates import compare, keys_equal
from . import spread
from .parser import Predicate, Select


@dataclass(frozen=True)
class Side:
    """A table in FROM, under an alias of its own."""

    table: str
    alias: str
    schema: T.StructType

    def has(self, name: str) -> bool:
        return name in self.schema.names

    def column(self, name: str) -> Column:
        return F.col(f"{self.alias}.`{name}`")

    def kind(self, name: str) -> T.DataType:
        return self.schema[name].dataType


class Scope:
    def __init__(self, sides: list[Side]) -> None:
        self.sides = sides

    def find(self, name: str) -> tuple[Side, str]:
        """The side and bare name: a bare match on the first side that has it, else by the qualifier before the first dot."""
        if len(self.sides) == 2 and self.sides[0].table == self.sides[1].table:
            raise BindError(f"ambiguous column: {name}")
        for side in self.sides:
            if side.has(name):
                return side, name
        table, dot, bare = name.partition(".")
        if dot:
            for side in self.sides:
                if side.table == table:
                    if side.has(bare):
                        return side, bare
                    raise BindError(f"unknown column: {name}")
            raise BindError(f"unknown table in: {name}")
        raise BindError(f"unknown column: {name}")

    def where(self, predicates: tuple[Predicate, ...]) -> Column | None:
        found = []
        for p in predicates:
            side, name = self.find(p.column)
            found.append(compare(side.column(name), side.kind(name), p.op, p.value))
        return reduce(lambda a, b: a & b, found) if found else None


def _key(side: Side, name: str) -> str | None:
    """The bare column if the name can be one of this side's."""
    if side.has(name):
        return name
    table, dot, bare = name.partition(".")
    return bare if dot and table == side.table and side.has(bare) else None


def join_keys(left: Side, right: Side, a: str, b: str) -> tuple[str, str]:
    """ON's columns as (left's, right's), written either way round."""
    for x, y in ((a, b), (b, a)):
        l, r = _key(left, x), _key(right, y)
        if l is not None and r is not None:
            return l, r
    raise BindError(f"join columns not found: {a}, {b}")


def bind(select: Select, scan: Callable[[str], DataFrame], addressed: Callable[[str, str], DataFrame], folder: str) -> DataFrame:
    """The query's DataFrame.

    ``scan`` gives a table's; ``addressed`` one with a further column, named by
    the second argument, that has a hash of each row's address; ``folder`` is
    where a join's counts of keys are written.
    """
    names = [select.table] + ([select.join.table] if select.join else [])
    frames = [scan(n) for n in names]
    sides = [Side(n, f"_{i}", f.schema) for i, (n, f) in enumerate(zip(names, frames))]
    scope = Scope(sides)
    if select.join:
        a, b = join_keys(*sides, select.join.left, select.join.right)
        keys = [sides[0].column(a), sides[1].column(b)]
        kinds = sides[0].kind(a), sides[1].kind(b)
        on = keys_equal(keys[0], kinds[0], keys[1], kinds[1])
    where = scope.where(select.where)
    if select.columns is None:
        columns = [s.column(c).alias(c) for s in sides for c in s.schema.names]
    else:
        columns = [side.column(name).alias(name) for side, name in map(scope.find, select.columns)]

    def rows(df: DataFrame) -> DataFrame:
        return (df if where is None else df.where(where)).select(*columns)

    if not select.join:
        return rows(frames[0].alias("_0"))
    joined = lambda l, r: l.join(r, on, "inner")

    def own(df: DataFrame, side: Side) -> DataFrame:
        """The side's rows after the predicates on its columns."""
        mine = scope.where(tuple(p for p in select.where if scope.find(p.column)[0] is side))
        df = df.alias(side.alias)
        return df if mine is None else df.where(mine)

    values = spread.common(keys[0], kinds[0], keys[1], kinds[1])
    found = values and spread.crowded(*(own(f, s).select(v.alias("k")) for f, s, v in zip(frames, sides, values)), folder)
    if not found:
        return rows(joined(frames[0].alias("_0"), frames[1].alias("_1")))
    at = f"at_{uuid.uuid4().hex}"
    few = [spread.others(own(f, s), v, found).alias(s.alias) for f, s, v in zip(frames, sides, values)]
    many = [own(addressed(n, at), s) for n, s in zip(names, sides)]
    return rows(joined(*few)).unionAll(rows(spread.cells(many[0], values[0], many[1], values[1], found, at)))
