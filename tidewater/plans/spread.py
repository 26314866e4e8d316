"""Joins that give far more rows than their tables have.

Spark sizes a join's tasks by the bytes that go in.  If many rows of both tables
share a key, few bytes give very many rows, all of them in a task or two.  Such
keys' rows are put in blocks of about ``BLOCK`` rows; each block of one table
meets each block of the other in a cell of its own, and the cells are dealt out
to as many tasks as the rows that come out need.  So a task holds a few blocks, whatever
the tables' sizes.  Rows of all other keys are joined as Catalyst likes.

How often keys occur is counted when a join is bound.  The counts only say how
rows are laid out: every pair of rows is in one cell, or in the other join, even if they are stale.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import is_number

#: A key that more rows than this of both tables have is crowded; other keys give at most so many rows for each that goes in.
OFTEN = 64
#: Rows of a block.
BLOCK = 1 << 12
#: Rows that come out of a task.  If crowded keys give fewer in all, the join is left as it is.
PER_TASK = 1 << 25

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def common(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> tuple[Column, Column] | None:
    """The keys as values of one type, equal where ``keys_equal`` says so; None for numbers of different kinds that aren't integral."""
    if a_kind == b_kind:
        return a, b
    if isinstance(a_kind, _INTEGRAL) and isinstance(b_kind, _INTEGRAL):
        return a.cast("long"), b.cast("long")
    if is_number(a_kind) and is_number(b_kind):
        return None
    return a.cast("string"), b.cast("string")


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _often(keys: DataFrame, count: str) -> DataFrame:
    return keys.groupBy("k").agg(F.count("*").alias(count)).where(F.col(count) > OFTEN)


def crowded(left: DataFrame, right: DataFrame, folder: str) -> DataFrame | None:
    """(k, p, q): the crowded keys of two tables (k) and how many blocks their rows make in each, written in the folder; None if the join needn't be spread.

    The larger table is only read if a key comes often in the smaller.
    """
    at = f"{folder}/{uuid.uuid4().hex}"
    left, right = left.where("k is not null"), right.where("k is not null")
    swap = _bytes(left) < _bytes(right)
    small, large = (left, right) if swap else (right, left)
    often = _kept(_often(small, "s"), f"{at}/often")
    if often.isEmpty():
        return None
    both = _often(large.join(often, "k", "left_semi"), "l").join(often, "k")
    p, q = ("s", "l") if swap else ("l", "s")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    found = _kept(both.select("k", blocks(p).alias("p"), blocks(q).alias("q"), (F.col("s").cast("double") * F.col("l")).alias("rows")), f"{at}/crowded")
    rows = found.agg(F.sum("rows")).first()[0]
    return found if rows and rows > PER_TASK else None


def cells(left: DataFrame, a: Column, right: DataFrame, b: Column, found: DataFrame, at: str) -> DataFrame:
    """The join of the crowded keys' rows, as ``_0`` and ``_1``.  ``at``: a column of both that has a hash of the row's address."""
    tasks = found.agg(F.sum("rows"), F.sum(F.col("p").cast("double") * F.col("q"))).first()
    parallel = left.sparkSession.sparkContext.defaultParallelism
    n = int(min(tasks[1], max(4 * parallel, -(-tasks[0] // PER_TASK))))
    key, row, column, p, q = names = [f"{x}_{uuid.uuid4().hex}" for x in ("key", "row", "column", "p", "q")]
    keys = found.select(F.col("k").alias(key), F.col("p").alias(p), F.col("q").alias(q))
    own = lambda blocks: F.pmod(F.col(at), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    l = left.join(keys, a == F.col(key)).withColumn(row, own(p)).withColumn(column, each(q))
    r = right.join(keys, b == F.col(key)).withColumn(column, own(q)).withColumn(row, each(p))
    l, r = (df.drop(p, q, at).repartition(n, *names[:3]).alias(alias) for df, alias in ((l, "_0"), (r, "_1")))
    on = [F.col(f"_0.{x}") == F.col(f"_1.{x}") for x in names[:3]]
    return l.join(r.hint("shuffle_hash"), on, "inner")


def others(df: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """The rows whose key isn't crowded."""
    name = f"key_{uuid.uuid4().hex}"
    return df.join(found.select(F.col("k").alias(name)), key == F.col(name), "left_anti")
