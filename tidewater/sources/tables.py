"""Reading and writing native tables' Parquet files.

A file set is a folder that one statement wrote.  Each row has an address that
never changes: ``_batch``, the set's id, and ``_row``, its number in it.  A
tombstone set lists addresses; reading leaves them out by an anti join.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .log import TableState

ADDRESS = ["_batch", "_row"]
_KINDS = {"INT": T.LongType(), "VARCHAR": T.StringType()}


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind], False) for name, kind in columns])


def _stored(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([*schema_of(columns), T.StructField("_batch", T.StringType()), T.StructField("_row", T.LongType())])


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)

    def _new(self, table: str, txn: int) -> tuple[str, str]:
        batch = uuid.uuid4().hex[:16]
        return batch, f"data/{table}/{txn}-{batch}"

    def write_rows(self, table: TableState, df: DataFrame, txn: int, few: bool) -> dict:
        """Stage new rows; many rows are clustered by the primary key so that row groups can be skipped."""
        batch, path = self._new(table.name, txn)
        df = df.select(*(F.col(f"`{c}`") for c, _ in table.columns))
        df = df.coalesce(1) if few else self._clustered(table, df)
        df.withColumn("_batch", F.lit(batch)).withColumn("_row", F.monotonically_increasing_id()).write.parquet(str(self.root / path))
        return {"action": "add", "table": table.name, "path": path, "rows": self._count(path)}

    def write_tombstones(self, table: TableState, addresses: DataFrame, txn: int) -> dict:
        _, path = self._new(table.name, txn)
        addresses.select(*ADDRESS).write.parquet(str(self.root / path))
        return {"action": "tombstone", "table": table.name, "path": path, "rows": self._count(path)}

    def rewrite(self, table: TableState, txn: int) -> dict:
        """The live rows in one clustered set; they keep their addresses."""
        _, path = self._new(table.name, txn)
        self._clustered(table, self.read(table, addresses=True)).write.parquet(str(self.root / path))
        return {"action": "replace", "table": table.name, "path": path, "rows": self._count(path)}

    def read(self, table: TableState, addresses: bool = False) -> DataFrame:
        kind = _stored(table.columns)
        if not table.adds:
            df = self.spark.createDataFrame([], kind)
        else:
            df = self.spark.read.schema(kind).parquet(*(str(self.root / a["path"]) for a in table.adds))
            if table.tombstones:
                gone = self.spark.read.schema("_batch string, _row long").parquet(*(str(self.root / t["path"]) for t in table.tombstones))
                df = df.join(gone, ADDRESS, "left_anti")
        names = [c for c, _ in table.columns]
        return df.select(*(F.col(f"`{c}`") for c in names + (ADDRESS if addresses else [])))

    def tombstones(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("_batch string, _row long").parquet(*(str(self.root / p) for p in paths))

    def _clustered(self, table: TableState, df: DataFrame) -> DataFrame:
        return df.repartitionByRange(F.col(f"`{table.key}`")).sortWithinPartitions(F.col(f"`{table.key}`")) if table.key else df

    def _count(self, path: str) -> int:
        return self.spark.read.parquet(str(self.root / path)).count()
