"""What the operators of this subpackage share: worker set-up, lineage cuts and Arrow helpers.

Operators read only the columns that they name, under private aliases, so that
any further column of the input, whatever its name, cannot get in their way.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Without these a worker keeps what its largest task took: numpy's arrays in the heap of malloc, Arrow's in a pool.
_FREED = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "33554432"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let this session's Python workers import the package, wherever the driver was started.

    Batches for Python get smaller, unless their size was set: texts are held
    several times over while they are worked on.  Workers give freed memory back
    to the system, as they stay alive from task to task.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, "8388608b")
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = ":".join([_ROOT, *known])
    for name, value in _FREED.items():
        env.setdefault(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the checkpoint folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session
    that names none gets a folder of its own; a cluster without one is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def runs(raw: list[bytes | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Split a batch into (index of its first text, texts), each run of whole texts with about ``limit`` bytes.

    Null counts as empty; a single text longer than the limit makes a run of its own.
    """
    part: list[bytes] = []
    size = first = 0
    for i, text in enumerate(raw):
        text = text or b""
        if part and size + len(text) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(text)
        size += len(text) + 1
    if part:
        yield first, part


def list_array(values: pa.Array, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def release(spark: SparkSession) -> None:
    """Drop the shuffle files and checkpoints of plans that nothing refers to any more.

    The driver does so when it collects its garbage, which may not happen while
    disks fill up.  Collecting goes on until it frees no more shuffles: the first
    rounds free plans, the later ones what these held.
    """
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    size, still = known.size(), 0
    while still < 3:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        still = still + 1 if known.size() == size else 0
        size = known.size()


def give_back() -> None:
    """Return this process's freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in a local session without it one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidewater-")


def written(df: DataFrame, folder: str) -> DataFrame:
    """The same rows, written as Parquet to a new folder and read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
