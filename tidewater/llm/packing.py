"""Cost-balanced packing of documents into training sequences.

A document's segment of n tokens costs ``linear * n + quadratic * n * n``
(attention within the segment).  Documents are taken by descending length and
each goes to the sequence of the lowest cost so far that has room for it; among
equal costs to the one with the lowest number.  There are as many sequences as
the tokens need; where none has room, one more is opened.

Documents of more tokens than a sequence holds are cut into segments of
``capacity`` tokens and a rest.  Documents without tokens (null or empty texts)
have no segment.  Equal lengths are taken by doc_id, then by segment; null ids
come first.  Repeated rows are packed as often as they come.

The rule looks at all earlier placements, one after the other, so it is applied
within groups of about ``group_size`` segments, at every size of the table: a hash
of (doc_id, segment, length) and the number of the copy draws a segment's group, so
that repeated rows and null ids spread as well.  Copies are counted before they are
shuffled; only (doc_id, segment, length) is, never text.  An empty table has no
sequences, and texts of any length are packed whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, id_and_text, prepare, raw_texts, runs, table
from .pieces import MODEL, encoder, read_model

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP_SIZE = 262_144


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each segment; the lengths descend, and each is between 1 and ``capacity``.

    Sequences with room are kept in a heap by cost.  One that has no room for
    this segment is set aside until a segment comes that it has room for.
    """
    total = -(-int(lengths.sum()) // capacity)
    heap: list[tuple[float, int]] = [(0.0, k) for k in range(total)]
    room = [capacity] * total
    aside: list[tuple[int, float, int]] = []  # by the room left, largest first
    out = np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        while aside and -aside[0][0] >= n:
            _, c, k = heapq.heappop(aside)
            heapq.heappush(heap, (c, k))
        while heap and room[heap[0][1]] < n:
            c, k = heapq.heappop(heap)
            if room[k]:
                heapq.heappush(aside, (-room[k], c, k))
        if heap:
            c, k = heapq.heappop(heap)
        else:
            c, k = 0.0, len(room)
            room.append(capacity)
        out[i] = k
        room[k] -= n
        heapq.heappush(heap, (c + cost(n, linear, quadratic), k))
    return out


def segments(docs: DataFrame, model_path: str = MODEL, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, segment, start, n_tokens) of every document's segments."""
    prepare(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in runs(raw_texts(batch.column("text"))):
                size = own.encode(texts)[1]
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first + row)), pa.array(k.astype(np.int32)), pa.array((k * capacity).astype(np.int64)), pa.array(np.minimum(capacity, size[row] - k * capacity).astype(np.int32))],
                    names=["doc_id", "segment", "start", "n_tokens"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, segment int, start long, n_tokens int")


def pack(docs: DataFrame, model_path: str = MODEL, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_size: int = GROUP_SIZE) -> DataFrame:
    """(sequence, slot, doc_id, segment, start, n_tokens, cost), one row for each segment.

    ``sequence`` is ``group << 32 | number``; ``slot`` is the segment's place in it.
    """
    found = cut(segments(docs, model_path, capacity))
    groups = max(1, -(-found.count() // group_size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        if not whole.num_rows:
            return
        part = {k: np.asarray(whole.column(k).fill_null(-(2**63)) if k == "doc_id" else whole.column(k)) for k in ("group", "doc_id", "segment", "start", "n_tokens")}
        null = np.asarray(whole.column("doc_id").is_null())
        order = np.lexsort((part["segment"], part["doc_id"], ~null, -part["n_tokens"].astype(np.int64)))
        n = part["n_tokens"][order]
        which = assign(n, capacity, linear, quadratic)
        slot = np.empty(len(which), dtype=np.int32)
        by = np.argsort(which, kind="stable")
        starts = np.flatnonzero(np.diff(which[by], prepend=-1))
        slot[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((part["group"][order].astype(np.int64) << 32) | which),
                pa.array(slot),
                pa.array(part["doc_id"][order], pa.int64(), mask=null[order]),
                pa.array(part["segment"][order]),
                pa.array(part["start"][order]),
                pa.array(n),
                pa.array(cost(n.astype(np.float64), linear, quadratic)),
            ],
            names=["sequence", "slot", "doc_id", "segment", "start", "n_tokens", "cost"],
        )

    schema = "sequence long, slot int, doc_id long, segment int, start long, n_tokens int, cost double"
    alike = found.groupBy("doc_id", "segment", "start", "n_tokens").agg(F.count("*").alias("copies"))
    each = alike.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    grouped = each.select(F.pmod(F.xxhash64("doc_id", "segment", "n_tokens", "copy"), F.lit(groups)).cast("int").alias("group"), "doc_id", "segment", "start", "n_tokens")
    return grouped.groupBy("group").applyInArrow(place, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
