"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search on it.

Vectors are to differ from each other, as equal ones take each other's edges.

Start: in each of ``TREES`` random-projection partitions, the vectors of a cell of
about ``CELL`` are compared with each other, whatever the table's size.  NN-descent:
a vector keeps its ``DEGREE`` best.  In a round it uses, of its edges that are
fresh, the best ``SAMPLE`` out of it and the best ``SAMPLE`` into it; those that
aren't used stay fresh for later rounds.  At each vector the neighbours that these
lead to are compared with one another and with the neighbours of used edges (all
out of it, the best ``SAMPLE`` into it): neighbours of neighbours, met by a join
and a shuffle.  Whoever beats a vector's worst neighbour replaces it by a fresh
edge.  Rounds end when at most ``LEAST`` of all edges changed, not after a number.

Search: a query's beam starts at its own place's neighbours, or for a query that
isn't in the graph at a sample of ``ENTRIES``.  The unexpanded vectors of the beam
are joined with the graph, and only for the neighbours that the query hasn't met
are vectors fetched and compared, until a beam of ``beam`` has none left to expand.
Cosines are computed in half precision on the way, and those that are returned
once more exactly.

``tuned`` measures recall: ``HELD`` vectors are searched and compared with all
others.  Until it is at least ``RECALL``, first the beam and then the degree are
doubled, at last up to the number of vectors.

``op8`` takes as queries the rows whose vec_id is divisible by ``EVERY``, against all
rows.  For so few queries a graph of all vectors costs many times what it saves, so
they are answered from ``cells``; the graph is for neighbours of all vectors.

All tables travel by joins and shuffles; only the partitions' directions and the
entry sample, both of fixed size, are sent to every executor.  Vectors of
different sizes are never neighbours.  For rows that are passed over see
``vectors.normalised``.  Equal cosines go by id.  Rows that repeat an id are one
vector.  A vector alone in its table, and an empty table, have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cells
from .base import cut, table
from .vectors import matrix, ranked

NEIGHBOURS, DEGREE, BEAM = 10, 32, 160
TREES, CELL, SAMPLE = 8, 64, 16
LEAST = 0.01
EVERY, HELD, RECALL = 50, 400, 0.92
ENTRIES = 256
_MEDIANS = 4096
_NODES = 500  # of a shard, on average


def _shard(column: str, n: int):
    """Groups of about _NODES ids, as each is held in memory at once."""
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-n // _NODES)))).alias("shard")


_EDGE = "id long, other long, cosine float"
_FRESH = f"{_EDGE}, out boolean, into boolean"
_NAMES = ["id", "other", "cosine", "out", "into"]


def _edges(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES[: len(columns)])


def _merge(rows: DataFrame, k: int, n: int) -> DataFrame:
    """The k best edges of each id; a repeated pair is fresh where all its rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        row, other, cosine, *fresh = (np.asarray(t.column(c)) for c in _NAMES)
        order = np.lexsort((other, row))
        row, other, cosine = row[order], other[order], cosine[order]
        start = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(other) != 0))))[: len(row)]
        row, other, cosine = row[start], other[start], cosine[start]
        fresh = [np.logical_and.reduceat(x[order], start) for x in fresh]
        keep = ranked(row, other, cosine, k)
        yield _edges(*(x[keep] for x in (row, other, cosine, *fresh)))

    return rows.groupBy(_shard("id", n)).applyInArrow(run, _FRESH)


def _best(edges: DataFrame, key: str, other: str, k: int) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col("cosine").desc(), other)
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "other", "cosine")


def _start(half: DataFrame, n: int, degree: int, trees: int, cell: int) -> DataFrame:
    size = half.agg(F.max(F.length("v"))).first()[0] or 0
    sample = matrix(pa.array([bytes(r[0]) for r in half.where(F.length("v") == size).select("v").orderBy(F.xxhash64("v")).limit(_MEDIANS).collect()], pa.binary()), np.float16).astype(np.float32)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / cell))))
    rng = np.random.default_rng(8)
    direction = rng.standard_normal((max(1, size // 2), trees * depth)).astype(np.float32)
    middle = np.median(sample @ direction, axis=0) if len(sample) and depth else np.zeros(trees * depth)
    power = np.uint64(1) << np.arange(depth, dtype=np.uint64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.diff(np.frombuffer(batch.column("v").buffers()[1], dtype=np.int32)[batch.column("v").offset :][: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, dtype=np.int32)
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                x = matrix(part.column("v"), np.float16).astype(np.float32)
                # shorter vectors have as many directions, and their size parts them from the others
                side = (x @ direction[: x.shape[1]] > middle).reshape(len(x), trees, depth) if x.shape[1] <= len(direction) else np.zeros((len(x), trees, depth), dtype=bool)
                leaf = (side * power).sum(axis=2, dtype=np.uint64) + (np.arange(trees, dtype=np.uint64) << np.uint64(40)) + (np.uint64(w) << np.uint64(44))
                row = pa.array(np.repeat(np.arange(len(x)), trees))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel().view(np.int64)), part.column("id").take(row), part.column("v").take(row)], names=["leaf", "id", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("leaf")
        leaf, all_ids, v = np.asarray(t.column("leaf")), np.asarray(t.column("id")), t.column("v").combine_chunks()
        start = np.flatnonzero(np.diff(leaf, prepend=~leaf[:1]) != 0)
        for a, b in zip(start.tolist(), np.append(start[1:], len(leaf)).tolist()):
            ids, x = all_ids[a:b], matrix(v.slice(a, b - a), np.float16).astype(np.float32)
            k = min(degree, len(ids) - 1)
            for s in range(0, len(ids) if k > 0 else 0, 256):
                c = x[s : s + 256] @ x.T
                c[np.arange(len(c)), s + np.arange(len(c))] = -2
                best = np.argpartition(-c, k - 1, axis=1)[:, :k]
                fresh = np.ones(len(c) * k, dtype=bool)
                yield _edges(np.repeat(ids[s : s + 256], k), ids[best].ravel(), np.take_along_axis(c, best, 1).ravel(), fresh, fresh)

    cells = half.mapInArrow(place, "leaf long, id long, v binary")
    return _merge(cells.groupBy(_shard("leaf", n * trees)).applyInArrow(compare, _FRESH), degree, n)


def _halves(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.frombuffer(v, dtype=np.float32).astype(np.float16).tobytes() for v in batch.column("v").to_pylist()], pa.binary())], names=["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def build(vectors: DataFrame, degree: int = DEGREE, trees: int = TREES, cell: int = CELL, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """(id, other, cosine): the neighbour graph of (id, v)."""
    n = vectors.count()
    half = cut(_halves(vectors))
    graph = cut(_start(half, n, degree, trees, cell))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("pivot")
        pivot, ids, worst, fresh = (np.asarray(t.column(c)) for c in ("pivot", "id", "worst", "fresh"))
        v = t.column("v").combine_chunks()
        start = np.flatnonzero(np.concatenate(([True], np.diff(pivot) != 0)))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for s, e in zip(start.tolist(), np.append(start[1:], len(pivot)).tolist()):
            new = fresh[s:e]
            if not new.any():
                continue
            x, own, limit = matrix(v.slice(s, e - s), np.float16).astype(np.float32), ids[s:e], worst[s:e]
            c = x[new] @ x.T
            other = own[new][:, None] != own[None, :]
            for beats, turned in ((c > limit[new][:, None], False), (c > limit[None, :], True)):
                i, j = np.nonzero(beats & other)
                a, b = own[new][i], own[j]
                out.append((b, a, c[i, j]) if turned else (a, b, c[i, j]))
                size += len(i)
            if size > 200_000:
                yield _new(out)
                out, size = [], 0
        if out:
            yield _new(out)

    def _new(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b, c = (np.concatenate(x) for x in zip(*out))
        keep = ranked(a, b, c, degree)
        fresh = np.ones(len(keep), dtype=bool)
        return _edges(a[keep], b[keep], c[keep], fresh, fresh)

    while True:
        worst = graph.groupBy(F.col("id").alias("w")).agg(F.when(F.count("*") >= degree, F.min("cosine")).otherwise(F.lit(-1.5)).cast("float").alias("worst"))
        # the edges that this round uses: fresh ones out of a vector and into it, used ones into it
        uses = (_best(graph.where("out"), "id", "other", sample), _best(graph.where("into"), "other", "id", sample), _best(graph.where("not into"), "other", "id", sample))
        uses = cut(uses[0].withColumn("kind", F.lit(0)).union(uses[1].withColumn("kind", F.lit(1))).union(uses[2].withColumn("kind", F.lit(2))))
        met = graph.where("not out").select(F.col("id").alias("pivot"), F.col("other").alias("m"), F.lit(False).alias("fresh"))
        met = met.union(uses.select(F.when(F.col("kind") == 0, F.col("id")).otherwise(F.col("other")), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("id")), F.col("kind") < 2))
        met = met.groupBy("pivot", "m").agg(F.max("fresh").alias("fresh"))
        known = half.join(worst, F.col("id") == F.col("w"), "left").select("id", "v", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"))
        members = met.join(known, F.col("m") == F.col("id")).select("pivot", "id", "v", "worst", "fresh")
        found = members.groupBy(_shard("pivot", n)).applyInArrow(meet, _FRESH)
        used = uses.where("kind < 2").select("id", "other", "cosine", (F.col("kind") != 0).alias("out"), (F.col("kind") != 1).alias("into"))
        better = cut(_merge(graph.union(used).union(found), degree, n))
        changed = better.join(graph.select(F.col("id").alias("i"), F.col("other").alias("o")), (F.col("id") == F.col("i")) & (F.col("other") == F.col("o")), "left_anti").count()
        graph = better
        if changed <= least * n * degree:
            return graph.select("id", "other", "cosine")


def search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = NEIGHBOURS, beam: int | None = None, own: bool = False) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest of (id, v) for each query (id, v).

    ``own``: the queries are vectors of the graph; each starts at its own place
    and isn't its own neighbour.
    """
    beam, n = max(k, beam or BEAM), queries.count()
    half, asked = cut(_halves(vectors)), cut(_halves(queries))
    if own:
        state = graph.join(asked.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_semi").select("id", "other", "cosine")
    else:
        entry = [(r[0], bytes(r[1])) for r in half.orderBy(F.xxhash64("id")).limit(ENTRIES).collect()]

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                    same = [(e, x) for e, x in entry if len(x) == len(v)]
                    if same:
                        c = np.stack([np.frombuffer(x, dtype=np.float16).astype(np.float32) for _, x in same]) @ np.frombuffer(v, dtype=np.float16).astype(np.float32)
                        yield _edges(np.full(len(c), i), np.array([e for e, _ in same], dtype=np.int64), c)

        state = asked.mapInArrow(enter, _EDGE)
    order = W.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    # ``met``: what each query was compared with; ``state``: its beam
    state = cut(state.withColumn("rank", F.row_number().over(order)).select("id", "other", "cosine", "rank", F.lit(False).alias("done")))
    met = [state.select("id", "other")]
    state = state.where(F.col("rank") <= beam).drop("rank")

    def compare(asks: pa.Table, found: pa.Table) -> pa.Table:
        kinds = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cosine", pa.float32())])
        if not asks.num_rows or not found.num_rows:
            return kinds.empty_table()
        ids = np.asarray(asks.column("id"))
        place = np.argsort(ids)
        q, query, other = asks.column("v").to_pylist(), np.asarray(found.column("query")), np.asarray(found.column("other"))
        by = np.argsort(query, kind="stable")
        start = np.flatnonzero(np.diff(query[by], prepend=~query[by[:1]]) != 0)
        cosine = np.full(len(query), -2, dtype=np.float32)
        v = found.column("v").combine_chunks()
        for s, e in zip(start.tolist(), np.append(start[1:], len(by)).tolist()):
            own_v = np.frombuffer(q[place[np.searchsorted(ids[place], query[by[s]])]], dtype=np.float16).astype(np.float32)
            part = v.take(pa.array(by[s:e]))
            part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
            cosine[by[s:e]] = matrix(part, np.float16).astype(np.float32) @ own_v
        return pa.table([query, other, cosine], schema=kinds)

    while True:
        front = state.where("not done").select(F.col("id").alias("query"), F.col("other").alias("at"))
        reached = front.join(graph.select(F.col("id").alias("g"), F.col("other")), F.col("at") == F.col("g")).select("query", "other").distinct()
        if own:
            reached = reached.where("query <> other")
        known = reduce(DataFrame.union, met).select(F.col("id").alias("x"), F.col("other").alias("y"))
        reached = reached.join(known, (F.col("query") == F.col("x")) & (F.col("other") == F.col("y")), "left_anti")
        fetched = reached.join(half, F.col("other") == F.col("id")).select("query", "other", "v")
        found = cut(asked.groupBy(_shard("id", n)).cogroup(fetched.groupBy(_shard("query", n))).applyInArrow(compare, _EDGE))
        met.append(found.select("id", "other"))
        mixed = state.select("id", "other", "cosine", F.lit(True).alias("done")).union(found.select("id", "other", "cosine", F.lit(False).alias("done")))
        state = cut(mixed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam).select("id", "other", "cosine", "done"))
        if state.where("not done").isEmpty():
            break
    return _exact(state, queries, vectors, k)


def _exact(state: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # all of one size, or row by row
                a, b = batch.column("v"), batch.column("o")
                if len(set(map(len, a.to_pylist()))) == 1:
                    c = np.einsum("ij,ij->i", matrix(a).astype(np.float64), matrix(b).astype(np.float64))
                else:
                    c = np.array([np.frombuffer(x, dtype=np.float32).astype(np.float64) @ np.frombuffer(y, dtype=np.float32) for x, y in zip(a.to_pylist(), b.to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("neighbour"), pa.array(np.clip(c, -1, 1))], names=["query", "neighbour", "cosine"])

    pairs = state.select(F.col("id").alias("query"), F.col("other").alias("neighbour"))
    pairs = pairs.join(vectors.select("id", F.col("v").alias("o")), F.col("neighbour") == F.col("id")).drop("id")
    pairs = pairs.join(queries.select("id", "v"), F.col("query") == F.col("id")).select("query", "neighbour", "v", "o")
    order = W.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    scored = pairs.mapInArrow(run, "query long, neighbour long, cosine double")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def _exact_least(sample: DataFrame, vectors: DataFrame, k: int, n: int) -> dict[int, float]:
    """The cosine of each sampled vector's k-th nearest other, by comparing it with all."""
    rows = sample.collect()
    ids, raw = np.array([r[0] for r in rows], dtype=np.int64), [bytes(r[1]) for r in rows]
    width = np.array([len(v) for v in raw])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column("v").to_pylist()], dtype=np.int64)
            for w in np.intersect1d(size, width):
                own, part = np.flatnonzero(width == w), batch.filter(pa.array(size == w))
                other = np.asarray(part.column("id"))
                c = np.frombuffer(b"".join(raw[i] for i in own), dtype=np.float32).reshape(len(own), -1) @ matrix(part.column("v")).T
                c[ids[own][:, None] == other[None, :]] = -2
                best = np.argpartition(-c, min(k, len(other)) - 1, axis=1)[:, :k]
                used = np.zeros(best.size, dtype=bool)
                yield _edges(np.repeat(ids[own], best.shape[1]), other[best].ravel(), np.take_along_axis(c, best, 1).ravel(), used, used)

    exact = _merge(vectors.select("id", "v").mapInArrow(compare, _FRESH), k, len(ids)).where("cosine > -1.5")
    return {r[0]: (r[1], r[2]) for r in exact.groupBy("id").agg(F.min("cosine"), F.count("*")).collect()}


def measured(vectors: DataFrame, graph: DataFrame, sample: DataFrame, least: dict[int, tuple[float, int]], k: int, beam: int) -> float:
    """The share of the sampled vectors' k nearest that a search finds; equal cosines are as good."""
    found = search(sample, vectors, graph, k, beam, own=True).collect()
    want = sum(n for _, n in least.values())
    return sum(r.cosine >= least[r["query"]][0] - 1e-5 for r in found) / want if want else 1.0


def tuned(vectors: DataFrame, k: int = NEIGHBOURS, degree: int = DEGREE, beam: int = BEAM, target: float = RECALL, held: int = HELD) -> tuple[DataFrame, int]:
    """(graph, beam) with which a search for the graph's own vectors reaches the recall ``target``."""
    n = vectors.count()
    graph = build(vectors, degree)
    if n <= k + 1:
        return graph, beam
    sample = cut(vectors.orderBy(F.xxhash64("id")).limit(held))
    least = _exact_least(sample, vectors, k, n)
    while measured(vectors, graph, sample, least, k, beam) < target and (beam < n or degree < n):
        if beam < 8 * degree:
            beam *= 2
        else:
            degree *= 2
            graph = build(vectors, degree)
    return graph, beam


def nearest(df: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest of all rows for each id that is divisible by ``every``."""
    return cells.nearest(df, every, k)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
