"""Nearest neighbours by cells: vectors lie in the cell of their nearest centre, a query meets whole cells.

Index: centres come from spherical k-means, fitted to a sample of at most ``SAMPLE``
vectors and ``SAMPLE_BYTES``, drawn by the hash of the ids.  There are ``CELLS`` times
the root of the number of rows, at most ``MOST_CELLS`` and one for ``LEAST_ROWS``
vectors of the sample.  Every vector lies in a cell, none is left out; those whose size
the sample lacks lie in one cell for each size, which all queries of that size meet.

Recall: ``HELD`` vectors are compared with all others, and where their ``k`` nearest
lie among the cells in a query's order gives the number of cells that a query must meet
for the recall ``RECALL``: at most all, which is exact.  Equal vectors count once in it.

Search: cells travel to shards of at most ``SHARD`` bytes, a larger cell to several by
the hash of its vectors, and a query to every shard with a cell that it meets.  There a
query's vectors are compared in single precision, and those that can be among its
nearest once more in double precision; no cell or shard is cut.  What can't be among
them is known from at most ``KNOWN_BYTES`` of a sample of about ``KNOWN`` rows: whatever is
below k + 1 of those of them that are in the query's cells.

All tables travel by joins and shuffles; only the centres, each cell's shard and that
sample, all bounded, are sent to every executor.  Of a vector that many rows have in common the
k + 1 smallest ids are kept, as no query can take more; equal queries are asked once.
Vectors of different sizes are never neighbours.  For rows that are passed over see
``vectors.normalised``.  Equal cosines go by id.  A vector alone in its table, and an
empty table, have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut
from .vectors import matrix, normalised, ranked

CELLS, MOST_CELLS, LEAST_ROWS = 4, 8192, 16
SAMPLE, SAMPLE_BYTES = 131_072, 64_000_000
SHARD = 96_000_000
KNOWN, KNOWN_BYTES = 32_768, 8_388_608
HELD, RECALL = 400, 0.94
_ROUNDS = 8  # of k-means
_BLOCK = 1 << 22  # cosines at once
_CACHED = 1 << 19  # cosines that stay in the cache
_NEAR = 2e-6  # more than single precision errs by
_SEND = "shard int, kind int, cell int, id long, v binary, least float, worst float"

#: By the bytes of a vector: the number of its first cell, and its cells' centres.
Centres = dict[int, tuple[int, np.ndarray]]


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch for each size of ``v`` in bytes."""
    if batch.num_rows:
        v = batch.column("v")
        size = np.diff(np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset :][: batch.num_rows + 1])
        sizes = np.unique(size).tolist()
        for w in sizes:
            yield w, batch if len(sizes) == 1 else batch.filter(pa.array(size == w))


def _hash(x: np.ndarray) -> np.ndarray:
    """64 bits of each row; rows are held equal only after their bytes were compared."""
    weight = np.random.default_rng(8).integers(1, 1 << 63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    parts = [(x[s : s + 8192].view(np.uint32) * weight).sum(axis=1, dtype=np.uint64) for s in range(0, len(x), 8192)]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)


def _classes(x: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): rows by cell, equal vectors side by side and by id, and where in it each vector starts."""
    key = _hash(x)
    order = np.lexsort((ids, key, cell))
    same = np.flatnonzero((np.diff(key[order]) == 0) & (np.diff(cell[order]) == 0))
    equal = (x[order[same]].view(np.uint32) == x[order[same + 1]].view(np.uint32)).all(axis=1)
    new = np.ones(len(x), dtype=bool)
    new[same[equal] + 1] = False
    return order, np.flatnonzero(new)


def _rank(start: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


def _closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    step = max(1, _BLOCK // len(centre))
    return np.concatenate([np.argmax(x[s : s + step] @ centre.T, axis=1) for s in range(0, len(x), step)])


def _fitted(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of norm 1."""
    centre = x[np.random.default_rng(8).choice(len(x), n, replace=False)]
    for _ in range(_ROUNDS):
        cell = _closest(x, centre)
        order = np.argsort(cell, kind="stable")
        used, start = np.unique(cell[order], return_index=True)
        total = np.add.reduceat(x[order], start)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre[used] = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), centre[used])
    return centre


def _centres(df: DataFrame) -> Centres:
    ids = F.col("vec_id").cast("long")
    n, most = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
    rows = min(SAMPLE, SAMPLE_BYTES // (4 * max(1, most or 1)))
    sample = normalised(df.where(F.pmod(F.xxhash64(ids), F.lit(max(1, n // max(1, rows)))) == 0)).select("v").toArrow()
    parts = {}
    for batch in sample.combine_chunks().to_batches():
        for w, part in _by_size(batch):
            parts.setdefault(w, []).append(matrix(part.column("v")))
    out, first = {}, 0
    for w, xs in sorted(parts.items()):
        x = np.concatenate(xs)
        share = len(x) / sample.num_rows
        x = x[np.sort(np.unique(_hash(x), return_index=True)[1])]
        centre = _fitted(x, max(1, min(int(share * min(MOST_CELLS, CELLS * n**0.5)), len(x) // LEAST_ROWS)))
        # cells that are near each other get near numbers, and so into one shard
        centre = centre[np.argsort(_closest(centre, _fitted(centre, int(np.ceil(len(centre) ** 0.5)))), kind="stable")]
        out[w] = (first, centre)
        first += len(centre)
    return out


def _placed(rows: DataFrame, centres: Centres, most: int) -> DataFrame:
    """(cell, id, v); of a vector that recurs in a batch the ``most`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, part in _by_size(batch):
                x, ids = matrix(part.column("v")), np.asarray(part.column("id"))
                order, start = _classes(x, ids, np.zeros(len(x), dtype=np.int32))
                if len(start) < len(x):
                    keep = np.sort(order[_rank(start, len(x)) < most])
                    part, x = part.take(pa.array(keep)), x[keep]
                cell = centres[w][0] + _closest(x, centres[w][1]) if w in centres else np.full(len(x), -(w // 4))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column("id"), part.column("v")], names=["cell", "id", "v"])

    return rows.mapInArrow(run, "cell int, id long, v binary")


def _met(placed: DataFrame, centres: Centres, k: int, held: int, target: float) -> int:
    """With how many cells a query must be compared for the recall ``target``."""
    sample: dict[int, np.ndarray] = {}
    for batch in placed.select("id", "v").orderBy(F.xxhash64("id")).limit(held).toArrow().combine_chunks().to_batches():
        for w, part in _by_size(batch):
            x = matrix(part.column("v"))
            sample[w] = np.concatenate([sample.get(w, x[:0]), x])
    sample = {w: x[np.unique(_hash(x), return_index=True)[1]] for w, x in sample.items()}
    base = dict(zip(sample, np.cumsum([0, *map(len, sample.values())]).tolist()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, part in _by_size(batch):
                if w not in sample:
                    continue
                own, own_key = sample[w], _hash(sample[w])
                for s in range(0, part.num_rows, 8192):
                    piece = part.slice(s, 8192)
                    x, cell = matrix(piece.column("v")), np.asarray(piece.column("cell"))
                    key, first = np.unique(_hash(x), return_index=True)
                    x, cell = x[first], cell[first]
                    c = own @ x.T
                    c[own_key[:, None] == key[None, :]] = -2
                    best = np.argpartition(-c, min(k, len(x)) - 1, axis=1)[:, :k]
                    row, other, cosine = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel(), np.take_along_axis(c, best, 1).ravel()
                    found = cosine > -1.5
                    row, other, cosine = row[found], other[found], cosine[found]
                    yield pa.RecordBatch.from_arrays([pa.array(row + base[w]), pa.array(key[other]), pa.array(cosine), pa.array(cell[other])], names=["row", "other", "cosine", "cell"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        keep = ranked(*(np.asarray(t.column(c)) for c in ("row", "other", "cosine")), k)
        yield from t.take(pa.array(keep)).to_batches()

    kinds = "row long, other long, cosine float, cell int"
    near = placed.mapInArrow(compare, kinds).groupBy("row").applyInArrow(merge, kinds).select("row", "cell").collect()
    place = []
    score = {w: x @ centres[w][1].T for w, x in sample.items() if w in centres}
    for row, cell in near:
        w = max((w for w in sample if base[w] <= row), key=lambda w: base[w])
        own = score[w][row - base[w]] if w in centres else None
        place.append(0 if own is None else int((own > own[cell - centres[w][0]]).sum()))
    return sorted(place)[int(np.ceil(target * len(place))) - 1] + 1 if place else 1


def _shards(cells: list[tuple[int, int, int]], most: int) -> tuple[list[tuple[int, int, int]], int]:
    """((cell, its first shard, how many it is spread over), number of shards) of (cell, size of its vectors, rows)."""
    out, shards, room, last = [], 0, 0, None
    for cell, w, rows in cells:
        size = rows * (w + 16)
        if size > most:
            out.append((cell, shards, -(-size // most)))
            shards, room = shards + out[-1][2], 0
        else:
            if size > room or w != last:
                shards, room = shards + 1, most
            room -= size
            out.append((cell, shards - 1, 1))
        last = w
    return out, shards


def _known(placed: DataFrame, centres: Centres, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of vectors, different ones of a sample and their cells, counted from the size's first."""
    most = max(1, min(KNOWN, KNOWN_BYTES // max(centres, default=1)))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in placed.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // most))) == 0).select("cell", "v").toArrow().combine_chunks().to_batches():
        for w, part in _by_size(batch):
            if w in centres:
                x, cell = matrix(part.column("v")), np.asarray(part.column("cell")) - centres[w][0]
                out[w] = (np.concatenate([out[w][0], x]), np.concatenate([out[w][1], cell])) if w in out else (x, cell)
    for w, (x, cell) in out.items():
        first = np.unique(_hash(x), return_index=True)[1]
        out[w] = (x[first], cell[first])
    return out


def _sent(queries: DataFrame, centres: Centres, known: dict[int, tuple[np.ndarray, np.ndarray]], places: list[tuple[int, int, int]], met: int, most: int) -> DataFrame:
    """The queries (id, v) for every shard with a cell that they meet.

    ``least`` is the cosine of the last centre that they meet, ``worst`` one that
    ``most`` of the vectors in these cells reach.
    """
    at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w, (first, centre) in centres.items():
        pairs = sorted((s, cell - first) for cell, begin, n in places if first <= cell < first + len(centre) for s in range(begin, begin + n))
        at[w] = tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
    rest = {-4 * cell: np.arange(begin, begin + n) for cell, begin, n in places if cell < 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, part in _by_size(batch):
                x = matrix(part.column("v"))
                worst = np.full(len(x), -2, dtype=np.float32)
                step = max(1, _BLOCK // max(len(centres[w][1]), len(known[w][0]) if w in known else 1)) if w in centres else len(x)
                for s in range(0, len(x), step):
                    own = x[s : s + step]
                    if w in centres:
                        score = own @ centres[w][1].T
                        p = min(met, score.shape[1])
                        least = np.partition(score, score.shape[1] - p, axis=1)[:, score.shape[1] - p] - np.float32(_NEAR)
                        shard, cell = at[w]
                        start = np.flatnonzero(np.diff(shard, prepend=-1))
                        meets = score >= least[:, None]
                        row, to = np.nonzero(np.logical_or.reduceat(meets[:, cell], start, axis=1))
                        to = shard[start][to]
                        if w in known and len(known[w][0]) >= most:
                            c = own @ known[w][0].T
                            c += np.where(meets, np.float32(0), np.float32(-4)).take(known[w][1], axis=1)
                            # the best of each of many parts: as many different vectors reach the last of ``most`` of them
                            wide = max(most, min(c.shape[1], 512))
                            best = c[:, : c.shape[1] // wide * wide].reshape(len(c), -1, wide).max(axis=1)
                            c = np.partition(best, wide - most, axis=1)[:, wide - most]
                            worst[s : s + step] = np.where(c > -1.5, c - np.float32(_NEAR), -2)
                    else:
                        least, to = np.full(len(own), -2, dtype=np.float32), rest.get(w, np.zeros(0, dtype=np.int64))
                        row, to = np.repeat(np.arange(len(own)), len(to)), np.tile(to, len(own))
                    for b in range(0, len(row), 32_768):
                        r, t = row[b : b + 32_768], to[b : b + 32_768]
                        piece = part.take(pa.array(s + r))
                        one = np.ones(len(r), dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(one), pa.array(0 * one), piece.column("id"), piece.column("v"), pa.array(least[r]), pa.array(worst[s + r])], names=["shard", "kind", "cell", "id", "v", "least", "worst"])

    return queries.select("id", "v").mapInArrow(run, _SEND)


class _Shard:
    """The vectors of a shard, all of one size, each distinct one once, by cell."""

    def __init__(self, batches: list[pa.RecordBatch], centres: Centres, most: int):
        t = pa.Table.from_batches(batches)
        batches.clear()
        x, ids, cell = matrix(t.column("v")), np.asarray(t.column("id")), np.asarray(t.column("cell"))
        del t
        order, self.start = _classes(x, ids, cell)
        self.most, self.ids = most, ids[order]
        self.count = np.minimum(np.diff(np.append(self.start, len(ids))), most)
        first = order[self.start]
        self.v, cell = x[first], cell[first]
        self.cells, begin = np.unique(cell, return_index=True)
        self.ranges = list(zip(begin.tolist(), np.append(begin[1:], len(cell)).tolist()))
        known = centres.get(4 * x.shape[1])
        self.centre = known[1][self.cells - known[0]] if known else None

    def nearest(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """(query, neighbour, cosine): the ``most`` nearest rows of the shard's cells that each query meets."""
        q, most = matrix(batch.column("v")), self.most
        meets = np.ones((len(q), len(self.cells)), dtype=bool) if self.centre is None else q @ self.centre.T >= np.asarray(batch.column("least"))[:, None]
        worst = np.array(batch.column("worst"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, full = 0, max(200_000, 4 * most * len(q))
        for n, (a, b) in enumerate(self.ranges):
            own = np.flatnonzero(meets[:, n])
            for lo in range(a, b, 2048):
                part = self.v[lo : min(b, lo + 2048)]
                step = max(256, _CACHED // len(part))
                for s in range(0, len(own), step):
                    some = own[s : s + step]
                    c = q[some] @ part.T
                    new = np.flatnonzero(worst[some] == -2)
                    if len(new) and len(part) > most:
                        worst[some[new]] = np.partition(c[new], len(part) - most, axis=1)[:, len(part) - most] - np.float32(_NEAR)
                    i, j = np.divmod(np.flatnonzero(c >= worst[some][:, None]), len(part))
                    found.append((some[i], lo + j, c[i, j]))
                    size += len(i)
                    if size > full:
                        found = [self._best(q, worst, found)]
                        size = len(found[0][0])
        if not size:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "neighbour", "cosine"])
        row, place, _ = self._best(q, worst, found)
        cosine = self._exact(q, row, place)
        count = self.count[place]
        ids = self.ids[np.repeat(self.start[place], count) + _rank(np.cumsum(count) - count, int(count.sum()))]
        row, cosine = np.repeat(row, count), np.repeat(cosine, count)
        keep = ranked(row, ids, cosine, most)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[keep])), pa.array(ids[keep]), pa.array(cosine[keep])], names=["query", "neighbour", "cosine"])

    def _best(self, q: np.ndarray, worst: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``most`` best vectors of each query among those found; raises ``worst`` to their last."""
        row, place, c = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-c, row))
        row, place, c = row[order], place[order], c[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        many = np.diff(np.append(start, len(row)))
        least = np.where(many >= self.most, c[np.minimum(start + self.most, len(c)) - 1], -2)
        keep = c >= np.repeat(least, many) - np.float32(_NEAR)
        row, place, c = row[keep], place[keep], c[keep]
        exact = self._exact(q, row, place)
        keep = ranked(row, self.ids[self.start[place]], exact, self.most)
        row, place, c, exact = row[keep], place[keep], c[keep], exact[keep]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        last = start[np.diff(np.append(start, len(row))) == self.most]
        worst[row[last]] = exact[last + self.most - 1] - _NEAR
        return row, place, c

    def _exact(self, q: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        for s in range(0, len(row), 32_768):
            a, b = q[row[s : s + 32_768]], self.v[place[s : s + 32_768]]
            c = np.clip(np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)), -1, 1)
            c[(a.view(np.uint32) == b.view(np.uint32)).all(axis=1)] = 1.0
            out[s : s + 32_768] = c
        return out


def nearest(df: DataFrame, every: int, k: int, held: int | None = None, target: float | None = None, shard: int | None = None) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest of all rows for each vec_id that is divisible by ``every``."""
    spark, most = df.sparkSession, k + 1
    centres = _centres(df)
    placed = cut(_placed(normalised(df), centres, most))
    met = _met(placed, centres, k, held or HELD, target or RECALL)
    sizes = {i: w for w, (first, centre) in centres.items() for i in range(first, first + len(centre))}
    counts = sorted(((c, sizes.get(c, -4 * c), n) for c, n in placed.groupBy("cell").count().collect()), key=lambda x: (x[1], x[0]))
    total = sum(n * (w + 16) for _, w, n in counts)
    places, shards = _shards(counts, min(shard or SHARD, max(1 << 20, total // 16)))
    asked = cut(normalised(df.where(F.col("vec_id").cast("long") % every == 0)))
    same = cut(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    member = asked.join(same.select(F.col("id").alias("first"), F.col("v").alias("w")), F.col("v") == F.col("w")).select(F.col("id").alias("asker"), "first")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = None
        for batch in batches:
            n = int((np.asarray(batch.column("kind")) == 0).sum())  # vectors come before queries
            if n:
                held.append(batch.slice(0, n).select(["cell", "id", "v"]))
            if n < batch.num_rows:
                own = own or _Shard(held, centres, most)
                yield own.nearest(batch.slice(n))

    where = spark.createDataFrame(places, "at int, begin int, parts int")
    vectors = placed.join(F.broadcast(where), F.col("cell") == F.col("at"))
    vectors = vectors.select((F.col("begin") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "cell", "id", "v", F.lit(0).cast("float").alias("least"), F.lit(0).cast("float").alias("worst"))
    mixed = vectors.union(_sent(same, centres, _known(placed, centres, sum(n for *_, n in counts)), places, met, most)).repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("kind")
    found = mixed.mapInArrow(answer, "query long, neighbour long, cosine double")
    order = F.col("cosine").desc(), "neighbour"
    found = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("r") <= most).drop("r")
    pairs = member.join(found, F.col("first") == F.col("query")).where("asker <> neighbour").select(F.col("asker").alias("query"), "neighbour", "cosine")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")
