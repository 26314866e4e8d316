"""Unbounded n-gram scoring of every document against the whole corpus.

Each word is predicted from the longest context (the words just before it in its
document, of any length from 1 on) that comes at another place of the corpus too:

    p(w | c) = (n(c w) + ALPHA * u(w)) / (n(c) + ALPHA)

where the counts leave out the place that is scored, and u is the unigram
distribution of all words.  A word without a context that recurs has u(w).  The
counts of the ``UNIGRAMS`` most frequent words are sent to every executor; places
of the others are joined with the table of all counts.

The prefix sums of the words' hashes are appended to one file in the folder that
all executors share, so that any context of any place can be hashed from two of
them.  Places are sharded by their last context word, or by the last two if the
last alone comes more than ``HEAVY`` times.  In a shard, contexts of 1, 2, 4, 8, ...
words are grouped as long as they recur, and the lengths between two of these are
bisected, with one place standing for all that agree further on (``_longest``).
Places after a ``HEAVY`` word without a longer context take their counts from a
table of the pairs that such words begin.  All words and contexts are compared by
64-bit hashes.

Documents without words (null, empty) have n_words 0 and null scores.  Rows that
repeat a doc_id are scored as one document; so are those with a null doc_id.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, id_and_text, prepare, raw_texts, release, runs, shared_folder, table
from .repeats import inverse_powers
from .words import Words, mix, powers

ALPHA = 1.0
UNIGRAMS = 65_535
_NO_ID = -(2**63)
HEAVY = 200_000
_FLUSH = 1_200_000
_SUMS = "doc_id long, n long, logp double, context double"


class Unigrams:
    """The frequent words' probabilities, and the number of all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, heavy: int) -> None:
        order = np.argsort(words)
        self.word, count = words[order], counts[order]
        self.total = max(1, total)
        self.p = count / self.total
        self.heavy = self.word[count > heavy]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the word is in the table, its probability)."""
        known, at = _among(self.word, h)
        p = np.ones(len(h))
        p[known] = self.p[at[known]]
        return known, p


def _among(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each hash is in the sorted words, where)."""
    if not len(words):
        return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return words[at] == h, at


def _counts(docs: DataFrame, keys: Callable[[Words], np.ndarray]) -> DataFrame:
    """(w, n): how often each of the keys comes in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = [], [], 0

        def total() -> pa.RecordBatch:
            each, which = np.unique(np.concatenate(words), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.bincount(which, weights=np.concatenate(counts)).astype(np.int64))], names=["w", "n"])

        for batch in batches:
            for _, texts in runs(raw_texts(batch.column("text"))):
                each, k = np.unique(keys(Words(texts)), return_counts=True)
                words.append(each), counts.append(k)
                n += len(each)
                if n > 1_000_000:
                    yield total()
                    words, counts, n = [], [], 0
        if n:
            yield total()

    return cut(id_and_text(docs).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))


def unigrams(each: DataFrame, size: int = UNIGRAMS, heavy: int = HEAVY) -> Unigrams:
    total = each.agg(F.sum("n")).first()[0]
    top = each.orderBy(F.col("n").desc(), "w").limit(size).toArrow()
    return Unigrams(np.asarray(top.column("w")).view(np.uint64), np.asarray(top.column("n")), total or 0, heavy)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    with np.errstate(over="ignore"):
        return mix(mix(a.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def _pairs(heavy: np.ndarray) -> Callable[[Words], np.ndarray]:
    """The pairs that heavy words begin, and these words themselves where a word follows."""

    def keys(words: Words) -> np.ndarray:
        h = words.hashes()
        after = np.ones(len(h), dtype=bool)
        after[words.first[:-1][words.first[:-1] < len(h)]] = False
        i = np.flatnonzero(after)
        i = i[_among(heavy, h[i - 1])[0]]
        return np.concatenate((_joined(h[i - 1], h[i]), h[i - 1]))

    return keys


def _append(path: str, data: np.ndarray) -> int:
    """Add to a file that other tasks add to as well; the place, in elements, where the data begin."""
    with open(path, "ab") as f:
        fcntl.lockf(f, fcntl.LOCK_EX)
        at = f.seek(0, os.SEEK_END)
        at += f.write(b"\0" * (-at % 8))  # a task that was killed may have left a part of an element
        f.write(data)
        f.flush()
    return at // 8


def _pack(*columns: np.ndarray) -> bytes:
    """32-bit columns as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(-1, 4, n)
    return [np.ascontiguousarray(c.T).view(np.uint32).ravel() for c in raw]


def _shards_of(shards: int, base: int, size: int, texts: int, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row for each shard: the rest of the keys, sorted and as differences, and the places ``at``, ascending within a key."""
    shard = (key % np.uint64(shards)).astype(np.int64)
    rest = (key // np.uint64(shards)).astype(np.uint32)
    order = np.argsort((shard.astype(np.uint64) << np.uint64(32)) | rest, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    rows: list[tuple[int, int, int, int, int, bytes]] = []
    for s in range(shards):
        own = order[edge[s] : edge[s + 1]]
        if len(own):
            rows.append((s, len(own), base, size, texts, _pack(np.diff(rest[own].astype(np.int64), prepend=0), at[own])))
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shard", "n", "base", "size", "texts", "data"])


_BLOB = "shard int, n int, base long, size long, texts int, data binary"


def _read_shard(batches: Iterator[pa.RecordBatch], file: np.ndarray, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A shard's (documents, bases, places from the base, places in the text) in ranges of keys of about ``most`` places; a key's places are never parted."""
    parts = []
    for batch in batches:
        for n, base, size, texts, data in zip(*(batch.column(c).to_pylist() for c in ("n", "base", "size", "texts", "data"))):
            rest, at = _unpack(data, n)
            parts.append((np.cumsum(rest, dtype=np.int64), at, base, size, texts))
    total = sum(len(p[0]) for p in parts)
    ranges = -(-total // most)
    top = max((int(p[0][-1]) for p in parts), default=0) + 1
    limits = np.arange(ranges + 1) * top // max(1, ranges)
    edges = [np.searchsorted(p[0], limits) for p in parts]
    for r in range(ranges):
        found: list[tuple[np.ndarray, ...]] = []
        for (_, all_at, base, size, texts), e in zip(parts, edges):
            if e[r] < e[r + 1]:
                at = all_at[e[r] : e[r + 1]].astype(np.int64)
                first, ids = file[base + size : base + size + 2 * texts].view(np.int64).reshape(2, texts)
                text = np.searchsorted(first, at, side="right") - 1
                found.append((ids[text], np.full(len(at), base), at, at - first[text]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _number(key: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of each key's group, how many groups)."""
    order = np.argsort(key)
    sort = key[order]
    number = np.empty(len(key), dtype=np.int64)
    number[order] = rank = np.concatenate(([0], np.cumsum(sort[1:] != sort[:-1])))[: len(key)]
    return number, int(rank[-1]) + 1 if len(key) else 0


def _longest(context: Callable[[np.ndarray, np.ndarray], np.ndarray], place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the length of its longest context that recurs, and that context's counts alone and with the word.

    ``context(items, lengths)`` hashes contexts.  Going up, contexts of 1, 2, 4, ...
    words are grouped while they recur.  A place that is alone at 2 * r has its length
    in r ... 2 * r - 1: its group of r goes down to be bisected.  There, those that
    agree at the middle stand as one (for each following word, with their number)
    for the places that don't, which are looked for in the lower half; in the
    upper half the same is done among themselves.
    """
    length, alone, both = np.zeros(len(place), dtype=np.int64), np.ones(len(place), dtype=np.int64), np.ones(len(place), dtype=np.int64)

    def parted(item: np.ndarray, group: np.ndarray, many: np.ndarray, final: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(items that recur at n, their groups, what goes down: items, groups, numbers, whether they are looked for)."""
        has = np.flatnonzero(place[item] >= n)
        sub, size = _number(_joined(group[has], context(item[has], n[has])))
        again = np.bincount(sub, weights=many[has], minlength=size)[sub] > 1
        recur, sub = has[again], sub[again]
        rest = np.ones(len(item), dtype=bool)
        rest[recur] = False
        rest = np.flatnonzero(rest)
        pair, pairs = _number(_joined(sub, word[item[recur]]))
        first = np.empty(pairs, dtype=np.int64)
        first[pair] = np.arange(len(pair))
        stand = recur[first]
        down = np.concatenate((rest, stand))
        number = np.concatenate((many[rest], np.bincount(pair, weights=many[recur], minlength=pairs).astype(np.int64)))
        sought = np.concatenate((final[rest], np.zeros(pairs, dtype=bool)))
        return recur, sub, (down, number, sought)

    def wanted(group: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Rows of groups in which a place is looked for."""
        return np.flatnonzero(np.bincount(group, weights=final)[group] > 0) if len(group) else np.zeros(0, dtype=np.int64)

    live = np.flatnonzero(place >= 1)
    group, size = _number(context(live, np.ones(len(live), dtype=np.int64)))
    keep = np.bincount(group, minlength=size)[group] > 1
    live, group = live[keep], group[keep]
    waiting, n = [], 1
    while len(live):
        one = np.ones(len(live), dtype=np.int64)
        recur, sub, (down, number, sought) = parted(live, group, one, one.astype(bool), 2 * n * one)
        use = wanted(group[down], sought)
        waiting.append((live[down][use], group[down][use], number[use], sought[use], np.full(len(use), n)))
        live, group, n = live[recur], sub, 2 * n
    rows = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool, np.int64))
    step = n // 2
    while True:
        # those of contexts of 2 * step and more are in rows, each with the length that it is sure of
        if waiting:
            new = waiting.pop()
            shift = rows[1].max() + 1 if len(rows[1]) else 0
            rows = tuple(np.concatenate((a, b + shift if k == 1 else b)) for k, (a, b) in enumerate(zip(rows, new)))
        step //= 2
        if not step:
            break
        item, group, many, final, low = rows
        recur, sub, (down, number, sought) = parted(item, group, many, final, low + step)
        up, below = wanted(sub, final[recur]), wanted(group[down], sought)
        shift = sub.max() + 1 if len(sub) else 0
        rows = (
            np.concatenate((item[recur][up], item[down][below])),
            np.concatenate((sub[up], group[down][below] + shift)),
            np.concatenate((many[recur][up], number[below])),
            np.concatenate((final[recur][up], sought[below])),
            np.concatenate((low[recur][up] + step, low[down][below])),
        )
    item, group, many, final, low = rows
    if len(item):
        pair, pairs = _number(_joined(group, word[item]))
        own = item[final]
        length[own] = low[final]
        alone[own] = np.bincount(group, weights=many)[group[final]].astype(np.int64)
        both[own] = np.bincount(pair, weights=many, minlength=pairs)[pair[final]].astype(np.int64)
    return length, alone, both


_PARTS = "bucket int, n int, ids binary, counts binary"
_LATE = "w long, pair long, own long, alone long, together long"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    """Sums of documents, a row for each bucket."""
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "n", "ids", "counts"])


def _open_places(w: np.ndarray, pair: np.ndarray, own: np.ndarray, alone: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
    """Places whose word or, where it isn't 0, pair is yet to be joined with its count, in one row without a bucket."""
    order = np.lexsort((own, w, pair))
    halves = [h[order] for c in (w, pair, own, alone, both) for h in c.view(np.uint32).reshape(-1, 2).T]
    return _parts([(None, len(w), b"", _pack(*halves))])


def _read_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist()):
            halves = _unpack(data, n)
            columns = [np.ascontiguousarray(np.stack(halves[k : k + 2], axis=1)).view(np.int64).ravel() for k in range(0, 10, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w", "pair", "own", "alone", "together"])


def _bucketed(buckets: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in ids) of the buckets that have any."""
    bucket = (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, order[edge[b] : edge[b + 1]]


def _sum_rows(buckets: int, doc: np.ndarray, logp: np.ndarray, context: np.ndarray) -> list[tuple]:
    """Each document's number of places, sum of logarithms and of context lengths, a row for each bucket of documents."""
    ids, at = np.unique(doc, return_inverse=True)
    n, total, length = (np.bincount(at, weights=w, minlength=len(ids)) for w in (None, logp, context))
    words = length.astype(np.uint64)
    packed = total.astype(np.float32).view(np.uint32)
    return [(b, len(own), ids[own].tobytes(), _pack(n[own], packed[own], words[own], words[own] >> np.uint64(32))) for b, own in _bucketed(buckets, ids)]


def _read_sums(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    parts = []
    for batch in batches:
        for n, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "counts"))):
            number, total, low, high = _unpack(counts, n)
            parts.append((np.frombuffer(ids, dtype=np.int64), number, total.view(np.float32), low + high.astype(np.float64) * 2.0**32))
    doc, *rest = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(doc, return_inverse=True)
    n, logp, context = (np.bincount(at, weights=w, minlength=len(ids)) for w in rest)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(logp), pa.array(context)], names=["doc_id", "n", "logp", "context"])


def _chance(with_word: np.ndarray, alone: np.ndarray, p: np.ndarray, alpha: float) -> np.ndarray:
    return np.log((with_word - 1 + alpha * p) / (alone - 1 + alpha))


def score(docs: DataFrame, alpha: float = ALPHA, size: int = UNIGRAMS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, mean_logp, perplexity, mean_context), one row for each doc_id."""
    spark = prepare(docs.sparkSession)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = _counts(docs, Words.hashes)
    table_ = unigrams(each, size, heavy)
    begun = _counts(docs, _pairs(table_.heavy)) if len(table_.heavy) else each.where("false")
    # how often a word follows each heavy word
    heads = {r[0]: r[1] for r in begun.where(F.col("w").isin(table_.heavy.view(np.int64).tolist())).collect()} if len(table_.heavy) else {}
    table_.followed = np.array([heads.get(w, 0) for w in table_.heavy.view(np.int64).tolist()], dtype=np.int64)
    base = spark.sparkContext.broadcast(table_)
    release(spark)
    shared = shared_folder(spark)
    if "://" in shared.removeprefix("file://"):
        raise ValueError("op3 reads places at random: spark.checkpoint.dir must be a mounted folder that all executors share")
    shared = shared.removeprefix("file:") if not shared.startswith("file://") else shared.removeprefix("file://")
    os.makedirs(shared, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="words-", dir=shared)
    path = f"{folder}/sums"
    open(path, "wb").close()
    os.chmod(folder, 0o777), os.chmod(path, 0o666)
    texts_of = id_and_text(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = base.value
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, place, first, doc = (np.concatenate(x) for x in zip(*parts))
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(len(h)))))
            start = _append(path, np.concatenate((sums, first.view(np.uint64), doc.view(np.uint64))))
            i = np.flatnonzero(place >= 1)
            key = mix(h[i - 1])
            two = _among(uni.heavy, h[i - 1])[0]
            far = np.flatnonzero(two & (place[i] >= 2))
            key[far] = _joined(h[i[far] - 1], h[i[far] - 2])
            # a heavy word that begins its text has no context of two to share
            lone = np.flatnonzero(two & (place[i] < 2))
            key[lone] = _joined(h[i[lone] - 1], h[i[lone]])
            return _shards_of(shards, start, len(sums), len(first), key, i)

        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for first, texts in runs(raw_texts(batch.column("text"))):
                words = Words(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(words.first))
                has = np.flatnonzero(np.diff(words.first))
                parts.append((words.hashes(), np.arange(len(words)) - words.first[text], n + words.first[has], ids[first + has]))
                n += len(words)
                if n >= _FLUSH:
                    yield flush()
                    parts, n = [], 0
        if n:
            yield flush()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = base.value
        all_sums = np.memmap(path, dtype=np.uint64, mode="r")
        sums: list[tuple[np.ndarray, ...]] = []
        for doc, start, at, place in _read_shard(batches, all_sums):
            inverse = inverse_powers(int(at.max()) + 2)
            g = start + at
            here = all_sums[g]

            def context(items: np.ndarray, n: np.ndarray) -> np.ndarray:
                with np.errstate(over="ignore"):
                    return mix((here[items] - all_sums[g[items] - n]) * inverse[at[items] - n] + n.astype(np.uint64))  # noqa: B023

            with np.errstate(over="ignore"):
                word = (all_sums[g + 1] - here) * inverse[at]
                last = (here - all_sums[g - 1]) * inverse[at - 1]
            length, alone, both = _longest(context, place, word)
            known, p = uni.look(word)
            # by their last two words, these met only a part of the places with their last one
            two, rank = _among(uni.heavy, last)
            two &= length < 2
            length[two], alone[two] = np.where(uni.followed[rank[two]] > 1, 1, 0), uni.followed[rank[two]]
            ready = known & ~two
            logp = np.where(length > 0, _chance(both, alone, p, alpha), np.log(p))
            sums.append((doc, np.where(ready, logp, 0.0), length.astype(np.uint32)))
            late = np.flatnonzero(~ready)
            if len(late):
                alone[length == 0] = 0
                yield _open_places(word[late], np.where(two[late], _joined(last[late], word[late]), np.uint64(0)), doc[late], alone[late], both[late])
        if sums:
            yield _parts(_sum_rows(shards, *(np.concatenate(x) for x in zip(*sums))))

    try:
        once = cut(texts_of.mapInArrow(places, _BLOB).groupBy("shard").applyInArrow(found, _PARTS))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    release(spark)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first word of each text, which has no context, and texts without words."""
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for first, texts in runs([None if t is None else _head(t) for t in raw_texts(batch.column("text"))]):
                words = Words(texts)
                has = np.diff(words.first) > 0
                w = np.zeros(len(texts), dtype=np.uint64)
                w[has] = words.hashes()[words.first[:-1][has]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(texts)]), pa.array(w.view(np.int64), mask=~has)], names=["own", "w"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _read_sums(batches)

    summed = once.where("bucket is not null").groupBy("bucket").applyInArrow(total, _SUMS)
    begin = texts_of.mapInArrow(starts, "own long, w long")
    late = once.where("bucket is null").mapInArrow(_read_open, _LATE)
    pairs = begun.select(F.col("w").alias("pair_"), F.col("n").alias("pair_n"))
    # the places that need no pair count aren't shuffled by it
    paired = late.where("pair <> 0").join(pairs, F.col("pair") == F.col("pair_")).select("w", "own", "alone", F.col("pair_n").alias("together"))
    late = late.where("pair = 0").select("w", "own", "alone", "together").union(paired).withColumn("first", F.lit(0))
    late = late.union(begin.where("w is not null").select("w", "own", F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(1)))
    p = F.col("u") / F.lit(float(table_.total))
    logp = F.when(F.col("alone") > 1, F.log((F.col("together") - 1 + alpha * p) / (F.col("alone") - 1 + alpha))).otherwise(F.log(p))
    late = late.join(each.select(F.col("w").alias("w_"), F.col("n").alias("u")), F.col("w") == F.col("w_"))
    late = late.groupBy("own").agg(F.sum("first").cast("long").alias("n"), F.sum(logp).alias("logp")).select(F.col("own").alias("doc_id"), "n", "logp", F.lit(0.0).alias("context"))
    blank = begin.where("w is null").select(F.col("own").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("logp"), F.lit(0.0).alias("context"))
    summed = summed.union(late).union(blank).groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("logp").alias("logp"), F.sum("context").alias("context"))
    mean = F.when(F.col("n_words") > 0, F.col("logp") / F.col("n_words"))
    return summed.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", mean.alias("mean_logp"), F.exp(-mean).alias("perplexity"), F.when(F.col("n_words") > 0, F.col("context") / F.col("n_words")).alias("mean_context")
    )


def _head(text: bytes) -> bytes:
    """The text up to the end of its first word or, where that takes long to find, all of it."""
    for size in (200, 20_000):
        part = text[:size]
        if len(part) == len(text) or len(Words([part])) > 1:
            return part
    return text


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
