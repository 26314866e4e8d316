"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and, for words of seven bytes or more, their first six bytes.
Of the labelled examples at most ``EXAMPLES`` of each class are kept (those with
the lowest hash of doc_id).  The vocabulary is every term that an example has;
none is dropped.  Document frequencies are counted over all documents.  A
vector's weights are ``(1 + ln tf) * ln((1 + N) / (1 + df)) * max(1, |z|)``,
normalised, where z is the z-score of the difference between the shares of toxic
and of other examples that have the term.

The index is inverted and cut into blocks of ``BLOCK`` examples that are alike.
Terms of more than ``1 / COMMON`` of the examples (``DENSE`` at most) are kept as
rows of a dense matrix, the others as postings.  For each term with postings and
each block it holds the highest weight, so a query has an upper bound for every
block: the best sum of its common terms there, plus the highest weights of its
others.  After the best ``LEAD`` blocks, only blocks whose bound reaches the worst
of the best ``NEIGHBOURS`` are scored; the neighbours are thus exact.

A neighbour votes with ``1 / (1.05 - cosine)``, times its class's share of all
labels over its share of the examples.  The share of toxic votes is calibrated
by isotonic regression of the examples' own leave-one-out shares, which the
executors compute.

Documents without a term of any example, null and empty texts among them, have
no neighbours; their score is the smoothed toxic rate of such examples.  A
labelled document is not its own neighbour.  Equal cosines are taken by the
example's doc_id.  A doc_id that is labelled twice is toxic if any of its labels
says so; null labels and ids are passed over.  Rows that repeat a doc_id are
scored each by their own text; as an example the greatest text counts.  Very
long texts are read whole.  Without labels of both classes every score is the
toxic rate (0 without labels) and nothing is rejected; an empty table of
documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, give_back, id_and_text, list_array, prepare, raw_texts, runs, table
from .words import Words, mix, spread

EXAMPLES = 4096
NEIGHBOURS = 15
BLOCK = 64
COMMON, DENSE = 32, 512
LEAD = 2
THRESHOLD = 0.5
_TEXTS = 128  # scored at once
_POSTINGS = 2_000_000  # expanded at once


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every term, repeated as often as it comes."""
    own = words.hashes()
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    long = np.flatnonzero(words.end - words.start >= 7)
    head = np.zeros(len(long), dtype=np.uint64)
    for k in range(6):
        head = (head << np.uint64(8)) | words.data[words.start[long] + k]
    return np.concatenate((own, mix(head ^ np.uint64(0xA5A5000000000000)))), np.concatenate((text, text[long]))


def counted(words: Words, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted, of the terms (those in the sorted ``among``, as indices into it)."""
    term, text = terms(words)
    every = among
    if among is None:
        every, at = np.unique(term, return_inverse=True)
    elif len(among):
        at = np.minimum(np.searchsorted(among, term), len(among) - 1)
        hit = among[at] == term
        at, text = at[hit], text[hit]
    else:
        at, text = np.zeros(0, dtype=np.int64), text[:0]
    key = np.sort(text * max(1, len(every)) + at)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    text, at = np.divmod(key[start], max(1, len(every)))
    return text, at if among is not None else every[at], np.diff(np.append(start, len(key)))


def alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each run of ``size`` rows is alike: halves along the strongest direction, again and again."""
    out, parts = [], [np.arange(len(x))]
    while parts:
        own = parts.pop()
        if len(own) <= size:
            out.append(own)
            continue
        y = x[own] - x[own].mean(axis=0)
        direction = y[np.argmax((y * y).sum(axis=1))] if y.shape[1] else np.zeros(0)
        for _ in range(4):
            direction = y.T @ (y @ direction)
            direction = direction / max(np.sqrt(direction @ direction), 1e-300)
        own = own[np.argsort(y @ direction, kind="stable")]
        half = -(-len(own) // (2 * size)) * size
        parts += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class Index:
    """The examples' vectors by term and block, from (example, term, count) sorted by example and the terms' weights."""

    def __init__(self, doc_id: np.ndarray, toxic: np.ndarray, share: np.ndarray, term_weight: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        n, v = len(doc_id), len(term_weight)
        self.term_weight = term_weight
        value = (1 + np.log(count)) * term_weight[term]
        value = value / np.maximum(np.sqrt(np.bincount(row, weights=value * value, minlength=n)), 1e-300)[row]
        have = np.bincount(term, minlength=v)
        common = np.argsort(-have, kind="stable")[:DENSE]
        common = common[have[common] * COMMON > n]
        self.column = np.full(v, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        x = np.zeros((n, len(common)))
        x[row[dense], self.column[term[dense]]] = value[dense]
        order = alike(x, BLOCK)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.doc_id, self.toxic, self.share = doc_id[order], toxic[order], share[order]
        self.by_id = np.argsort(self.doc_id, kind="stable")
        self.blocks = -(-n // BLOCK)
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[:, :n] = x[order].T
        row, term, value = place[row[~dense]], term[~dense], value[~dense]
        by = np.lexsort((row, term))
        row, term, value = row[by], term[by], value[by]
        self.example, self.value = row.astype(np.int32), value
        # one range of postings for each term and block
        start = np.flatnonzero(np.diff(term * self.blocks + row // BLOCK, prepend=-1))
        self.range_from = np.append(start, len(row)).astype(np.int64)
        self.range_block = (row[start] // BLOCK).astype(np.int32)
        self.range_top = np.maximum.reduceat(value, start) if len(start) else value
        self.term_from = np.searchsorted(term[start], np.arange(v + 1))

    def vectors(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """The weights of (text, term, count), each text's of norm 1."""
        q = (1 + np.log(count)) * self.term_weight[term]
        return q / np.maximum(np.sqrt(np.bincount(text, weights=q * q, minlength=n)), 1e-300)[text]

    def nearest(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, own: list[int | None], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of each text's k nearest with a cosine above 0, best first; ``own``: each text's doc_id, which is left out."""
        q = self.vectors(text, term, count, len(own))
        found = []
        for a in range(0, len(own), _TEXTS):
            s, e = np.searchsorted(text, (a, a + _TEXTS))
            t, x, c = self._nearest(text[s:e] - a, term[s:e], q[s:e], own[a : a + _TEXTS], k)
            found.append((t + a, x, c))
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return tuple(np.concatenate(z) for z in zip(none, *found))

    def _nearest(self, text: np.ndarray, term: np.ndarray, q: np.ndarray, own: list[int | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, blocks = len(own), self.blocks
        column = self.column[term]
        common = column >= 0
        dense = np.zeros((b, len(self.dense)))
        dense[text[common], column[common]] = q[common]
        cosine = dense @ self.dense
        ids = np.array([-1 if i is None else i for i in own], dtype=np.int64)
        at = self.by_id[np.minimum(np.searchsorted(self.doc_id, ids, sorter=self.by_id), len(self.doc_id) - 1)]
        labelled = np.flatnonzero((self.doc_id[at] == ids) & np.array([i is not None for i in own]))
        cosine[labelled, at[labelled]] = -1e9
        bound = cosine.reshape(b, blocks, BLOCK).max(axis=2)
        text, term, q = text[~common], term[~common], q[~common]
        row, j = spread(self.term_from[term + 1] - self.term_from[term])
        ranges, weight = self.term_from[term][row] + j, q[row]
        pair = text[row] * blocks + self.range_block[ranges]
        bound = bound + np.bincount(pair, weights=weight * self.range_top[ranges], minlength=b * blocks).reshape(b, blocks)

        def add(flag: np.ndarray) -> None:
            """The postings of the flagged pairs of text and block."""
            use = np.flatnonzero(flag.ravel()[pair])
            begin = self.range_from[ranges[use]]
            size = self.range_from[ranges[use] + 1] - begin
            ends = np.cumsum(size)
            line, factor = pair[use] // blocks * cosine.shape[1], weight[use]
            edge = np.searchsorted(ends, np.arange(_POSTINGS, int(size.sum()) + _POSTINGS, _POSTINGS), side="right")
            for s, e in zip(np.append(0, edge), edge):
                if s == e:
                    continue
                n, before = size[s:e], ends[s] - size[s]
                p = np.repeat(begin[s:e] - (ends[s:e] - n - before), n)
                p += np.arange(len(p))
                at = np.repeat(line[s:e], n)
                at += self.example[p]
                cosine.ravel()[:] += np.bincount(at, weights=np.repeat(factor[s:e], n) * self.value[p], minlength=cosine.size)

        lead = np.zeros((b, blocks), dtype=bool)
        first = min(LEAD, blocks)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        np.put_along_axis(lead, best, True, axis=1)
        add(lead)
        known = np.take_along_axis(cosine.reshape(b, blocks, BLOCK), best[:, :, None], axis=1).reshape(b, -1)
        worst = np.maximum(-np.partition(-known, k - 1, axis=1)[:, k - 1], 0) if known.shape[1] >= k else np.zeros(b)
        more = ~lead & (bound > np.maximum(worst, 1e-300)[:, None] - 1e-9)
        add(more)
        scored = np.where((lead | more)[:, :, None], cosine.reshape(b, blocks, BLOCK), 0).reshape(b, -1)
        text, example = np.nonzero((scored > 1e-12) & (scored >= worst[:, None] - 1e-9))
        value = scored[text, example]
        order = np.lexsort((self.doc_id[example], -np.round(value, 12), text))
        text, example, value = text[order], example[order], value[order]
        start = np.searchsorted(text, np.arange(b))
        keep = np.arange(len(text)) - start[text] < k
        return text[keep], example[keep], np.minimum(value[keep], 1.0)

    def shares(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Each text's share of toxic votes; nan for one without neighbours."""
        vote = self.share[example] / (1.05 - cosine)
        total = np.bincount(text, weights=vote, minlength=n)
        with np.errstate(invalid="ignore"):
            return np.round(np.bincount(text, weights=vote * self.toxic[example], minlength=n) / total, 9)


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    index: Index | None
    steps: np.ndarray  # calibration: share from which on ...
    levels: np.ndarray  # ... the score is this
    none: float  # without a term of the examples

    def neighbours(self, words: Words, doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.index.nearest(*counted(words, self.vocabulary), doc_ids)

    def score(self, words: Words, doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text; text, example, cosine of the neighbours)."""
        n = len(doc_ids)
        if self.index is None:
            empty = np.zeros(0, dtype=np.int64)
            return np.full(n, self.none), empty, empty, np.zeros(0)
        text, example, cosine = self.neighbours(words, doc_ids)
        share = self.index.shares(text, example, cosine, n)
        return np.where(np.isnan(share), self.none, self.calibrated(np.nan_to_num(share))), text, example, cosine

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return self.levels[np.maximum(0, np.searchsorted(self.steps, share, side="right") - 1)]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, levels) of the non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * w
            pools[-1][2] += w
        else:
            pools.append([a, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def sample(docs: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, text), one row for each of a bounded list of ids whose text isn't null; of repeated rows the greatest text."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "__id long")
    hit = id_and_text(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"), "left_semi").where("text is not null")
    return cut(hit.groupBy("doc_id").agg(F.max("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """``examples``: how many labelled documents of each class the index holds at most."""
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") != 0).count().collect()}
    rate = total.get(True, 0) / max(1, sum(total.values()))
    nothing = Model(np.zeros(0, dtype=np.uint64), None, np.zeros(0), np.zeros(0), rate)
    if len(total) < 2:
        return nothing
    label: dict[int, bool] = {}
    for toxic in (False, True):
        part = known.where((F.col("toxic") != 0) == F.lit(toxic)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        label |= {r[0]: toxic for r in part.collect()}
    chosen = sample(docs, list(label))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(raw_texts(batch.column("text"))):
                text, term, count = counted(Words(texts))
                edge = np.searchsorted(text, np.arange(len(texts) + 1))
                lists = [[x[a:b].tobytes() for a, b in zip(edge, edge[1:])] for x in (term, count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(pa.array(x, pa.binary()) for x in lists)], names=["doc_id", "terms", "counts"])

    found = chosen.mapInArrow(taken, "doc_id long, terms binary, counts binary").toArrow().sort_by("doc_id")
    doc_id = np.asarray(found.column("doc_id"), dtype=np.int64)
    toxic = np.array([label[i] for i in doc_id.tolist()], dtype=bool)
    if not toxic.any() or toxic.all():
        return nothing
    each = [np.frombuffer(x, dtype=np.uint64) for x in found.column("terms").to_pylist()]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    vocabulary, term = np.unique(np.concatenate(each), return_inverse=True)
    count = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in found.column("counts").to_pylist()])
    del each, found
    give_back()
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    n, v = n1 + n0, len(vocabulary)
    a, b = np.bincount(term, weights=toxic[row], minlength=v), np.bincount(term, weights=~toxic[row], minlength=v)
    of_all = (a + b + 1) / (n + 2)
    z = (a / n1 - b / n0) / np.sqrt(of_all * (1 - of_all) * (1 / n1 + 1 / n0))
    share = np.where(toxic, rate / (n1 / n), (1 - rate) / (n0 / n))
    words = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(v, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in runs(raw_texts(batch.column("text"))):
                df += np.bincount(counted(Words(texts), words.value)[1], minlength=v)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], rows))], names=["term", "n"])

    df = np.zeros(v)
    counts = id_and_text(docs).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, times = np.asarray(counts.column("term")), np.asarray(counts.column("n"))
    df[at[at >= 0]], total_docs = times[at >= 0], int(times[at < 0].sum())
    words.destroy()
    del counts, at, times
    index = Index(doc_id, toxic, share, np.log((1 + total_docs) / (1 + df)) * np.maximum(1, np.abs(z)), row, term, count)
    del row, term, count
    give_back()
    bare = Model(vocabulary, index, np.zeros(1), np.zeros(1), rate)
    shared = spark.sparkContext.broadcast(bare)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in runs(raw_texts(batch.column("text"))):
                part = ids[first : first + len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own.index.shares(*own.neighbours(Words(texts), part), len(part)))], names=["doc_id", "share"])

    # the checkpoint may have few partitions
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own_share = {r[0]: r[1] for r in chosen.repartition(parts, "doc_id").mapInArrow(left_out, "doc_id long, share double").collect()}
    shared.destroy()
    x = np.array([own_share[i] for i in doc_id.tolist()])
    seen = ~np.isnan(x)
    none = float(((share * toxic)[~seen].sum() + rate) / (share[~seen].sum() + 1))
    steps, levels = isotonic(x[seen], toxic[seen].astype(float), share[seen]) if seen.any() else (np.zeros(1), np.full(1, rate))
    return Model(vocabulary, index, steps, levels, none)


def _scored(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    ids = batch.column("doc_id").to_pylist()
    for first, texts in runs(raw_texts(batch.column("text"))):
        yield first, len(texts), model.score(Words(texts), ids[first : first + len(texts)])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic, neighbours, cosines), one row for each row of the input, without a shuffle.

    ``neighbours`` are the doc_ids of the nearest examples: the evidence.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, n, (values, text, example, cosine) in _scored(own, batch):
                ends = np.searchsorted(text, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        pa.array(values),
                        pa.array(values >= threshold if own.index is not None else np.zeros(n, dtype=bool)),
                        list_array(pa.array(own.index.doc_id[example] if len(example) else example), ends),
                        list_array(pa.array(cosine), ends),
                    ],
                    names=["doc_id", "score", "toxic", "neighbours", "cosines"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, toxic boolean, neighbours array<long>, cosines array<double>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model doesn't reject; no shuffle."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own.index is None:
                yield batch
                continue
            keep = [values < threshold for _, _, (values, *_) in _scored(own, batch)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *keep])))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
