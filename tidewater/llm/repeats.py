"""Passages of ``LENGTH`` words or more that an earlier document has too, by prefix-free parsing.

A word of a document is repeated if it lies in a window of LENGTH words that
some document with a smaller doc_id also has.  Maximal runs of such words are
the spans; ``cut_spans`` takes them out, so a passage stays in the first
document that has it.

1. Parsing.  A rolling hash of three words triggers the end of a phrase where it
   is the least of some ``REACH`` neighbours.  Triggers depend on the nearby words
   only, so equal passages are parsed alike but for their ends, and a passage of
   LENGTH words holds at least one whole phrase (2 * REACH <= LENGTH - 2).
2. Dictionary.  Distinct phrases are kept by hash, sharded by it; those of two or
   more documents are the repeated part of the dictionary.
3. Parse.  A window of LENGTH words can only repeat if every phrase between the
   triggers that its first and its last grams choose is repeated.  The suffixes that the parse lets through, and no others, go on:
   each is named by a 64-bit rolling hash of its first LENGTH words.
4. Order.  Suffixes are sharded by that name and sorted in each shard, so equal
   beginnings are neighbours as in a suffix array; each run's smallest doc_id is
   the first owner and the others' windows are repeated.

The order of the shards and of the suffixes in them is that of hashes, not of
letters: only equality over LENGTH words matters here, and a lexicographic
order would need all text on each side of a split.

Words are those of ``words``; case and punctuation don't count.  Null and empty
texts and texts shorter than LENGTH have no spans.  Rows with a null doc_id are
neither cut nor an owner.  Rows that repeat a doc_id are one document: they
don't repeat one another, and a span of one holds for all (cut from each as far
as its text reaches).  An empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import id_and_text, list_array, prepare, raw_texts, runs, table
from .words import _MULT, Words, mix, powers

LENGTH = 50
GRAM = 3
REACH = 24
_FLUSH = 2_000_000
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_inverse = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        size = max(n, 2 * len(_inverse), 1024)
        with np.errstate(over="ignore"):
            _inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _INVERSE))))
    return _inverse[:n]


class Rolling:
    """Hashes of any ranges of a sequence of word hashes."""

    def __init__(self, h: np.ndarray) -> None:
        self.n = len(h)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(self.n))))
        self.inverse = inverse_powers(self.n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Parse:
    """The phrases of texts; a phrase reaches over the trigger at its end.

    ``low``: for each place the trigger that the REACH grams from there on choose.
    """

    def __init__(self, words: Words) -> None:
        self.words = words
        self.roll = Rolling(words.hashes())
        n = self.roll.n
        at = np.arange(max(0, n - GRAM + 1))
        gram = self.roll.hash(at, at + GRAM)
        if len(gram) < REACH:
            self.low = self.trigger = np.zeros(0, dtype=np.int64)
        else:
            self.low = np.lib.stride_tricks.sliding_window_view(gram, REACH).argmin(axis=1) + np.arange(len(gram) - REACH + 1)
            self.trigger = self.low[np.concatenate(([True], np.diff(self.low) != 0))]
        start, end = self.trigger[:-1], self.trigger[1:] + GRAM
        text = np.searchsorted(words.first, start, side="right") - 1
        self.inside = np.flatnonzero(end <= words.first[text + 1])
        self.text = text[self.inside]
        self.name = self.roll.hash(start[self.inside], end[self.inside])


def _blobs(buckets: int, name: np.ndarray, doc: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket of names: the names, doc_ids (and places) as bytes."""
    bucket = (name % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    name, doc = name[order], doc[order]
    place = None if place is None else place[order].astype(np.int32)
    used = [b for b in range(buckets) if edge[b] < edge[b + 1]]
    parts = [name[edge[b] : edge[b + 1]].tobytes() + doc[edge[b] : edge[b + 1]].tobytes() + (b"" if place is None else place[edge[b] : edge[b + 1]].tobytes()) for b in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([int(edge[b + 1] - edge[b]) for b in used], pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "n", "data"])


def _unblob(batches: Iterator[pa.RecordBatch], places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, docs, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            names.append(np.frombuffer(data, dtype=np.uint64, count=n))
            docs.append(np.frombuffer(data, dtype=np.int64, count=n, offset=8 * n))
            if places:
                at.append(np.frombuffer(data, dtype=np.int32, count=n, offset=16 * n))
    return np.concatenate(names), np.concatenate(docs), np.concatenate(at)


class _Sink:
    """Collects arrays and gives them out as blobs once there are many."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(arrays)
        self.n += len(arrays[0])
        if self.n >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _blobs(self.buckets, *(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.n = [], 0


def _candidates(words: Words, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window start in words of the text, name) of the windows that the parse lets through."""
    p = Parse(words)
    none = np.zeros(0, dtype=np.int64)
    if not len(p.name) or p.roll.n < LENGTH:
        return none, none, none.astype(np.uint64)
    owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    known = np.concatenate(hashes)
    with np.errstate(over="ignore"):
        salt = lambda t: mix(t.astype(np.uint64) + np.uint64(1))
        repeated = np.zeros(len(p.trigger), dtype=np.int64)
        repeated[p.inside] = np.isin(p.name ^ salt(p.text), known ^ salt(owner))
    # between the triggers that a window's first and last REACH grams choose, the parse depends on the window alone
    s = np.arange(p.roll.n - LENGTH + 1)
    s = s[s + LENGTH <= np.repeat(words.first[1:], np.diff(words.first))[s]]
    first, last = (np.searchsorted(p.trigger, p.low[x]) for x in (s, s + LENGTH - GRAM + 1 - REACH))
    good = np.concatenate(([0], np.cumsum(repeated)))
    s = s[good[last] - good[first] == last - first]
    of = np.searchsorted(words.first, s, side="right") - 1
    return of, s - words.first[of], p.roll.hash(s, s + LENGTH)


def merged(start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The runs that windows at the sorted starts cover together."""
    new = np.concatenate(([True], np.diff(start) > length)) if len(start) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return start[first], start[np.append(first[1:], len(start)) - 1] + length if len(start) else start


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): the starts, in words, of every repeated window of a document, in no order."""
    spark = prepare(docs.sparkSession)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts_of = id_and_text(docs).where("doc_id is not null")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink(buckets)
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for first, texts in runs(raw_texts(batch.column("text"))):
                p = Parse(Words(texts))
                order = np.lexsort((p.name, p.text))
                text, name = p.text[order], p.name[order]
                once = np.concatenate(([True], (np.diff(text) != 0) | (name[1:] != name[:-1])))[: len(text)]
                yield from sink.add(name[once], ids[first + text[once]])
        yield from sink.flush()

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, doc, _ = _unblob(batches, False)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))[: len(name)]
        size = np.diff(np.append(start, len(name)))
        many = np.repeat(doc[start] != doc[start + size - 1], size) if len(name) else np.zeros(0, dtype=bool)
        name, doc = name[many], doc[many]
        order = np.lexsort((name, doc))
        name, doc = name[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[: len(doc)]
        lists = list_array(pa.array(name.view(np.int64)), np.append(start, len(doc)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[start]), lists], names=["doc_id", "phrases"])

    repeated = texts_of.mapInArrow(phrases, "bucket int, n int, data binary").groupBy("bucket").applyInArrow(dictionary, "doc_id long, phrases array<long>")
    repeated = repeated.groupBy(F.col("doc_id").alias("__id")).agg(F.flatten(F.collect_list("phrases")).alias("phrases"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink(buckets)
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            flat = np.asarray(batch.column("phrases").flatten()).view(np.uint64)
            edge = np.concatenate(([0], np.cumsum(np.asarray(batch.column("phrases").value_lengths()))))
            for first, texts in runs(raw_texts(batch.column("text"))):
                known = [flat[edge[i] : edge[i + 1]] for i in range(first, first + len(texts))]
                text, start, name = _candidates(Words(texts), known)
                yield from sink.add(name, ids[first + text], start)
        yield from sink.flush()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, doc, at = _unblob(batches, True)
        by = np.argsort(name, kind="stable")
        sorted_name = name[by]
        start = np.flatnonzero(np.concatenate(([True], sorted_name[1:] != sorted_name[:-1])))[: len(name)]
        if not len(start):
            return
        owner = np.minimum.reduceat(doc[by], start)
        later = doc[by] > np.repeat(owner, np.diff(np.append(start, len(name))))
        doc, at = doc[by][later], at[by][later]
        by = np.lexsort((at, doc))
        doc, at = doc[by], at[by]
        start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[: len(doc)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[start]), list_array(pa.array(at), np.append(start, len(doc)))], names=["doc_id", "starts"])

    candidates = texts_of.join(repeated, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "phrases")
    shards = candidates.mapInArrow(suffixes, "bucket int, n int, data binary")
    return shards.groupBy("bucket").applyInArrow(order, "doc_id long, starts array<int>")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, starts, ends): each document's repeated runs of words, ascending; ends are exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for x in batch.column("starts"):
                a, b = merged(np.unique(np.asarray(x.values)))
                starts.append(a.astype(np.int32)), ends.append(b.astype(np.int32))
            edge = np.concatenate(([0], np.cumsum([len(a) for a in starts])))
            flat = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (starts, ends))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(list_array(pa.array(x), edge) for x in flat)], names=["doc_id", "starts", "ends"])

    each = windows(docs).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return each.mapInArrow(run, "doc_id long, starts array<int>, ends array<int>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word), one row for each span."""
    zipped = spans(docs).select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return zipped.select("doc_id", F.col("s.starts").alias("start_word"), F.col("s.ends").alias("end_word"))


def without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without the words of the spans and what comes between them and the next word."""
    words = Words([text])
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        if a >= len(words):
            break
        out.append(text[at : words.start[a]])
        at = int(words.start[b]) if b < len(words) else len(text)
    return b"".join([*out, text[at:]])


def cut_spans(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without their repeated passages.

    ``n_chars``, where the input has it, is counted again for the texts that are
    cut.  Documents of which no word remains are dropped.
    """
    names = docs.columns
    # the input's columns under names of their own, whatever they are called
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    found = spans(docs).select(F.col("doc_id").alias("id"), "starts", "ends")
    wide = plain.join(found, plain[f"c{names.index('doc_id')}"].cast("long") == found["id"], "left").drop("id")
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            hit = np.flatnonzero(np.asarray(batch.column(len(names)).is_valid()) & np.asarray(columns[text_at].is_valid()))
            keep = np.ones(batch.num_rows, dtype=bool)
            if len(hit):
                texts = columns[text_at].to_pylist()
                sizes = None if size_at is None else columns[size_at].to_pylist()
                for i in hit.tolist():
                    starts, ends = (np.asarray(batch.column(len(names) + k)[i].values) for k in range(2))
                    left = without(texts[i].encode(), starts, ends)
                    keep[i] = len(Words([left])) > 0
                    texts[i] = left.decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return wide.mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + {LENGTH}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - {LENGTH - 1})) AS s FROM words)),
firsts AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
hits AS (SELECT DISTINCT doc_id, s FROM windows JOIN firsts USING (k) WHERE doc_id > owner),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM marked)
SELECT doc_id, min(s)::INT AS start_word, (max(s) + {LENGTH})::INT AS end_word FROM runs GROUP BY doc_id, r
"""
