"""SimHash near-duplicate search by pigeonhole blocks.

A word's 256 bits are its SHA-256.  A document's fingerprint has bit j set where
the words with the bit outweigh those without; a word that comes n times weighs
the number of binary digits of n.  Two documents are a close pair if their first
64 bits differ in at most ``NEAR`` places and all 256 in at most ``NEAR_ALL``.

The first 64 bits are split into ``BLOCKS`` blocks.  Bits that differ in at most
NEAR places leave BLOCKS - NEAR blocks equal, so close pairs meet in at least one
of the choices of that many blocks.  Fingerprints are joined on each choice's
blocks; nothing is sampled or capped.  Where more than ``LEAF`` meet, the bits in
which they still differ are split once more into NEAR + 1 blocks, of which a close
pair has one in common, and so on, as long as that leaves fewer pairs: what a
fingerprint is compared with doesn't grow with the table.  Every pair that is left
is verified.  Equal fingerprints are one node of the search, so groups of thousands
of copies cost no pairs.  Groups are the connected components; the smallest doc_id stays.

Null texts and texts without words have no fingerprint and belong to no group.
Texts of any length are fingerprinted whole.  Rows with a null doc_id can't be named
and are passed over.  Rows that repeat a doc_id are one document; they alone make
no group.  An empty table has no groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, id_and_text, prepare, raw_texts, runs, table
from .components import components
from .words import Words, spread

NEAR, NEAR_ALL, BLOCKS = 7, 40, 9
LEAF = 128
_ROWS = 250_000  # of a bucket of keys, on average
_PAIRS = 4_000_000  # held at once
_FP = ["f0", "f1", "f2", "f3"]


def fingerprint_batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 uint64 fingerprints, whether the text has words)."""
    words = Words(texts)
    out = np.zeros((len(texts), 4), dtype=np.uint64)
    has = np.diff(words.first) > 0
    if not len(words):
        return out, has
    _, one, which = words.distinct()
    data = words.data.tobytes()
    digest = b"".join(hashlib.sha256(data[s:e]).digest() for s, e in zip(words.start[one].tolist(), words.end[one].tolist()))
    bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(-1, 32), axis=1).astype(np.int8)
    signs = (2 * bits - 1).astype(np.int16)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    pair, count = np.unique(doc * len(one) + which, return_counts=True)
    weight = np.frexp(count)[1]
    doc, word = np.repeat(pair // len(one), weight), np.repeat(pair % len(one), weight)
    step = 30_000  # sums of so many signs fit
    for a in range(0, len(doc), step):
        b = min(a + step, len(doc))
        d = doc[a:b]
        start = np.flatnonzero(np.diff(d, prepend=-1))
        part = np.add.reduceat(signs[word[a:b]], start, axis=0)
        if a == 0:
            sums = np.zeros((len(texts), 256), dtype=np.int32)
        sums[d[start]] += part
    packed = np.packbits(sums > 0, axis=1)
    out[:] = packed.view(">u8")
    return out, has


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, f2, f3) of the documents that have an id and words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(raw_texts(batch.column("text"))):
                fp, has = fingerprint_batch(texts)
                ids = batch.column("doc_id").slice(first, len(texts)).filter(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(fp[has, k]).view(np.int64)) for k in range(4))], names=["doc_id", *_FP])

    return id_and_text(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, f0 long, f1 long, f2 long, f3 long")


def choices(near: int = NEAR, blocks: int = BLOCKS) -> list[int]:
    """The bit masks of the choices of blocks - near blocks of 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [sum(1 << j for j in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - near)]


def split(bits: int, parts: int) -> np.ndarray:
    """Masks of so many blocks of the bits that are set."""
    at = [j for j in range(64) if bits >> j & 1]
    return np.array([sum(1 << j for j in at[k::parts]) for k in range(parts)], dtype=np.uint64)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)


def close(fp: np.ndarray, key: np.ndarray, near: int, near_all: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (i, j) whose components are those of all close pairs of equal keys, and how many pairs were compared; the keys are sorted."""
    f0 = np.ascontiguousarray(fp[:, 0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = compared = 0

    def compare(rows: np.ndarray, key: np.ndarray) -> None:
        nonlocal found, held, compared
        if not len(rows):
            return
        start = _starts(key)
        last = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
        i, d = np.arange(len(key)), 1
        while len(i := i[i + d < last[i]]):
            compared += len(i)
            for s in range(0, len(i), 1_000_000):
                a, b = rows[i[s : s + 1_000_000]], rows[i[s : s + 1_000_000] + d]
                good = np.bitwise_count(f0[a] ^ f0[b]) <= near
                a, b = a[good], b[good]
                good = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= near_all
                if good.any():
                    found.append((a[good], b[good]))
                    held += int(good.sum())
                    if held > _PAIRS:
                        found = [forest(*(np.concatenate(x) for x in zip(*found)))]
                        held = 0
            d += 1

    todo = [(np.arange(len(key)), key)]
    while todo:
        rows, key = todo.pop()
        start = _starts(key)
        size = np.diff(np.append(start, len(key)))
        few = np.repeat((size > 1) & (size <= leaf), size)
        compare(rows[few], key[few])
        for s, n in zip(start[size > leaf].tolist(), size[size > leaf].tolist()):
            own = rows[s : s + n]
            f = f0[own]
            bits = int(np.bitwise_or.reduce(f) ^ np.bitwise_and.reduce(f))
            finer, pairs = [], 0
            for mask in split(bits, near + 1) if bits.bit_count() > 2 * near else ():
                order = np.argsort(f & mask, kind="stable")
                sub = f[order] & mask
                pairs += int((np.diff(np.append(_starts(sub), n)).astype(np.int64) ** 2).sum())
                finer.append((own[order], sub))
            if finer and pairs < n * n // 2:
                todo += finer
            else:
                compare(own, np.zeros(n, dtype=np.uint64))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), compared
    return *(np.concatenate(x) for x in zip(*found)), compared


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest of its component) with the components of the edges (a, b)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            break
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def close_edges(nodes: DataFrame, near: int = NEAR, near_all: int = NEAR_ALL, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): edges whose components are those of all close pairs of (node, f0, f1, f2, f3)."""
    masks = np.array(choices(near, blocks), dtype=np.uint64)
    buckets = max(1, -(-nodes.count() * len(masks) // _ROWS))

    def spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("f0")).view(np.uint64)
            for s in range(0, len(fp), 8192):
                part = batch.slice(s, 8192)
                own = fp[s : s + 8192]
                with np.errstate(over="ignore"):
                    key = ((own[:, None] & masks) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(len(masks), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(32)
                row = pa.array(np.repeat(np.arange(len(own)), len(masks)))
                key = key.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(key.view(np.int64)), *(part.column(c).take(row) for c in ["node", *_FP])], names=["bucket", "key", "node", *_FP]
                )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        key = np.asarray(whole.column("key"))
        order = np.argsort(key, kind="stable")
        node = np.asarray(whole.column("node"))[order]
        fp = np.stack([np.asarray(whole.column(c))[order].view(np.uint64) for c in _FP], axis=1)
        i, j, _ = close(fp, key[order], near, near_all)
        a, b = forest(node[i], node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = nodes.mapInArrow(spread_keys, "bucket int, key long, node long, f0 long, f1 long, f2 long, f3 long")
    return keys.groupBy("bucket").applyInArrow(find, "a long, b long").distinct()


def groups(docs: DataFrame, near: int = NEAR, near_all: int = NEAR_ALL, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, group_id, n_docs) of the documents in groups of two or more; group_id is the doc_id that stays."""
    fps = cut(fingerprints(docs))
    nodes = fps.groupBy(*_FP).agg(F.min("doc_id").alias("node"))
    by = nodes.select("node", *(F.col(c).alias(f"n{c}") for c in _FP))
    named = cut(fps.join(by, [F.col(c) == F.col(f"n{c}") for c in _FP]).select("doc_id", "node").distinct())
    # two fingerprints of one doc_id (repeated rows of different texts) are one document
    same = named.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    root = components(close_edges(nodes, near, near_all, blocks).union(same))
    ids = named.select("doc_id").distinct().join(root, F.col("doc_id") == F.col("id"), "left")
    ids = ids.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    size = ids.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    return ids.join(size, F.col("group_id") == F.col("g")).drop("g")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, without those that another of their group stands for."""
    gone = groups(docs, **how).where("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, w, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS w
        FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL),
hashed AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM words)),
hexes AS (SELECT doc_id, p, ('0x' || substr(h, p::INT, 1))::INT AS x, sum(length(bin(n))) AS m
    FROM words JOIN hashed USING (w), range(1, 65) r(p) GROUP BY ALL),
bits AS (SELECT doc_id, p, b, sum(CASE WHEN (x >> b) & 1 = 1 THEN m ELSE -m END) > 0 AS set
    FROM hexes, range(4) s(b) GROUP BY ALL),
parts AS (SELECT doc_id, (p - 1) // 16 AS k, sum(CASE WHEN set THEN (1::HUGEINT << (4 * (15 - (p - 1) % 16) + b)::INT) ELSE 0 END)::UBIGINT AS f FROM bits GROUP BY ALL),
fps AS (SELECT doc_id, max(f) FILTER (k = 0) AS f0, max(f) FILTER (k = 1) AS f1, max(f) FILTER (k = 2) AS f2, max(f) FILTER (k = 3) AS f3 FROM parts GROUP BY doc_id),
edges AS (SELECT x.doc_id AS a, y.doc_id AS b FROM fps x JOIN fps y ON x.doc_id <> y.doc_id AND bit_count(xor(x.f0, y.f0)) <= {NEAR}
    AND bit_count(xor(x.f0, y.f0)) + bit_count(xor(x.f1, y.f1)) + bit_count(xor(x.f2, y.f2)) + bit_count(xor(x.f3, y.f3)) <= {NEAR_ALL}),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS doc_id, least(a, min(b)) AS group_id, count(DISTINCT b) AS n_docs FROM reach GROUP BY a
"""
