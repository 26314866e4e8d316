"""Near-copies among embeddings by Euclidean p-stable hashing.

Each of ``TABLES`` tables projects the normalised vectors on ``PROJECTIONS``
Gaussian directions, shifts and quantises by ``WIDTH``; equal quantised
projections share a bucket.  All pairs of a bucket have their cosine computed;
those of ``COSINE`` or more are near copies.  Groups are the connected components
and take the smallest vec_id.  Equal vectors are one node of the search, and
a bucket gives the edges of a spanning forest, so large groups cost few rows.

At a cosine of 0.95 a table brings a pair together with a chance of 0.16, all 24
with 0.98; at 0.98 it is over 0.999.  Vectors of different sizes are never
compared.  For rows that are passed over see ``vectors.normalised``; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, table
from .components import components
from .simhash import forest
from .vectors import matrix, normalised
from .words import mix

COSINE = 0.95
TABLES, PROJECTIONS, WIDTH = 24, 10, 1.5
_ROWS = 100_000  # of a shard of bucket keys, on average


def _keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """(vectors x tables) bucket keys."""
    rng = np.random.default_rng([seed, x.shape[1]])
    direction = rng.standard_normal((x.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cell = np.floor((x @ direction + shift) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    key = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 16)), (len(x), tables)).copy()
    for k in range(projections):
        with np.errstate(over="ignore"):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k])
    return key


def _pairs(x: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the rows with at least this cosine, in blocks."""
    for s in range(0, len(x), 2048):
        for e in range(s, len(x), 2048):
            i, j = np.nonzero(x[s : s + 2048] @ x[e : e + 2048].T >= cosine)
            i, j = i + s, j + e
            yield i[i < j], j[i < j]


def copies(df: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 10) -> DataFrame:
    """(vec_id, group_id, n_vectors), one row for each vector; one without copies is a group of its own."""
    every = cut(normalised(df))
    nodes = cut(every.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"))
    named = every.join(nodes.select("node", F.col("v").alias("same")), F.col("v") == F.col("same")).select("id", "node")
    shards = max(1, -(-every.count() * tables // _ROWS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column("v").to_pylist()])
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                key = _keys(matrix(part.column("v")).astype(np.float64), tables, projections, width, seed).ravel()
                row = pa.array(np.repeat(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(shards)).astype(np.int32)), pa.array(key.view(np.int64)), part.column("node").take(row), part.column("v").take(row)], names=["shard", "key", "node", "v"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        key = np.asarray(whole.column("key"))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)
        end = np.append(start[1:], len(key))
        node, raw = np.asarray(whole.column("node")), whole.column("v").to_pylist()
        a, b = [], []
        for s, e in zip(start[end - start > 1], end[end - start > 1]):
            own = order[s:e]
            x = np.frombuffer(b"".join(raw[i] for i in own), dtype=np.float32).reshape(len(own), -1).astype(np.float64)
            for i, j in _pairs(x, cosine):
                if len(i):
                    u, v = forest(node[own[i]], node[own[j]])
                    a.append(u), b.append(v)
        none = np.zeros(0, dtype=np.int64)
        a, b = forest(np.concatenate(a or [none]), np.concatenate(b or [none]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    edges = nodes.mapInArrow(spread, "shard int, key long, node long, v binary").groupBy("shard").applyInArrow(find, "a long, b long").distinct()
    root = components(edges)
    of = named.select("id", "node").join(root.select(F.col("id").alias("r"), "root"), F.col("node") == F.col("r"), "left")
    of = of.select(F.col("id").alias("vec_id"), F.coalesce("root", "node").alias("group_id"))
    size = of.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n_vectors"))
    return of.join(size, F.col("group_id") == F.col("g")).drop("g")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y
    ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {COSINE}),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT vec_id, least(vec_id, coalesce(min(b), vec_id)) AS group_id, greatest(1, count(DISTINCT b)) AS n_vectors
FROM embeddings LEFT JOIN reach ON a = vec_id WHERE embedding IS NOT NULL GROUP BY vec_id
"""
