"""Quality from overlapping heuristics: their accuracies by EM, then a hashed linear scorer.

Each heuristic votes good, bad or abstains on every document.  How often every
pattern of votes comes is counted over all documents (3**9 patterns at most).
Expectation-maximisation of a two-class model with independent votes gives each
heuristic's rates and, for each pattern, the posterior of being good.

A logistic scorer over hashed features (words, token shapes, repeats) is then
trained on the posteriors of at most ``TRAIN`` documents (those with the lowest
hash of doc_id) and scores every document.

Null and empty texts, and texts without any token, have no features and get the
score 0: they are rejected.  Every heuristic may vote on a text of any length;
very long texts are read whole.  Repeated rows score alike; rows with a null
doc_id are scored but not trained on, and of rows that repeat a doc_id the
greatest text is.  Ties of the hash go by doc_id.  On an empty table the result
is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import id_and_text, prepare, raw_texts, runs, table
from .toxicity import sample
from .words import Words, hash_ranges, mix

TRAIN = 8192
BITS = 16
STRETCH = 200
THRESHOLD = 0.5
HEURISTICS = ("capitals", "symbols", "repeats", "bars", "lines", "sentences", "top_word", "variety", "tails")

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|!<>{}[]=_~^@\\+/")] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LETTER] = ord("l")
_SHAPE[_UPPER] = ord("U")
_SHAPE[48:58] = ord("d")


class Tokens:
    """The blank-separated tokens of texts, with their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.inside = ~_BLANK[self.data]
        edge = np.flatnonzero(np.diff(self.inside, prepend=False))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hashes: np.ndarray | None = None

    def packed(self, keep: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Hashes of the tokens' kept bytes; each token keeps its first."""
        end = np.cumsum(keep)[self.end - 1]
        return hash_ranges(data[keep], np.concatenate(([0], end[:-1])), end)

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.packed(self.inside, self.data) if len(self.start) else np.zeros(0, dtype=np.uint64)
        return self._hashes

    def shapes(self) -> np.ndarray:
        """Hashes of the tokens' shapes: runs of one kind of character count once."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        shape = _SHAPE[self.data]
        keep = self.inside.copy()
        keep[1:] &= shape[1:] != shape[:-1]
        keep[self.start] = True
        return self.packed(keep, shape)

    def share(self, kind: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """The share of each text's bytes of one kind among those of another (by default the non-blank)."""
        return self.count(kind) / np.maximum(1, self.count(of) if of is not None else np.add.reduceat(self.inside, self.base[:-1], dtype=np.int64))

    def count(self, kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[self.data], self.base[:-1], dtype=np.int64)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 2, 1)) + 0 * value.astype(np.int64)


def votes(texts: list[bytes], tokens: Tokens | None = None) -> np.ndarray:
    """(texts x heuristics): 0 bad, 1 abstains, 2 good."""
    t = tokens or Tokens(texts)
    m = len(texts)
    n = np.diff(t.first)
    h = t.hashes()
    some = n >= 8
    out = []
    caps = t.share(_UPPER, _LETTER)
    out.append(_vote(caps, some & (caps < 0.12), some & (caps > 0.4)))
    symbols = t.share(_SYMBOL)
    out.append(_vote(symbols, some & (symbols < 0.02), symbols > 0.06))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (t.text[1:] == t.text[:-1])
    again = np.bincount(t.text, weights=same, minlength=m) / np.maximum(1, n)
    out.append(_vote(again, some & (again < 0.03), some & (again > 0.15)))
    bar = np.zeros(256, dtype=bool)
    bar[ord("|")] = True
    bars = t.count(bar) / np.maximum(1, n)
    out.append(_vote(bars, np.zeros(m, dtype=bool), some & (bars > 0.15)))
    # lines: joined hashes of a line's tokens
    line = np.cumsum(t.data == 10)[t.start] if len(h) else np.zeros(0, dtype=np.int64)
    head = np.flatnonzero(np.diff(line, prepend=-1))
    with np.errstate(over="ignore"):
        key = np.add.reduceat(mix(h + (np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))).astype(np.uint64)), head) if len(h) else h
    of = t.text[head] if len(h) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((key, of))
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    lines, distinct = np.bincount(of, minlength=m), np.bincount(of[order][first], minlength=m)
    twice = 1 - distinct / np.maximum(1, lines)
    out.append(_vote(twice, (lines >= 4) & (twice < 0.1), (lines >= 4) & (twice > 0.4)))
    stop = np.zeros(256, dtype=bool)
    stop[[ord("."), ord("?")]] = True
    long = n / np.maximum(1, t.count(stop))
    out.append(_vote(long, some & (long > 2) & (long < 40), (n >= 50) & (long > 60)))
    order = np.lexsort((h, t.text))
    th, tt = h[order], t.text[order]
    start = np.flatnonzero(np.concatenate(([True], (th[1:] != th[:-1]) | (tt[1:] != tt[:-1])))) if len(h) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(h)))
    most = np.zeros(m, dtype=np.int64)
    np.maximum.at(most, tt[start], size)
    top = most / np.maximum(1, n)
    out.append(_vote(top, (n >= 30) & (top < 0.12), (n >= 15) & (top > 0.25)))
    # distinct tokens of each stretch, so that a long text has no fewer than a short one
    stretch = np.cumsum((np.arange(len(h)) - t.first[t.text]) % STRETCH == 0)
    order = np.lexsort((h, stretch))
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[order][1:] != h[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
    kinds = np.bincount(t.text[order][once], minlength=m) / np.maximum(1, n)
    out.append(_vote(kinds, some & (kinds > 0.5), (n >= 15) & (kinds < 0.2)))
    last = t.end - 1
    odd = (t.end - t.start >= 3) & ~_LETTER[t.data[last]] & (t.data[last] == t.data[last - 1]) & (_SYMBOL | (np.arange(256) == ord("!")))[t.data[last]]
    tails = np.bincount(t.text, weights=odd, minlength=m) / np.maximum(1, n)
    out.append(_vote(tails, some & (tails < 0.02), some & (tails > 0.2)))
    return np.stack(out, axis=1)


def em(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, rates[class, heuristic, vote], posterior of each pattern).

    Starts with the patterns that hold a bad vote as most likely bad and those with good votes alone as most likely good.
    """
    m = pattern.shape[1]
    q = np.where((pattern == 0).any(axis=1), 0.01, np.where((pattern == 2).any(axis=1), 0.99, 0.8))
    count = count.astype(np.float64)
    for _ in range(rounds):
        weight = np.stack(((1 - q) * count, q * count))
        share = (weight[1].sum() + 1) / (count.sum() + 2)
        rates = np.stack([[[w[pattern[:, j] == v].sum() for v in range(3)] for j in range(m)] for w in weight]) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        side = np.log([1 - share, share])[:, None] + np.stack([sum(np.log(rates[c, j, pattern[:, j]]) for j in range(m)) for c in range(2)])
        new = 1 / (1 + np.exp(np.clip(side[0] - side[1], -500, 500)))
        if len(new) == 0 or np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return share, rates, q


def features(texts: list[bytes], bits: int = BITS, tokens: Tokens | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text; a text's values have the norm 1 (none for a text without tokens)."""
    t = tokens or Tokens(texts)
    h = t.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (t.text[1:] == t.text[:-1])
    slot = np.uint64((1 << bits) - 1)
    key = np.concatenate((h & slot, mix(t.shapes() ^ np.uint64(0x5A5A)) & slot, np.where(same, np.uint64(1), np.uint64(2)))).astype(np.int64)
    text = np.concatenate((t.text, t.text, t.text))
    at, count = np.unique(text * (1 << bits) + key, return_counts=True)
    text, key = at >> bits, at & ((1 << bits) - 1)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts)))
    return text, key, value / norm[text]


@dataclass
class Model:
    share: float
    rates: np.ndarray  # [class, heuristic, vote]
    posterior: dict[int, float]  # by pattern
    weight: np.ndarray
    bias: float
    bits: int

    def score(self, texts: list[bytes], tokens: Tokens | None = None) -> np.ndarray:
        text, key, value = features(texts, self.bits, tokens)
        z = np.bincount(text, weights=self.weight[key] * value, minlength=len(texts)) + self.bias
        has = np.bincount(text, minlength=len(texts)) > 0
        return np.where(has, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)

    def accuracies(self) -> dict[str, float]:
        """How often each heuristic is right when it votes, as EM estimates it."""
        p = np.array([1 - self.share, self.share])[:, None, None] * self.rates
        return {name: float((p[0, j, 0] + p[1, j, 2]) / (p[:, j, 0].sum() + p[:, j, 2].sum())) for j, name in enumerate(HEURISTICS)}


def train(row: np.ndarray, key: np.ndarray, value: np.ndarray, goal: np.ndarray, bits: int, rounds: int = 150, rate: float = 0.5, shrink: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad over the whole sample."""
    weight, bias, n = np.zeros(1 << bits), 0.0, len(goal)
    seen, seen_b = np.full(1 << bits, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, weights=weight[key] * value, minlength=n) + bias
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - goal) / n
        g = np.bincount(key, weights=slope[row] * value, minlength=1 << bits) + shrink * weight
        seen += g * g
        seen_b += slope.sum() ** 2
        weight -= rate * g / np.sqrt(seen)
        bias -= rate * slope.sum() / np.sqrt(seen_b)
    return weight, bias


def fit(docs: DataFrame, train_rows: int = TRAIN, bits: int = BITS) -> Model:
    """``train_rows``: how many documents the linear scorer is trained on at most."""
    prepare(docs.sparkSession)
    base = 3 ** np.arange(len(HEURISTICS))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(HEURISTICS), dtype=np.int64)
        for batch in batches:
            for _, texts in runs(raw_texts(batch.column("text"))):
                total += np.bincount(votes(texts) @ base, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["pattern", "n"])

    rows = id_and_text(docs).where("length(trim(text)) > 0").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    code = np.array([r[0] for r in rows], dtype=np.int64)
    share, rates, q = em(code[:, None] // base % 3, np.array([r[1] for r in rows]))
    posterior = dict(zip(code.tolist(), q.tolist()))
    ids = [r[0] for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()]

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(raw_texts(batch.column("text"))):
                tokens = Tokens(texts)
                text, key, value = features(texts, bits, tokens)
                edge = np.searchsorted(text, np.arange(len(texts) + 1))
                lists = [[x[a:b].tobytes() for a, b in zip(edge, edge[1:])] for x in (key.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(votes(texts, tokens) @ base), *(pa.array(x, pa.binary()) for x in lists)], names=["doc_id", "pattern", "keys", "values"])

    found = sample(docs, sorted(set(ids))).mapInArrow(taken, "doc_id long, pattern long, keys binary, values binary").toArrow().sort_by("doc_id")
    goal = [posterior.get(c, share) for c in found.column("pattern").to_pylist()]
    keys = [np.frombuffer(x, dtype=np.int32) for x in found.column("keys").to_pylist()]
    parts = [(np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys]), np.concatenate(keys), np.frombuffer(b"".join(found.column("values").to_pylist()), dtype=np.float32))] if keys else []
    if not parts:
        return Model(share, rates, posterior, np.zeros(1 << bits), 0.0, bits)
    weight, bias = train(*parts[0], np.array(goal), bits)
    return Model(share, rates, posterior, weight, bias, bits)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, weak_posterior, score, keep), one row for each row of the input, without a shuffle."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    base = 3 ** np.arange(len(HEURISTICS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, texts in runs(raw_texts(batch.column("text"))):
                tokens = Tokens(texts)
                s = own.score(texts, tokens)
                weak = [own.posterior.get(c, own.share) if v else 0.0 for c, v in zip((votes(texts, tokens) @ base).tolist(), s > 0)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(weak, pa.float64()), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "weak_posterior", "score", "keep"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, weak_posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model doesn't reject; no shuffle."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [s for _, texts in runs(raw_texts(batch.column("text"))) for s in (own.score(texts) >= threshold).tolist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
