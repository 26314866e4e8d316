"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's texts are cut wherever no piece has the two bytes side by side, such
as before a space.  The distinct units are concatenated and their suffixes
sorted by their first 16 bytes.  Every piece of the vocabulary
is binary-searched in that suffix array, which gives the range of its
occurrences.  The occurrences are the edges of a lattice; sorted by position
they are relaxed from left to right.

A BPE model's segmentation isn't the one with the best sum of scores, so the
relaxation doesn't compare sums.  A segmentation is the one that the merges
produce if and only if each pair of neighbouring pieces is stable (merging
their concatenation gives the pair again), and every prefix of a unit has
exactly one such segmentation.  An edge is thus relaxed if it and the last
piece of the prefix before it are a stable pair.

Results are the library's own ``encode``: a dummy space comes first, characters
outside the vocabulary become their bytes' pieces.  Null gives null, an empty
text no ids.  Units already seen by a worker are taken from its cache.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import id_and_text, list_array, prepare, raw_texts, runs, table
from .words import hash_ranges, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁".encode()
_U = np.uint64


class Vocabulary:
    """A BPE model's pieces, merge order and search keys as arrays."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = sp.get_piece_size()
        self.byte_id = np.full(256, sp.unk_id(), dtype=np.int32)
        names: dict[int, str] = {}
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                names[i] = name
                self.text[i] = name.replace("▁", " ").encode()
        ids = {name: i for i, name in names.items()}
        # 0 for single characters, else the place in the order of merges
        self.rank = np.zeros(n + 1, dtype=np.int64)
        merged = sorted((i for i, name in names.items() if len(name) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank[merged] = np.arange(1, len(merged) + 1)
        pairs: dict[tuple[int, int], int] = {}
        for i in merged:
            name = names[i]
            for k in range(1, len(name)):
                left, right = ids.get(name[:k]), ids.get(name[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.left = np.full(n + 1, -1, dtype=np.int64)
        self.right = np.full(n + 1, -1, dtype=np.int64)
        whole = [i for i, name in names.items() if len(name) == 1]
        for i in merged:
            parts = [ids.get(c, -1) for c in names[i]]
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    p = pairs.get((parts[k], parts[k + 1]))
                    if p is not None and (best is None or self.rank[p] < best):
                        best, at = self.rank[p], k
                if best is None:
                    break
                parts[at : at + 2] = [pairs[parts[at], parts[at + 1]]]
            if len(parts) == 2 and pairs.get((parts[0], parts[1])) == i:
                self.left[i], self.right[i] = parts
                whole.append(i)
        keys = np.array([a * (n + 1) + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank = self.rank[np.array(list(pairs.values()), dtype=np.int64)[order]]
        # pieces that merging can produce, with the bounds of the 16-byte keys that they begin
        self.piece = np.array(sorted(whole), dtype=np.int64)
        raw = [names[i].encode() for i in self.piece]
        self.piece_bytes = raw
        self.bytes_of = np.zeros(n + 1, dtype=np.int64)
        self.bytes_of[self.piece] = [len(x) for x in raw]
        low = np.frombuffer(b"".join(x[:16].ljust(16, b"\0") for x in raw), dtype=">u8").reshape(-1, 2)
        high = np.frombuffer(b"".join(x[:16].ljust(16, b"\xff") for x in raw), dtype=">u8").reshape(-1, 2)
        self.low, self.high = low.astype(np.uint64), high.astype(np.uint64)
        self.long = [k for k, x in enumerate(raw) if len(x) > 16]
        self.single = {x: i for x, i in zip(raw, self.piece) if self.rank[i] == 0}
        # whether some piece has these two bytes side by side; elsewhere a text may be cut
        self.joins = np.zeros((256, 256), dtype=bool)
        for x in raw:
            for y in (x, x.replace(_SPACE, b" ")):
                y = np.frombuffer(y, dtype=np.uint8)
                self.joins[y[:-1], y[1:]] = True
        self.joins[0x20, 0xE2] = self.joins[0x81, 0x20] = True  # a space beside U+2581
        self.joins[:, 0x80:0xC0] = True  # never within a character
        sizes = np.array([len(x) for x in self.text], dtype=np.int64)
        self.text_size, self.text_start = sizes, np.cumsum(sizes) - sizes
        self.text_data = np.frombuffer(b"".join(self.text), dtype=np.uint8)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the concatenation of pieces a and b gives a and b; ``size`` (a foreign character) always is."""
        ok = np.ones(len(a), dtype=bool)
        at = np.flatnonzero((a < self.size) & (b < self.size))
        a, b = a[at].astype(np.int64), b[at].astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a * (self.size + 1) + b
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            broken = (self.pair_key[k] == key) & (self.pair_rank[k] < limit)
            ok[at[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb  # a was merged last: undo it; else undo b, unless both are single characters
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            go = ~broken & (first | (rb > 0))
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def _bound(self, hi: np.ndarray, lo: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
        """For each key the first place in the sorted (hi, lo) that isn't below it (or that is above it)."""
        left, right = np.zeros(len(key), dtype=np.int64), np.full(len(key), len(hi), dtype=np.int64)
        while True:
            open_ = left < right
            if not open_.any():
                return left
            mid = np.minimum((left + right) // 2, len(hi) - 1)
            h, l = hi[mid], lo[mid]
            less = (h < key[:, 0]) | ((h == key[:, 0]) & ((l <= key[:, 1]) if after else (l < key[:, 1])))
            left, right = np.where(open_ & less, mid + 1, left), np.where(open_ & ~less, mid, right)

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, their number in each unit).  Units are not empty; spaces count as the space piece."""
        units = [u.replace(b" ", _SPACE) for u in units]
        data = np.frombuffer(b"\0".join(units) + b"\0" * 17, dtype=np.uint8)
        sizes = np.fromiter((len(u) for u in units), dtype=np.int64, count=len(units))
        start = np.cumsum(sizes + 1) - sizes - 1
        unit_of, offset = spread(sizes)
        place = start[unit_of] + offset
        heads = (data[place] & 0xC0) != 0x80
        place, offset = place[heads], offset[heads]
        hi, lo = np.zeros(len(place), dtype=np.uint64), np.zeros(len(place), dtype=np.uint64)
        for k in range(8):
            hi = (hi << _U(8)) | data[place + k]
            lo = (lo << _U(8)) | data[place + 8 + k]
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        begin, end = self._bound(hi, lo, self.low, False), self._bound(hi, lo, self.high, True)
        count = np.maximum(end - begin, 0)
        row, k = spread(count)
        where = order[begin[row] + k]
        if self.long:
            good = np.ones(len(where), dtype=bool)
            edge_at = np.cumsum(count) - count
            for r in self.long:
                for e in range(edge_at[r], edge_at[r] + count[r]):
                    x, p = self.piece_bytes[r], place[where[e]]
                    good[e] = data[p : p + len(x)].tobytes() == x
            row, where = row[good], where[good]
        known = np.zeros(len(place), dtype=bool)
        known[where[self.rank[self.piece[row]] == 0]] = True
        foreign = np.flatnonzero(~known)
        lead = data[place[foreign]]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        edge_from = np.concatenate((place[where], place[foreign]))
        edge_piece = np.concatenate((self.piece[row], np.full(len(foreign), self.size, dtype=np.int64)))
        edge_to = edge_from + np.concatenate((self.bytes_of[self.piece[row]], width))
        depth = np.concatenate((offset[where], offset[foreign]))
        by = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        edge_from, edge_piece, edge_to, depth = edge_from[by], edge_piece[by], edge_to[by], depth[by]
        last = np.full(len(data) + 1, -1, dtype=np.int64)  # last piece of the prefix that ends here
        span = np.zeros(len(data) + 1, dtype=np.int64)
        last[start] = self.size  # anything may follow the start
        # the end of one unit is never the start of the next: a zero byte lies between them
        steps = np.concatenate(([0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]))
        for s, e in zip(steps[:-1], steps[1:]):
            f, p, t = edge_from[s:e], edge_piece[s:e], edge_to[s:e]
            live = last[f] >= 0
            f, p, t = f[live], p[live], t[live]
            good = self.stable(last[f], p)
            t, f, p = t[good], f[good], p[good]
            last[t], span[t] = p, t - f
        at, of = start + sizes, np.arange(len(units))
        found_at, found_id, found_of = [], [], []
        while len(at):
            token = last[at]
            if (token < 0).any():
                raise ValueError("no segmentation: not a BPE model")
            found_at.append(at), found_id.append(token), found_of.append(of)
            at = at - span[at]
            more = at > start[of]
            at, of = at[more], of[more]
        at, ids, of = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_at, found_id, found_of))
        by = np.argsort(at)
        at, ids, of = at[by], ids[by], of[by]
        width = np.where(ids == self.size, span[at], 1)
        if len(ids) and width.max() > 0 and (ids == self.size).any():
            r, k = spread(width)
            raw = self.byte_id[data[at[r] - width[r] + k]]
            ids, of = np.where(ids[r] == self.size, raw, ids[r]), of[r]
        return ids.astype(np.int32), np.bincount(of, minlength=len(units))

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The texts of runs of ids; the space that encoding put first is taken off."""
        width = self.text_size[ids]
        row, k = spread(width)
        data = self.text_data[self.text_start[ids][row] + k].tobytes()
        total = np.concatenate(([0], np.cumsum(width)))
        ends = np.concatenate(([0], np.cumsum(size)))
        cuts = total[ends]
        texts = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        return [x[1:] if x[:1] == b" " else x for x in texts]


@functools.lru_cache(maxsize=2)
def _encoder(digest: bytes, model: bytes) -> Encoder:
    return Encoder(Vocabulary(model))


def encoder(model: bytes) -> Encoder:
    """This process's encoder for a model file's bytes."""
    return _encoder(hashlib.md5(model).digest(), model)


class Encoder:
    """Encodes texts, keeping the ids of units that it has met, ``keep`` units at most."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 1_000_000) -> None:
        self.vocabulary, self.keep = vocabulary, keep
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat: np.ndarray = np.zeros(0, dtype=np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each text)."""
        data = b" ".join([b"", *texts])[: None if texts else 0]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(sizes) - sizes
        a = np.frombuffer(data, dtype=np.uint8)
        if not len(a):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        edge = np.ones(len(a), dtype=bool)
        edge[1:] = ~self.vocabulary.joins[a[:-1], a[1:]]
        edge[first] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(a))
        of, one, which = np.unique(hash_ranges(a, start, end), return_index=True, return_inverse=True)
        if len(self.key) > self.keep:
            self._clear()
        at = np.searchsorted(self.key, of)
        new = np.ones(len(of), dtype=bool)
        if len(self.key):
            new = self.key[np.minimum(at, len(self.key) - 1)] != of
        if new.any():
            units = [data[start[i] : end[i]] for i in one[new]]
            ids, size = self.vocabulary.encode(units)
            self.key = np.insert(self.key, at[new], of[new])
            self.start = np.insert(self.start, at[new], len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, at[new], size)
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.key, of)
        size = self.size[at][which]
        row, k = spread(size)
        ids = self.flat[self.start[at][which][row] + k]
        text_of = np.searchsorted(first, start, side="right") - 1
        count = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        empty = np.flatnonzero(sizes == 1)  # only the dummy space
        if len(empty):
            keep = np.ones(len(ids), dtype=bool)
            ends = np.cumsum(count)
            for i in empty:
                keep[ends[i] - count[i] : ends[i]] = False
            ids = ids[keep]
            count[empty] = 0
        return ids, count


def read_model(path: str = MODEL) -> bytes:
    return Path(path).read_bytes()


def encode(docs: DataFrame, model_path: str = MODEL, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): every document's piece ids, in the input's partitions, without a shuffle.

    ``round_trip``: whether decoding the ids gives the text again.  It does for
    each text without the character U+2581, which the pieces use for a space.
    A null text gives null ids, n_ids and round_trip, an empty one no ids, 0 and
    true.  Null and repeated doc_ids are carried as they are.
    """
    prepare(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            raw = raw_texts(batch.column("text"))
            for first, texts in runs(raw):
                null = np.array([raw[first + i] is None for i in range(len(texts))])
                ids, size = own.encode(texts)
                same = own.vocabulary.decode(ids, size) if check else texts
                offsets = np.concatenate(([0], np.cumsum(size)))
                lists = list_array(pa.array(ids), offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(lists.to_pylist(), lists.type, mask=null) if null.any() else lists,
                        pa.array(size.astype(np.int32), mask=null),
                        pa.array([a == b for a, b in zip(same, texts)], pa.bool_(), mask=null),
                    ],
                    names=["doc_id", "ids", "n_ids", "round_trip"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null, ids outside the vocabulary raise."""
    prepare(encoded.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model).vocabulary
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= vocabulary.size):
                raise ValueError("an id outside the vocabulary")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = [x.decode("utf-8", "replace") for x in vocabulary.decode(flat.astype(np.int64), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], names=["doc_id", "text"])

    from pyspark.sql import functions as F

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
