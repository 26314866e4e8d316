"""Token-id shards: independent zstandard frames, a seek table, a checksum for each frame.

A shard is a file in the public seekable zstandard layout: frames one after the
other, then a skippable frame with the seek table (for each frame its compressed
size, its size and the low 32 bits of its XXH64) and a footer.  Each document is
one frame of little-endian uint16 ids (uint32 where the vocabulary needs it); the
last frame is the index: for each document doc_id and number of ids, as int64.
A reader fetches the footer, the seek table, the index and then only the frames
of the documents that it wants.

Null texts have the length -1 in the index and an empty frame, empty texts the
length 0.  A null doc_id is stored as the lowest int64.  Repeated doc_ids are
stored as often as they come, and read as often.  An empty table makes no shards.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .base import id_and_text, list_array, prepare, raw_texts, runs, table
from .pieces import MODEL, encoder, read_model

NO_ID = -(2**63)
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
SHARD_BYTES = 8_000_000


class ShardWriter:
    """Collects documents' ids; ``finish`` gives the file's bytes."""

    def __init__(self, wide: bool, level: int = 3) -> None:
        self._pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._kind = np.dtype("<u4" if wide else "<u2")
        self._frames: list[bytes] = []
        self._table: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def _frame(self, data: bytes) -> None:
        frame = self._pack.compress(data)
        self._frames.append(frame)
        self._table.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.size += len(frame) + 12

    def add(self, doc_id: int | None, ids: np.ndarray | None) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(-1 if ids is None else len(ids))
        self._frame(b"" if ids is None else ids.astype(self._kind).tobytes())

    def finish(self) -> bytes:
        index = np.array([[NO_ID if d is None else d for d in self.doc_ids], self.lengths], dtype="<i8")
        self._frame(index.tobytes())
        entries = b"".join(self._table)
        footer = struct.pack("<IBI", len(self._table), 0x80, _FOOTER)
        return b"".join([*self._frames, struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)), entries, footer])


class ShardReader:
    """Reads single documents of a shard through ``fetch(start, size)``, a ranged read.

    ``fetched`` counts the compressed bytes that were read.
    """

    def __init__(self, size: int, fetch) -> None:
        self._fetch, self.fetched = fetch, 0
        frames, flags, magic = struct.unpack("<IBI", self._get(size - 9, 9))
        if magic != _FOOTER or not flags & 0x80:
            raise ValueError("not a seekable shard with checksums")
        table = np.frombuffer(self._get(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self._packed, self._plain, self._sum = table.T
        self._start = np.cumsum(self._packed) - self._packed
        self.doc_ids, self.lengths = np.frombuffer(self.frame(frames - 1), dtype="<i8").reshape(2, -1)
        total = self.lengths[self.lengths > 0].sum()
        self._kind = "<u4" if total and self._plain[:-1].sum() == 4 * total else "<u2"

    @classmethod
    def of_bytes(cls, data: bytes) -> ShardReader:
        return cls(len(data), lambda start, size: data[start : start + size])

    @classmethod
    def of_file(cls, path: str) -> ShardReader:
        def fetch(start: int, size: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(start)
                return f.read(size)

        return cls(os.path.getsize(path), fetch)

    def _get(self, start: int, size: int) -> bytes:
        self.fetched += int(size)
        return self._fetch(int(start), int(size))

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._get(self._start[k], self._packed[k]), max_output_size=max(1, int(self._plain[k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self._sum[k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def read(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray | None]]:
        """(doc_id, ids or None for a null text) of each stored document that is asked for."""
        wanted = np.array([NO_ID if d is None else d for d in doc_ids], dtype=np.int64)
        for k in np.flatnonzero(np.isin(self.doc_ids, wanted)):
            ids = None if self.lengths[k] < 0 else np.frombuffer(self.frame(k), dtype=self._kind)
            yield (None if self.doc_ids[k] == NO_ID else int(self.doc_ids[k])), ids


def shards(docs: DataFrame, model_path: str = MODEL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, part, doc_ids, n_docs, n_tokens, bytes): each input partition's documents as shards.

    No shuffle; a shard is closed once it has ``shard_bytes``, so one document
    larger than that makes a larger shard.  ``shard`` is the input partition's
    number and ``part`` counts within it, so a task that runs again makes the same.
    """
    prepare(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        wide = own.vocabulary.size > 1 << 16
        shard, part = TaskContext.get().partitionId(), 0
        writer = ShardWriter(wide)

        def closed() -> pa.RecordBatch:
            tokens = sum(n for n in writer.lengths if n > 0)
            n = len(writer.doc_ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([part], pa.int32()),
                    list_array(pa.array(writer.doc_ids, pa.int64()), [0, n]),
                    pa.array([n], pa.int64()),
                    pa.array([tokens], pa.int64()),
                    pa.array([writer.finish()], pa.binary()),
                ],
                names=["shard", "part", "doc_ids", "n_docs", "n_tokens", "bytes"],
            )

        for batch in batches:
            raw = raw_texts(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in runs(raw):
                ids, size = own.encode(texts)
                at = 0
                for i, n in enumerate(size.tolist()):
                    writer.add(doc_ids[first + i], None if raw[first + i] is None else ids[at : at + n])
                    at += n
                    if writer.size >= shard_bytes:
                        yield closed()
                        part, writer = part + 1, ShardWriter(wide)
        if writer.doc_ids:
            yield closed()

    schema = "shard int, part int, doc_ids array<long>, n_docs long, n_tokens long, bytes binary"
    return id_and_text(docs).mapInArrow(run, schema)


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Write each shard to its file in a folder that all executors share; (path, doc_ids, n_tokens) of the files.

    A file is written under another name and then renamed, so a task that is lost
    or runs twice leaves whole files only.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for row in batch.select(["shard", "part", "bytes"]).to_pylist():
                path = f"{folder}/shard-{row['shard']:06d}-{row['part']:04d}.zst"
                own = f"{path}.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(row["bytes"])
                os.replace(own, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column("doc_ids"), batch.column("n_tokens")], names=["path", "doc_ids", "n_tokens"])

    return made.mapInArrow(run, "path string, doc_ids array<long>, n_tokens long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
