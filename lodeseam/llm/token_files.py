"""Token-id files of fixed-width bit packing.

A file holds ids in blocks. Each id takes the fewest bits that hold the vocabulary; a block is BLOCK ids (the last
may be shorter) and starts at a whole byte, so any id's place is known and numpy unpacks a block, or many, at once.

Layout, little-endian: magic `LSTK`, version u32, bits u32, block length u32, ids u64, documents u64; the blocks;
then block offsets u64 (blocks + 1), document ends u64 (in ids, cumulative), and document keys (i64 and a null flag u8).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import batched, fresh, shared_dir, sliced
from lodeseam.llm.encoders import ByteEncoder

BLOCK = 8192
HEAD = struct.Struct("<4sIIIQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, lowest bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype("u1").tobytes()
    each = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, "u1", n).astype(np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    first = np.arange(n, dtype=np.int64) * bits
    at = first >> 3
    word = np.zeros(n, dtype=np.uint64)
    for k in range((bits + 7 + 7) // 8):
        word |= padded[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Of a local path or of any URI that pyarrow knows."""
    if urlsplit(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes beside the final name and renames at the end, so a task that runs twice leaves one whole file."""

    def __init__(self, uri: str, bits: int) -> None:
        self.fs, self.path = filesystem(uri)
        self.bits, self.n, self.ends, self.keys, self.rest = bits, 0, [], [], []
        self.held, self.offsets = 0, [HEAD.size]
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        # counts are known at the end only, so the file's last bytes repeat the head with them
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(HEAD.pack(b"LSTK", 1, bits, BLOCK, 0, 0))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.held += len(ids)
        self.ends.append(self.n)
        self.keys.append(key)
        self.rest.append(ids)
        if self.held >= 64 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for k in range(0, n, BLOCK):
            self.out.write(data := pack(ids[k : min(k + BLOCK, n)], self.bits))
            self.offsets.append(self.offsets[-1] + len(data))
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.ends, "<u8").tobytes())
        self.out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array([k is None for k in self.keys], "u1").tobytes())
        self.out.write(HEAD.pack(b"LSTK", 1, self.bits, BLOCK, self.n, len(self.ends)))
        self.out.close()
        self.fs.move(self.own, self.path)


class TokenFile:
    """Random access: document k, or any range of ids, reads only the blocks it needs."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, _, self.bits, self.block, self.n, self.docs = HEAD.unpack(self.file.read_at(HEAD.size, size - HEAD.size))
        if magic != b"LSTK":
            raise ValueError(f"{uri} is no token file")
        blocks = -(-self.n // self.block)
        foot = 8 * (blocks + 1) + 17 * self.docs
        data = self.file.read_at(foot, size - HEAD.size - foot)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1)
        self.ends = np.frombuffer(data, "<u8", self.docs, 8 * (blocks + 1)).astype(np.int64)
        self.keys = np.frombuffer(data, "<i8", self.docs, 8 * (blocks + 1 + self.docs))
        self.null = np.frombuffer(data, "u1", self.docs, 8 * (blocks + 1 + 2 * self.docs)).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        n, rows = min((last + 1) * self.block, self.n) - first * self.block, []
        if self.bits * self.block % 8 == 0:
            rows = [unpack(data, n, self.bits)]
        else:
            for b in range(first, last + 1):
                at = int(self.offsets[b] - self.offsets[first])
                rows.append(unpack(data[at : int(self.offsets[b + 1] - self.offsets[first])], min(self.block, self.n - b * self.block), self.bits))
        return np.concatenate(rows)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self, step: int = 4_000_000) -> Iterator[tuple[int | None, np.ndarray]]:
        """All, in order, reading about `step` ids at a time."""
        k = 0
        while k < self.docs:
            start = int(self.ends[k - 1]) if k else 0
            to = max(k + 1, int(np.searchsorted(self.ends, start + step, "right")))
            ids = self.ids(start, int(self.ends[to - 1]))
            for j in range(k, to):
                a = (int(self.ends[j - 1]) if j else 0) - start
                yield (None if self.null[j] else int(self.keys[j])), ids[a : int(self.ends[j]) - start]
            k = to


def write_token_files(docs: DataFrame, folder: str, encoder: ByteEncoder, end_id: int | None, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode docs and write their ids, in ascending order of id (nulls first, equal ids by text), as token files.

    Returns a small table, a row for each file: path, file (its rank), start (ids in all files before it), n_ids,
    n_docs. Files are made by range partitions, so each is in order and their ranks are in order. Null text is empty;
    every document gets end_id if there is one, and equal ids stay separate documents.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    key, text = fresh([], "key", "text")
    rows = docs.select(F.col(id_col).cast("long").alias(key), F.col(text_col).cast("string").alias(text))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col(key).asc_nulls_first(), F.xxhash64(text)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text), text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, writer = TaskContext.get().partitionId(), None
        path = f"{folder}/tokens-{rank:06d}.lstk"
        for batch in sliced(batches):
            writer = writer or TokenFileWriter(path, bits)
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(x or "")
                writer.add(k, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "file": [rank], "n_ids": [writer.n], "n_docs": [len(writer.ends)]})

    written = batched(ordered).mapInArrow(write, "path string, file long, n_ids long, n_docs long").collect()  # a row for each file
    start, out = 0, []
    for r in sorted(written, key=lambda r: r.file):
        out.append((r.path, r.file, start, r.n_ids, r.n_docs))
        start += r.n_ids
    return spark.createDataFrame(out, "path string, file long, start long, n_ids long, n_docs long")


def read_token_files(files: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """A row for each document of the files: its id, start, n_tokens, ids_crc32 (of the ids as u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in TokenFile(path).documents():
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 20_000:
                        yield _table(rows)
                        rows = []
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=[id_name, "start", "n_tokens", "ids_crc32"])

    dealt = files.repartition(max(1, files.count()), "file") if files.count() > 1 else files
    return dealt.mapInArrow(read, f"{id_name} long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
