"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts texts where their content says so: a passage that documents share gives the
same chunks wherever it stands. A chunk's whole words (from its first blank to its last) are encoded once and kept; then
each join, from the last blank before a cut to the first one after it, is repaired: it is encoded anew together with words on
either side, more and more of them, until the ids at both ends agree exactly with those of the chunks beside it. If all words
of both chunks are used up without agreement, the whole text is encoded. A chunk without a blank is all join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeseam.llm.common import batched, sliced
from lodeseam.llm.encoders import ChunkCache, WordEncoder

WINDOW = 16
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLANK = b" \t\n\x0b\x0c\r"
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def cuts(data: np.ndarray, mean: int = 1024, step: int = 1 << 22) -> np.ndarray:
    """Places after which the hash of WINDOW bytes has its high bits zero; about one in `mean` bytes (a power of two)."""
    high, out = np.uint32(32 - (mean.bit_length() - 1)), []
    for s in range(0, len(data), step):
        first = max(0, s - WINDOW + 1)
        h = _GEAR[data[first : s + step]]
        for k in (1, 2, 4, 8):
            grown = h.copy()
            grown[k:] += h[:-k] << np.uint32(k)
            h = grown
        at = np.flatnonzero(h >> high == 0) + first + 1
        out.append(at[at > s])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _first_blank(x: bytes) -> int:
    return min((k for b in _BLANK if (k := x.find(b)) >= 0), default=-1)


def _last_blank(x: bytes) -> int:
    return max(x.rfind(b) for b in _BLANK)


def _words(part: bytes, n: int, last: bool) -> bytes:
    """The first or last n words of a part with the blanks between them; all of it if it has no more."""
    size = 64 * n
    while True:
        piece = part[-size:] if last else part[:size]
        whole = len(piece) == len(part)
        words = piece.split()
        if whole and len(words) <= n:
            return part
        if len(words) > n:  # the outermost one may be cut
            at = [m.start() for m in _WORD.finditer(piece)] if last else [m.end() for m in _WORD.finditer(piece)]
            return piece[at[-n] :] if last else piece[: at[n - 1]]
        size *= 4


class ChunkedCoder:
    """One in a task; its cache of chunks is bounded in bytes. `widened` counts joins that needed more than a word on each side,
    `whole` texts that had to be encoded as they are."""

    def __init__(self, encoder: WordEncoder, cache_bytes: int = 48 << 20) -> None:
        self.encoder, self.cache, self.hits, self.misses, self.widened, self.whole = encoder, ChunkCache(cache_bytes), 0, 0, 0, 0
        self._known: dict[bytes, bytes] = {}  # ids of the few words beside joins
        self.table, self.between = encoder.decode_table()

    def _ids(self, part: bytes) -> bytes:
        return self.encoder.encode(part.decode("utf-8")).astype("<u4").tobytes()

    def _text(self, ids: bytes) -> bytes:
        return self.between.join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _beside(self, part: bytes) -> bytes:
        if (ids := self._known.get(part)) is None:
            if len(self._known) >= 50_000:
                self._known.clear()
            ids = self._known[part] = self._ids(part)
        return ids

    def _core(self, part: bytes) -> tuple[bytes, bytes]:
        if (x := self.cache.get(part)) is not None:
            self.hits += 1
            return x[0], x[1]
        self.misses += 1
        ids = self._ids(part)
        text = self._text(ids)
        self.cache.put(part, (ids, text, size := len(ids) + len(text) + len(part) + 300), size)
        return ids, text

    def _join(self, left: tuple[bytes, bytes], middle: bytes, right: tuple[bytes, bytes]) -> bytes | None:
        """Ids of the join between two parts (text, ids), once those beside it agree; None if they never do."""
        n = 1
        while True:
            a, b = _words(left[0], n, True), _words(right[0], n, False)
            before, after, whole = self._beside(a), self._beside(b), self._ids(a + middle + b)
            if len(whole) >= len(before) + len(after) and whole.startswith(before) and whole.endswith(after) and left[1].endswith(before) and right[1].startswith(after):
                return whole[len(before) : len(whole) - len(after)]
            if len(a) == len(left[0]) and len(b) == len(right[0]):
                return None
            self.widened += 1
            n *= 2

    def code(self, data: bytes, at: list[int]) -> tuple[bytes, bytes]:
        """Ids (u32, little-endian) and decoded UTF-8 of a text that is cut at those places."""
        # the text as join, core, join, core, ..., join
        joins, cores, join, start = [], [], [], 0
        for end in [*at, len(data)]:
            chunk = data[start:end]
            start = end
            if (i := _first_blank(chunk)) < 0:
                join.append(chunk)
                continue
            j = _last_blank(chunk)
            joins.append(b"".join([*join, chunk[:i]]))
            cores.append(chunk[i:j])
            join = [chunk[j:]]
        joins.append(b"".join(join))
        coded = [(b"", b"", b""), *((x, *self._core(x)) if x and not x.isspace() else (x, b"", b"") for x in cores), (b"", b"", b"")]
        ids, text = [], []
        for k, middle in enumerate(joins):
            (left, a, _), (right, b, told) = coded[k], coded[k + 1]
            if middle and not middle.isspace():
                if (own := self._join((left, a), middle, (right, b))) is None:
                    self.whole += 1
                    whole = self._ids(data)
                    return whole, self._text(whole)
                ids.append(own)
                text.append(self._text(own))
            ids.append(b)
            text.append(told)
        return b"".join(ids), self.between.join(x for i, x in zip(ids, text, strict=True) if i)


def encode_chunked(docs: DataFrame, encoder: WordEncoder, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 48 << 20) -> DataFrame:
    """A row for each row of docs: the id, n_tokens, ids (u32 little-endian) and decoded (text of those ids).

    Null text is empty: no tokens, empty text. Rows are independent, so ids may be null or repeat, and other columns of
    docs do not matter. Nothing is shuffled; chunks are shared by the documents of a task, and a lost
    worker only loses its cache. A very long text is coded chunk by chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkedCoder(encoder, cache_bytes)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            out, size, first = [], 0, 0
            for k, text in enumerate(texts):
                data = (text or "").encode("utf-8", "replace")
                at = cuts(np.frombuffer(data, np.uint8))
                out.append(coder.code(data, at[(at >= WINDOW) & (at < len(data))].tolist()))
                size += len(out[-1][0]) + len(out[-1][1])
                if size > 8 << 20 or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(out)), pa.array([len(a) // 4 for a, _ in out], pa.int64()), pa.array([a for a, _ in out], pa.binary()), pa.array([b.decode("utf-8", "replace") for _, b in out], pa.string())],
                        names=[id_col, "n_tokens", "ids", "decoded"],
                    )
                    out, size, first = [], 0, k + 1

    kind = docs.schema[id_col].dataType
    return batched(docs.select(id_col, text_col)).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
