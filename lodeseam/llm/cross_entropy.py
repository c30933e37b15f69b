"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of the corpus, and differ only in what they count: the target model the
documents of a target set, the background model all documents. A token's score is its loss under the target less its loss
under the background; a document's is the mean. Low scores are like the target.

The models are matched. A model interpolates: half the share of the pair among its first word's pairs, half the word's own share,
to which both models add the same share for each word of the vocabulary (half a token of the corpus), so that their sizes cancel.
Neither model knows the document it scores: what a document has put into the counts is taken off while it is scored.

Every word and every pair has a count of its own, known by 64 bits of a hash and by the part that 64 more bits choose; the counts
grow with the corpus and are nowhere held whole. Documents go in blocks: a block's distinct words and pairs, with their counts in
it, are sent to the part their hash names, summed there, and the sums go back to the block, whose documents are scored then. A
frequent pair is thus one entry a block, however often it occurs, and the number of parts follows the number of tokens. Entries
travel as sorted differences in planes of bytes, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.common import batched, fresh, sliced
from lodeseam.llm.decontaminate import words_of

#: Tokens of a block (a longer document is a block of its own), and tokens of the corpus for each part of the counts.
BLOCK_TOKENS, PART_TOKENS = 2_000_000, 2_000_000
#: A target set up to so many ids is broadcast, a larger one is joined by shuffle.
BROADCAST_IDS = 2_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CorpusCounts:
    """The corpus a score is relative to, its target documents marked, and the totals of target (0) and background (1). Words and
    pairs are counted by score(), where they meet the documents that ask for them."""

    docs: DataFrame  # as given to train()
    marked: DataFrame  # id, text, target
    n_words: int  # distinct words
    tokens: tuple[int, int]
    texts: tuple[int, int]  # texts with tokens, so pairs that begin with the start


class _Numbers(dict):
    """Numbers of words, in order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Documents in a row, up to BLOCK_TOKENS tokens."""

    def __init__(self) -> None:
        self.words, self.x, self.lengths, self.flags, self.ids = _Numbers(), [], [], [], []

    def add(self, text: str | None, flag: bool) -> None:
        found = words_of(text)
        self.x.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.lengths.append(len(found))
        self.flags.append(flag)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, and counts of words and then pairs in target and all documents."""
        x, lengths, w = np.concatenate(self.x).astype(np.int64), np.array(self.lengths), len(self.words)
        codes, chosen = _codes(x, lengths, w), np.repeat(np.array(self.flags, bool), lengths)
        pairs, n = np.unique(codes, return_counts=True)
        some, m = np.unique(codes[chosen], return_counts=True)
        t = np.zeros(len(pairs), np.int64)
        t[np.searchsorted(pairs, some)] = m
        return pairs, np.concatenate([np.bincount(x[chosen], minlength=w), t]), np.concatenate([np.bincount(x, minlength=w), n])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Block]:
    """Of batches with id, text and target."""
    block, held = _Block(), 0
    for batch in sliced(batches):
        begun = 0
        for k, (text, flag) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            block.add(text, flag)
            held += block.lengths[-1]
            if held >= most:
                block.ids.append(batch.column(0).slice(begun, k + 1 - begun))
                yield block
                block, held, begun = _Block(), 0, k + 1
        if begun < batch.num_rows:
            block.ids.append(batch.column(0).slice(begun))
    if block.lengths:
        yield block


def _codes(x: np.ndarray, lengths: np.ndarray, w: int) -> np.ndarray:
    """Numbers of pairs of w words; the word before the first is 0, the others are one more than their numbers."""
    before = np.concatenate([[0], x[:-1] + 1])[: len(x)]
    first = np.cumsum(lengths) - lengths
    before[first[lengths > 0]] = 0
    return before * w + x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _keys(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One half of the keys of words and then pairs, from that half of the hashes of the start and the words."""
    w = max(1, len(hashes) - 1)
    return np.concatenate([hashes[1:], _mixed(_mixed(hashes[pairs // w]) * _MULTIPLY + hashes[1:][pairs % w])])


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the keys (two halves) by part, then key, and (part, from, to) in it."""
    part = keys[:, 1] % np.uint64(parts)
    order = np.lexsort((keys[:, 0], part))
    present, begin = np.unique(part[order], return_index=True)
    return order, list(zip(present.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)][: len(present)], strict=True))


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: planes of as many bytes as the largest needs, compressed."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _spread(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out, width = np.zeros((n, 8), np.uint8), raw[0]
    out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(raw[1:], n * width), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


#: What moves between blocks and parts: entries have n keys and counts, a block's own row has what its scores need.
_SENT = {"part": pa.int32(), "home": pa.int32(), "block": pa.int64(), "n": pa.int32(), **dict.fromkeys(("keys", "t", "b", "tokens", "lengths", "flags", "hashes", "ids"), pa.binary())}
_SENT_SCHEMA = ", ".join(f"{c} {'binary' if kind == pa.binary() else 'long' if kind == pa.int64() else 'int'}" for c, kind in _SENT.items())


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in _SENT.items()], names=list(_SENT))


def _hashes(words: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words), "<u8").reshape(-1, 2)


def _sender(parts: int, counted: bool, asking: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of blocks for their parts: `counted` with the counts in the block, `asking` with a block number to send sums to."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches, most)):
            pairs, t, b = block.counts()
            hashes = _hashes([b"", *block.words])
            keys = np.stack([_keys(hashes[:, h], pairs) for h in (0, 1)], axis=1)
            order, slices = _dealt(keys, parts)
            keys, t, b = keys[order, 0], t[order], b[order]
            place = {"home": (task + 7919 * k) % parts, "block": task << 32 | k} if asking else {}
            if asking:
                ids = pa.concat_arrays(block.ids)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
                own = {"n": len(block.lengths), "tokens": _squeezed(np.concatenate(block.x)), "lengths": _squeezed(np.array(block.lengths)), "flags": np.array(block.flags, np.uint8).tobytes(), "hashes": hashes.tobytes(), "ids": sink.getvalue().to_pybytes()}
                yield _rows([place | {"part": place["home"]} | own])
            for s in range(0, len(slices), 256):
                yield _rows([place | {"part": p, "n": j - i, "keys": _squeezed(np.diff(keys[i:j], prepend=np.uint64(0)))} | ({"t": _squeezed(t[i:j]), "b": _squeezed(b[i:j])} if counted else {}) for p, i, j in slices[s : s + 256]])

    return send


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part: the sums for each block's entries, in their order; rows of blocks as they are."""
    keys, t, b, asked, n = [], [], [], [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in _SENT}
            if row["tokens"] is not None:
                yield _rows([row])
                continue
            keys.append(np.cumsum(_spread(row["keys"], row["n"])))
            for held, c in ((t, "t"), (b, "b")):
                held.append(np.zeros(row["n"], np.int64) if row[c] is None else _spread(row[c], row["n"]).astype(np.int64))
            if row["block"] is not None:
                asked.append(({c: row[c] for c in ("part", "home", "block", "n")}, n, n + row["n"]))
            n += row["n"]
    if not asked:
        return
    every = np.concatenate(keys)
    keys.clear()
    order = np.argsort(every, kind="stable")
    first = np.concatenate([[True], np.diff(every[order]) != 0])
    del every
    begin, at = np.flatnonzero(first), np.empty(n, np.int64)
    at[order] = np.cumsum(first) - 1
    sums = [np.add.reduceat(np.concatenate(c)[order], begin) for c in (t, b)]
    for place, i, j in asked:
        yield _rows([place | {"t": _squeezed(sums[0][at[i:j]]), "b": _squeezed(sums[1][at[i:j]])}])


def _scorer(model: tuple[int, tuple[int, int], tuple[int, int]], parts: int, own_counts: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_words, tokens, texts = model
    least = 0.5 / max(1, tokens[1])

    def scored(own: dict, sums: dict[int, tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        lengths, flags, hashes = _spread(own["lengths"], own["n"]).astype(np.int64), np.frombuffer(own["flags"], np.uint8), np.frombuffer(own["hashes"], "<u8").reshape(-1, 2)
        x, w = _spread(own["tokens"], int(lengths.sum())).astype(np.int64), len(hashes) - 1
        codes = _codes(x, lengths, w)
        pairs, at = np.unique(codes, return_inverse=True)
        order, slices = _dealt(np.stack([_keys(hashes[:, h], pairs) for h in (0, 1)], axis=1), parts)
        if {p: n for p, (n, _, _) in sums.items()} != {p: j - i for p, i, j in slices}:
            raise RuntimeError("a block's sums are of other entries than it asked for")
        doc, head = np.repeat(np.arange(len(lengths)), lengths), codes // max(1, w)
        some = np.flatnonzero(lengths)
        first = (np.cumsum(lengths) - lengths)[some]
        # how often the token's document has its pair, its word, and the word before (a text's start: once)
        in_pair, in_word = (_times(doc * size + c) for size, c in ((len(pairs), at), (w, x)))
        in_head = np.concatenate([[1], in_word[:-1]])[: len(x)]
        in_head[first] = 1
        means = []
        for k in (0, 1):
            counts = np.zeros(len(order), np.int64)
            for p, i, j in slices:
                counts[order[i:j]] = _spread(sums[p][1 + k], j - i).astype(np.int64)
            mine = (flags[doc] > 0 if k == 0 else np.ones(len(x), bool)) & own_counts
            heads = np.concatenate([[texts[k]], counts[:w]])[head] - mine * in_head
            share = (counts[w:][at] - mine * in_pair) / np.maximum(heads, 1)
            alone = (counts[:w][x] - mine * in_word) / np.maximum(tokens[k] - mine * lengths[doc], 1)
            loss = -np.log(0.5 * share + 0.5 * (alone + least) / (1 + least * (n_words + 1)))
            mean = np.zeros(len(lengths))
            if len(some):
                mean[some] = np.add.reduceat(loss, first) / lengths[some]
            means.append(mean)
        ids = pa.ipc.open_stream(own["ids"]).read_all().column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), *(pa.array(m, pa.float64()) for m in (*means, means[0] - means[1]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, found = {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in _SENT}
                if row["tokens"] is not None:
                    blocks[row["block"]] = row
                else:
                    found.setdefault(row["block"], {})[row["part"]] = row["n"], row["t"], row["b"]
        while blocks:
            block, own = blocks.popitem()
            yield scored(own, found.pop(block, {}))

    return run


def _times(x: np.ndarray) -> np.ndarray:
    """How often each number occurs, in its places."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[at]


def train(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CorpusCounts:
    """Models of all rows of docs, target being those whose id is in `target`. Null texts have no tokens; repeated rows count as
    often as they occur; an empty table and an empty target make models that know nothing."""
    marked = batched(_marked(docs, target, id_col, text_col))
    parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK_TOKENS):
            lengths, flags = np.array(block.lengths), np.array(block.flags, bool)
            some, h = lengths > 0, _hashes([*block.words])
            sums = [int(lengths[flags].sum()), int(lengths.sum()), int((some & flags).sum()), int(some.sum())]
            part, key = (h[:, 1] % np.uint64(parts)).astype(np.int32), h[:, 0]
            order = np.lexsort((key, part))
            present, begin = np.unique(part[order], return_index=True)
            own = [key[order[i:j]] for i, j in zip(begin, [*begin[1:], len(key)][: len(begin)], strict=True)]
            # the block's sums go with a row of no keys
            yield pa.RecordBatch.from_arrays([pa.array([0, *present.tolist()], pa.int32()), pa.array([0, *map(len, own)], pa.int64()), pa.array([b"", *(_squeezed(np.diff(k, prepend=np.uint64(0))) for k in own)], pa.binary()), *(pa.array([x] + [0] * len(own), pa.int64()) for x in sums)], names=["part", "n", "keys", *sent])

    sent = ["t", "b", "texts_t", "texts_b"]
    longs = ", ".join(f"{c} long" for c in sent)
    words = marked.mapInArrow(count, f"part int, n long, keys binary, {longs}").repartition("part").sortWithinPartitions("part").mapInArrow(_distinct, f"n long, {longs}")
    r = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *sent))).first()
    return CorpusCounts(docs, marked, r.n, (r.t, r.b), (r.texts_t, r.texts_b))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part at a time: how many distinct keys they have, and the sums of the rest."""
    part, held, sums = None, np.zeros(0, np.uint64), [0] * 4
    for batch in batches:
        for r in range(batch.num_rows):
            p, n, raw, *more = (c[r].as_py() for c in batch.columns)
            if p != part:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(held), *sums)], names=["n", "t", "b", "texts_t", "texts_b"])
                part, held, sums = p, np.zeros(0, np.uint64), [0] * 4
            held = np.union1d(held, np.cumsum(_spread(raw, n)))
            sums = [a + b for a, b in zip(sums, more, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(held), *sums)], names=["n", "t", "b", "texts_t", "texts_b"])


def _marked(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, target (whether the id is in `target`), a row for each of docs."""
    key, flag = fresh(docs, "key", "flag")
    chosen = target.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    return docs.join(chosen, F.col(f"`{id_col}`") == F.col(key), "left").select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(flag).isNotNull().alias("target"))


def score(docs: DataFrame, models: CorpusCounts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_tokens, ce_target, ce_background, difference (nats a token, 0 without tokens, as null and
    empty texts are). If docs are the models' own, each row is scored without its own counts, copies of it apart. A very long
    text is a block of its own. Repeated rows are scored alike; other columns do not matter."""
    names = [id_col, "n_tokens", "ce_target", "ce_background", "difference"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[2:])])
    parts, own = max(docs.sparkSession.sparkContext.defaultParallelism, -(-models.tokens[1] // PART_TOKENS)), docs is models.docs
    if own:
        sent = models.marked.mapInArrow(_sender(parts, True, True, BLOCK_TOKENS), _SENT_SCHEMA)
    else:
        asked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(False).alias("target"))
        sent = models.marked.mapInArrow(_sender(parts, True, False, BLOCK_TOKENS), _SENT_SCHEMA).unionByName(asked.mapInArrow(_sender(parts, False, True, BLOCK_TOKENS), _SENT_SCHEMA))
    sums = sent.repartitionById(parts, F.col("part")).mapInArrow(_summed, _SENT_SCHEMA)
    return sums.repartitionById(parts, F.col("home")).mapInArrow(_scorer((models.n_words, models.tokens, models.texts), parts, own, names), schema)
