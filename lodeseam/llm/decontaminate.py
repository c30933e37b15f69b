"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is over words. A document's words are streamed through it, which gives for each word the length of
the longest match with an item that ends there; lengths at or over the window mark words, and marked spans are
removed. Words outside the items' vocabulary, and words whose neighbours never stand beside them in an item, have
a longest match of 0 or 1 that needs no automaton, so only runs of known word pairs are streamed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.common import WORD_BYTES, batched, fresh, sha, sliced, staged

#: An automaton holds about so many item words; more items make more automata, which documents pass in turn, so many in a worker.
BLOCK_WORDS, AUTOMATA = 200_000, 4
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Fixed value: the words of the raw text, for their places.
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "n_words long, n_hit long, longest long, item_ids array<long>, spans array<struct<first:int,last:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; states are numbers, edges dictionaries."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for key, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((key, ids))
                last = 0
                for x in ids:
                    last = self._extend(last, x)
        self.items: dict[int, set] = {}  # by state: items that have a window which ends there
        self.short: dict[int, list[tuple[int, int | None]]] = {}  # by state: whole items shorter than a window
        pairs = set()
        for key, ids in coded:
            state = 0
            for k, x in enumerate(ids):
                state = self.next[state][x]
                while self.len[self.link[state]] >= window:
                    state = self.link[state]
                if k + 1 >= window:
                    self.items.setdefault(state, set()).add(key)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), key))
            pairs.update(zip(ids, ids[1:], strict=False))
        self.least = min([window, *(m for x in self.short.values() for m, _ in x)])
        self.pairs = np.array(sorted(a * len(self.vocab) + b for a, b in pairs), dtype=np.int64)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, x)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, x)
        return cur

    def scan(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set]:
        """Longest match, marked word ranges (end exclusive, may overlap), items met."""
        n = len(words)
        if not n or not self.vocab:
            return 0, [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        known = ids >= 0
        longest, spans, met = int(known.any()), [], set()
        at = np.flatnonzero(known[:-1] & known[1:])
        code = ids[at] * len(self.vocab) + ids[at + 1]
        joined = np.zeros(n + 1, dtype=bool)  # k: words k-1 and k stand together in an item
        if len(self.pairs) and len(at):
            joined[at[self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code] + 1] = True
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        longest = max(longest, 2 * int(joined.any()))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if self.least == 1 else ((s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= min(self.least, 3)):
            state = length = 0
            for k, x in enumerate(ids[s:e].tolist(), s):
                while state and x not in self.next[state]:
                    state = self.link[state]
                    length = self.len[state]
                if (to := self.next[state].get(x)) is not None:
                    state, length = to, length + 1
                longest = max(longest, length)
                if length >= self.window:
                    spans.append((k + 1 - length, k + 1))
                    u = state
                    while self.len[self.link[u]] >= self.window:
                        u = self.link[u]
                    met |= self.items[u]
                if self.short:
                    u = state
                    while u > 0:
                        for m, key in self.short.get(u, ()):
                            if m <= length:
                                spans.append((k + 1 - m, k + 1))
                                met.add(key)
                        u = self.link[u]
        return longest, spans, met


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for key, text in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if words := words_of(text):
            block.append((key, words))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block or not size:
        yield block


def _scanner(shared, text_col: str, first: bool) -> Step:
    """Adds `found`, or what one more automaton finds to it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
        for batch in sliced(batches):
            rows = []
            before = None if first else batch.column("found")
            for i, text in enumerate(batch.column(text_col)):
                words = words_of(text.as_py())
                longest, spans, met = automaton.scan(words)
                if before is not None and (old := before[i].as_py()):
                    longest = max(longest, old["longest"])
                    spans = [*spans, *((x["first"], x["last"]) for x in old["spans"])]
                    met = met.union(old["item_ids"])
                spans = merged(spans)
                rows.append({"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "longest": longest, "item_ids": sorted(x for x in met if x is not None), "spans": [{"first": s, "last": e} for s, e in spans]})
            columns = [c for c, x in zip(batch.columns, batch.schema.names, strict=True) if x != "found"]
            names = [x for x in batch.schema.names if x != "found"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*names, "found"])

    return scan


def _passed(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, last: Step | None = None) -> DataFrame:
    """docs and `found`, or what `last` makes of them, which takes `found` away. AUTOMATA automata are passed in one worker; after
    so many the documents are staged, so no worker ever holds more."""
    found_type = T._parse_datatype_string(f"struct<{', '.join(':'.join(x.split(' ', 1)) for x in FOUND.split(', '))}>")
    plain = T.StructType([f for f in docs.schema.fields if f.name != "found"])
    schema = T.StructType([*plain.fields, T.StructField("found", found_type)])
    blocks, out, k = _blocks(items, item_id, item_text), batched(docs.drop("found")), 0
    group = list(islice(blocks, AUTOMATA))
    while group:
        then = list(islice(blocks, AUTOMATA))
        steps = [_scanner(docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(x, window)), text_col, k + j == 0) for j, x in enumerate(group)]
        steps += [last] if last and not then else []

        def run(batches: Iterator[pa.RecordBatch], steps=steps) -> Iterator[pa.RecordBatch]:
            for step in steps:
                batches = step(batches)
            return batches

        out = out.mapInArrow(run, plain if last and not then else schema)
        out, k, group = staged(out, "found") if then else out, k + len(group), then
    return out


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """All rows and columns of docs plus `found`, a struct: n_words, n_hit (words inside any occurrence of an item's
    window), longest (longest match in words), item_ids (sorted), spans (merged, in words, last exclusive).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Null or
    wordless texts have no words and no hits; wordless items have no windows; repeated items count once by id, and
    an item without an id marks words but is not listed; item ids are integers. A column `found` of docs is replaced. Documents
    are not shuffled. The items are read in blocks of BLOCK_WORDS words, each a broadcast of bounded size.
    """
    return _passed(docs, items, text_col, item_id, item_text, window)


def item_digest(item_ids: Column) -> Column:
    return sha(F.array_join(F.array_sort(F.transform(item_ids, lambda x: x.cast("string"))), ","))


def remove_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, min_span: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The rows and columns of docs without what they share with the items.

    Marked spans of min_span words or more leave the text (with what stands between their words; one space takes
    their place), as do shorter spans that are whole items. A document whose marked words are over max_coverage of
    all its words goes. Clean rows, null texts included, are as they were; each row is judged alone, repeated ones alike.
    """
    (held,) = fresh(docs, "found")  # a column of that name is the caller's

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, keep = batch.schema.names.index(text_col), [], []
            for text, f in zip(batch.column(at).to_pylist(), batch.column("found").to_pylist(), strict=True):
                keep.append(f["n_hit"] == 0 or f["n_hit"] <= max_coverage * f["n_words"])
                spans = [(x["first"], x["last"]) for x in f["spans"] if x["last"] - x["first"] >= min_span or x["last"] - x["first"] < window]
                if spans and keep[-1]:
                    places, parts, done = [m.span() for m in RAW_WORD.finditer(text)], [], 0
                    for s, e in spans:
                        parts += [text[done : places[s][0]], " "]
                        done = places[e - 1][1]
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return _passed(docs.withColumnRenamed("found", held), items, text_col, item_id, item_text, window, cut).withColumnRenamed(held, "found")
