"""Near-duplicate documents by a chosen-path set similarity join.

1. A document is its set of word shingles. Documents with equal sets are one class; only classes go on.
2. Each class has K minwise tokens. In each of several independent trees a node chooses one coordinate, a second one with
   the probability that keeps the expected number of collisions at the threshold at one a level, and sends a class to
   the child of its token there. All choices are hashes of the node's path, so a class finds its nodes by itself.
3. Nodes of one class end. The others are compared exhaustively, on sketches of the minwise tokens; of more than BLOCK
   classes at first only within blocks of BLOCK classes, so each class is sent once, however large its node is.
4. Of a node's candidate pairs only a spanning forest leaves it: enough to know which classes may belong together. In each
   such family links are confirmed on full sets, likeliest pairs first; a pair that its block already knows to be connected
   needs no look, and again only a spanning forest leaves the task.
5. Most large nodes are now one connected component, and end. In the others, and in large families, what is not of the
   largest component (the rest) is compared with all, in pairs of blocks, so no task holds a whole group; where the rest is
   over BLOCK classes itself, the node branches on first, down to the last depth. No pair of unequal components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import batched, fresh, sliced, staged

K, BLOCK = 128, 512
#: Sketch matches that a linked pair has but for once in about a million, for a threshold t: t less so many deviations.
DEVIATIONS = 4.7
#: A side of a join up to so many rows of two numbers is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000
#: Edges that a task takes; where so few are left, one task ends the search for components.
EDGES_A_TASK = 200_000

_R = np.random.default_rng(64)
_PLACE = _R.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _R.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _R.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _R.integers(0, 1 << 32, K, dtype=np.uint32)
_ODD = [np.uint64(int(x) * 2 + 1) for x in _R.integers(1, 1 << 62, 8)]


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[k % 4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[(k + 1) % 4 + 4]
    return x ^ (x >> np.uint64(32))


_IS_BLANK = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])


def shingle_sets(texts: list[str | None], n: int, step: int = 1 << 21) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of n words; of fewer words, the whole sequence."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "replace").lower())
        size += len(held[-1])
        if size >= step or k + 1 == len(texts):
            yield from _sets(held, n)
            held, size = [], 0


def _sets(held: list[bytes], n: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([*held, b""]), np.uint8)  # a blank after each
    word = ~_IS_BLANK[data]
    edge = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    starts = np.concatenate([np.zeros(1, np.int64), edge]) if len(word) and word[0] else edge
    if len(starts):
        offset = np.arange(len(data)) - starts[np.maximum(np.cumsum(np.bincount(starts, minlength=len(data))) - 1, 0)]
        part = (data.astype(np.uint64) + np.uint64(1)) * _PLACE[offset & 4095]
        if len(far := np.flatnonzero(offset > 4095)):
            part[far] *= mix((offset[far] >> 12).astype(np.uint64)) | np.uint64(1)
        part[~word] = 0
        words = mix(np.add.reduceat(part, starts))
    else:
        words = np.zeros(0, np.uint64)
    m = max(0, len(words) - n + 1)
    grams = np.zeros(m, np.uint64)
    for k in range(n):
        grams += words[k : k + m] * _STEP[k % 64] if k < 64 else mix(words[k : k + m] + np.uint64(k))
    grams = mix(grams, 1)
    ends = np.cumsum([len(x) + 1 for x in held])
    upto = np.searchsorted(starts, ends)  # words of each text and those before
    first = 0
    for last in upto.tolist():
        if last - first >= n:
            yield np.unique(grams[first : last - n + 1])
        elif last > first:
            yield mix((words[first:last] * _STEP[: last - first]).sum(dtype=np.uint64, keepdims=True), 2)
        else:
            yield np.zeros(0, np.uint64)
        first = last


def minwise(shingles: np.ndarray) -> np.ndarray:
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(K, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 512):
        np.minimum(out, (x[s : s + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(mix(shingles, k).sum(keepdims=True, dtype=np.uint64), k)[0].view(np.int64)) for k in (2, 3))


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Trees that find a pair at the threshold with the given probability, if it has to collide down to the depth."""
    second, found = 1 / threshold - 1, 1.0
    for _ in range(depth):
        one = 1 - threshold * found
        found = 1 - (1 - second) * one - second * one * one
    return max(1, ceil(log(1 - recall) / log(1 - found)))


def children(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The next level of the paths: nodes, and the row of tokens (classes by K) that each is of."""
    pick, again = mix(nodes, 1), mix(nodes, 3)
    two = (again >> np.uint64(11)).astype(np.float64) / 2.0**53 < 1 / threshold - 1
    at, row, node = np.concatenate([pick, mix(again[two], 2)]) % np.uint64(K), np.concatenate([rows, rows[two]]), np.concatenate([nodes, nodes[two]])
    token = tokens[row, at.astype(np.int64)].astype(np.uint64)
    return mix(node * _STEP[0] + at * _STEP[1] + mix(token, 1) * _STEP[2]), row


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _paths(trees: int, depth: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                tokens, v = _matrix(batch.column("tokens"), K, np.uint32), batch.column("v").to_numpy()
                rows = np.repeat(np.arange(len(v)), trees)
                nodes = mix(np.tile(np.arange(trees, dtype=np.uint64) + np.uint64(1), len(v)))
                for _ in range(depth):
                    nodes, rows = children(nodes, rows, tokens, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(v[rows])], names=["key", "v"])

    return run


def _branch(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, v = _matrix(batch.column("tokens"), K, np.uint32), batch.column("v").to_numpy()
            nodes, rows = children(batch.column("key").to_numpy().view(np.uint64), np.arange(len(v)), tokens, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(v[rows])], names=["key", "v"])

    return run


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            size, h1, h2, tokens, low = [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                a, b = set_hashes(s)
                m = minwise(s)
                size.append(len(s))
                h1.append(a)
                h2.append(b)
                tokens.append(m.tobytes())
                low.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, h1, h2)), pa.array(tokens, pa.binary()), pa.array(low, pa.binary())], names=["id", "size", "h1", "h2", "tokens", "sketch"])

    return run


def _pairs_in(keys, blocks, apart, comps, sketches, sizes, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of equal key and unequal components whose sketches may be linked, and how many coordinates agree."""
    least = int(np.floor(K * (threshold - DEVIATIONS * (threshold * (1 - threshold) / K) ** 0.5)))
    found = []
    for d in range(1, len(keys)):
        same = keys[:-d] == keys[d:]
        if not same.any():
            break
        small, large = np.minimum(sizes[:-d], sizes[d:]), np.maximum(sizes[:-d], sizes[d:])
        i = np.flatnonzero(same & (comps[:-d] != comps[d:]) & (~apart[:-d] | (blocks[:-d] != blocks[d:])) & (small >= threshold * large - 1e-9))
        if len(i):
            match = np.count_nonzero(sketches[i] == sketches[i + d], axis=1)
            ok = match >= least
            found.append((i[ok], i[ok] + d, match[ok]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(comps: np.ndarray, i: np.ndarray, j: np.ndarray, match: np.ndarray, linked=None) -> tuple[list[int], list[int]]:
    """Edges of a forest over the rows that joins their components, from the pairs in order of match; `linked`, if given, is asked
    before two trees join."""
    _, first, of = np.unique(comps, return_index=True, return_inverse=True)
    root, a, b = first[of], [], []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(-match, kind="stable")
    for s in range(0, len(order), 2048):
        part = order[s : s + 2048]
        while (root != root[root]).any():
            root = root[root]
        for k in part[root[i[part]] != root[j[part]]].tolist():
            x, y = top(int(i[k])), top(int(j[k]))
            if x != y and (linked is None or linked(int(i[k]), int(j[k]))):
                root[max(x, y)] = min(x, y)
                a.append(int(i[k]))
                b.append(int(j[k]))
    return a, b


def _linked_sets(shingles: list[bytes], threshold: float):
    sets, t = {}, round(threshold * 1_000_000)

    def linked(i: int, j: int) -> bool:
        for k in (i, j):
            if k not in sets:
                sets[k] = np.frombuffer(shingles[k], np.uint64)
        x, y = sets[i], sets[j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * 1_000_000 >= t * (len(x) + len(y) - both)

    return linked


def _compare(threshold: float, full: bool):
    """Edges (a, b) of spanning forests of what each key holds: of pairs whose sketches may be linked or, with full sets, are linked."""
    columns = ("v", "block", "apart", "comp", "size")

    def give(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        key = rows.column("key").to_numpy()
        v, blocks, apart, comps, sizes = (rows.column(c).to_numpy() for c in columns)
        i, j, match = _pairs_in(key, blocks, apart, comps, _matrix(rows.column("sketch"), K, np.uint8), sizes, threshold)
        if len(i):
            linked = _linked_sets(rows.column("shingles").to_pylist(), threshold) if full else None
            a, b = _forest(comps, i, j, match, linked)
            if a:
                x, y = v[a], v[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                key = batch.column("key").to_numpy()
                if held and held[-1].column("key")[-1].as_py() != key[0]:
                    yield from give(held)
                    held = []
                if start := int(np.searchsorted(key, key[-1])):  # all but the last key is whole
                    yield from give([*held, batch.slice(0, start)])
                    held = []
                held.append(batch.slice(start))
        if held:
            yield from give(held)

    return run


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, root of all edges (a, b) of the task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(vertices))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):  # a tree hooks on to the least neighbour's, then all paths are cut short
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(vertices[root])], names=["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges (a, b), staged. While there are more than EDGES_A_TASK edges, each round joins a vertex to
    its neighbour of the smallest hash, anew each time, and contracts, which shrinks them by a constant factor whatever their
    shape; what is left then goes to one task. Nothing comes to the driver."""
    labels, e, r = None, edges, 0
    while (left := e.count()) > EDGES_A_TASK:
        tasks = 1 + left // EDGES_A_TASK  # the edges shrink from round to round, and so do the tasks that hold them
        both = e.union(e.select("b", "a")).toDF("a", "b")
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(r), "b").alias("h"), F.col("b").alias("to"))).alias("m"))
        p = staged(near.select(F.col("a").alias("p"), F.when(F.col("m.h") < F.xxhash64(F.lit(r), "a"), F.col("m.to")).otherwise(F.col("a")).alias("to")).coalesce(tasks), "near")
        labels = p.toDF("v", "root") if r == 0 else staged(labels.join(p, F.col("root") == F.col("p"), "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        e = e.join(p.toDF("a", "ta"), "a").join(p.toDF("b", "tb"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        e, r = staged(e.coalesce(tasks), "contracted"), r + 1
    last = e.coalesce(1).mapInArrow(_union_find, "v long, root long")
    if labels is not None:
        last = labels.join(F.broadcast(last.toDF("p", "to")), F.col("root") == F.col("p"), "left").select("v", F.coalesce("to", "root").alias("root"))
    return staged(last, "labels")


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999999, deeper: int = 2) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id (the smallest id of its component), kept.

    Ids are integers. Words are parted by blanks, A-Z lower-cased; a document's set has its distinct shingles of `shingle` words,
    or of fewer words the whole sequence. Documents are linked at a Jaccard similarity of `threshold` or more, confirmed on full
    sets (of 64-bit hashes of shingles); recall is the probability to find a pair just at the threshold, closer ones are found
    more surely still. A document without words (or with null text) has an empty set and is linked with nothing. A row without
    an id gets no component, links nothing and is kept. Rows that share an id are judged each by its own text; equal rows get
    equal results; an empty table gives an empty result, and other columns of docs do not matter.
    """
    n_, id_ = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), F.col("id")
    facts = staged(batched(n_).mapInArrow(_describe(shingle), "id long, size long, h1 long, h2 long, tokens binary, sketch binary"), "sets")
    real = facts.where(id_.isNotNull() & (F.col("size") > 0))
    counted = staged(real.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("size").alias("size")), "classes")
    # a class is known by one number, made of its 128 bits anew until no two classes share it
    number, salt = F.col("h1"), 0
    while True:
        r = counted.agg(F.count("*").alias("n"), F.count_distinct(number).alias("v")).first()
        if r.n == r.v:
            break
        salt += 1
        number = F.xxhash64(F.lit(salt), "h1", "h2")
    facts, classes = facts.withColumn("v", number), counted.withColumn("v", number)
    reps = facts.join(classes.select("v", F.col("rep").alias("id")), ["v", "id"], "left_semi").dropDuplicates(["v"])
    reps = staged(reps.select("v", "h1", "h2", "id", "size", "tokens", "sketch"), "reps")
    depth = max(1, ceil(log(max(2, r.n)) / log(64)))
    labels = _Links(n_, reps, shingle, threshold).labels(depth, deeper, trees_for(threshold, depth + deeper, recall))
    near = _nearby(labels)
    least = classes.select("v", "rep").join(near(labels), "v").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = labels.join(near(least), "root").select("v", "component_id")
    whole = classes.select("v", "rep").join(near(named), "v", "left").select("v", F.coalesce("component_id", "rep").alias("component_id"))
    out = facts.select("id", "size", "v").join(whole, "v", "left")
    component = F.when(F.col("size") == 0, id_).when(id_.isNotNull(), F.col("component_id"))
    return out.select(id_.alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == id_, F.lit(True)).alias("kept"))


def _nearby(labels: DataFrame):
    """Marks for broadcast what has at most as many rows as labels, if those are few."""
    few = labels.count() <= BROADCAST_ROWS
    return lambda df: F.broadcast(df) if few else df


def _live(rows: DataFrame) -> DataFrame:
    """key, v, n of the keys of two rows or more."""
    live = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(live, "key").select("key", "v", "n")


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """key, v, comp, n, most (its largest component), rest (rows of others), of the keys (rows: key, v) that hold several components."""
    near = _nearby(labels)
    rows = rows.select("key", "v").join(near(labels.withColumnRenamed("root", "comp")), "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp"))
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("m")).where("m.c < n")
    keys = staged(keys.select("key", "n", F.col("m.comp").alias("most"), (F.col("n") - F.col("m.c")).alias("rest")), "mixed")
    count = keys.count()
    return rows.join(F.broadcast(keys) if count <= BROADCAST_ROWS else keys, "key") if count else None


def _within(rows: DataFrame) -> DataFrame:
    """rows (key, v, n) dealt to blocks of about BLOCK rows of a key, each to be compared in itself."""
    block = F.pmod(F.xxhash64("v", "key"), F.ceil(F.col("n") / F.lit(BLOCK)))
    return rows.select(F.xxhash64("key", block).alias("key"), "v", F.col("v").alias("comp"), block.alias("block"), F.lit(False).alias("apart"))


def _across(rows: DataFrame) -> DataFrame:
    """rows of _mixed dealt to pairs of blocks, the rest with itself and with the largest component; few rows stay one block."""
    rests, mosts = F.ceil(F.col("rest") / F.lit(BLOCK)), F.ceil((F.col("n") - F.col("rest")) / F.lit(BLOCK))
    own, few, h = F.col("comp") == F.col("most"), F.col("n") <= BLOCK, F.xxhash64("v", "key")
    block = F.when(few, 0).when(own, rests + F.pmod(h, mosts)).otherwise(F.pmod(h, rests))
    others = F.when(few, F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.when(own, rests).otherwise(rests + mosts) - 1))
    dealt = rows.select("key", "v", "comp", block.cast("long").alias("block"), F.explode(others).alias("other"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(pair.alias("key"), "v", "comp", "block", (F.col("block") != F.col("other")).alias("apart"))


class _Links:
    """The search for links between classes. reps: v, h1, h2, id (of a document of it), size, tokens, sketch."""

    def __init__(self, docs: DataFrame, reps: DataFrame, shingle: int, threshold: float) -> None:
        self.docs, self.reps, self.shingle, self.threshold = docs, reps, shingle, threshold
        self.sketches = reps.select("v", "size", "sketch")

    def labels(self, depth: int, deeper: int, trees: int) -> DataFrame:
        """v, root of all classes that are linked with another."""
        paths = self.reps.select("v", "tokens").mapInArrow(_paths(trees, depth, self.threshold), "key long, v long")
        nodes = staged(_live(paths), "nodes")
        maybe = staged(self._compared(_within(nodes), self.sketches, False), "maybe")
        links = self._confirmed(maybe)
        labels, large = components(links), nodes.where(F.col("n") > BLOCK)
        more = self._wide(large, labels, depth, depth + deeper)
        if more is None:
            return labels
        links = links.union(self._confirmed_across(staged(more, "maybe"), labels))
        return components(links)

    def _compared(self, dealt: DataFrame, facts: DataFrame, full: bool) -> DataFrame:
        rows = dealt.join(facts, "v").repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(_compare(self.threshold, full), "a long, b long").distinct()

    def _wide(self, nodes: DataFrame, labels: DataFrame, depth: int, last: int) -> DataFrame | None:
        """Candidates between components that large nodes hold together."""
        out = None
        while (mixed := _mixed(nodes, labels)) is not None:
            mixed = staged(mixed, "wide")
            wide = (F.col("rest") > BLOCK) & F.lit(depth < last)
            found = self._compared(_across(mixed.where(~wide)), self.sketches, False)
            out = found if out is None else out.union(found)
            on = mixed.where(wide)
            if on.isEmpty():
                break
            rows = on.join(self.reps.select("v", "tokens"), "v").select("key", "v", "tokens").mapInArrow(_branch(self.threshold), "key long, v long").distinct()
            nodes, depth = _live(rows), depth + 1
        return out

    def _sets(self, rows: DataFrame) -> DataFrame:
        """v, size, sketch, shingles (all of them) of the classes in rows."""
        shingle, near = self.shingle, _nearby(rows)
        wanted = self.reps.select("v", "h1", "h2", "id").join(near(rows.select("v")), "v", "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1024):
                v, h1, h2 = (batch.column(c).to_pylist() for c in ("v", "h1", "h2"))
                ids, out = [], []
                for k, s in enumerate(shingle_sets(batch.column("text").to_pylist(), shingle)):
                    if set_hashes(s) == (h1[k], h2[k]):  # else another text of the same id
                        ids.append(v[k])
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["v", "shingles"])

        full = self.docs.join(near(wanted), "id").select("v", "h1", "h2", "text").mapInArrow(sets, "v long, shingles binary").dropDuplicates(["v"])
        return self.sketches.join(full, "v")

    def _confirmed(self, maybe: DataFrame) -> DataFrame:
        """Links (a, b), a spanning forest, of the families that candidate pairs make."""
        families = components(maybe)
        if families.isEmpty():
            return families.toDF("a", "b")
        sizes, near = families.groupBy("root").agg(F.count("*").alias("n")), _nearby(families)
        rows = families.join(near(sizes), "root").select(F.col("root").alias("key"), "v", "n")
        links = staged(self._compared(_within(rows), self._sets(families), True), "links")
        large = rows.where(F.col("n") > BLOCK)
        mixed = None if large.isEmpty() else _mixed(large, components(links))
        if mixed is None:
            return links
        mixed = staged(mixed, "across")
        return links.union(staged(self._compared(_across(mixed), self._sets(mixed.select("v").distinct()), True), "links"))

    def _confirmed_across(self, maybe: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between components, of the families that candidate pairs make of them."""
        near = _nearby(labels)
        for c in ("a", "b"):
            maybe = maybe.join(near(labels.toDF(c, f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
        families = components(staged(maybe.where("a <> b").distinct(), "maybe"))
        if families.isEmpty():
            return families.toDF("a", "b")
        # the members of the components, and classes that are one alone
        near = _nearby(families)
        known = near(families.toDF("root", "key"))
        rows = labels.join(known, "root").select("key", "v").union(families.select(F.col("root").alias("key"), "v")).distinct()
        mixed = _mixed(rows, labels)
        if mixed is None:
            return families.limit(0).toDF("a", "b")
        mixed = staged(mixed, "across")
        return staged(self._compared(_across(mixed), self._sets(mixed.select("v").distinct()), True), "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows and columns of docs that stay when one document of each component does, the one of the smallest id.

    A document that has several rows stays, with all of them, if any of them does. Rows without an id stay.
    """
    found = link_near_duplicates(docs, id_col, text_col, **more)
    (gone,) = fresh(docs, "gone")
    drop = staged(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(gone)).agg(F.max("kept").alias("kept")).where("not kept").select(gone), "gone")
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return docs.join(side, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
