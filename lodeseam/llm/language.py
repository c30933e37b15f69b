"""Language ID by a convolutional network over bytes: filters of several widths, max pooling and softmax, trained in numpy.

A text is cut into fixed-length windows of bytes, the last one filled up with zeros; all of them are classified, and their mean
logits, weighted by their bytes, decide. For prediction the filters become tables over pairs of bytes, so a convolution is a few
look-ups. A filter sees only bytes of its own window, and sums are taken in an order that no other row changes: a text gets the
same result to the last bit alone and in any batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.common import batched, fresh, share, sliced

WINDOW, DEPTH, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: Bounds of the labelled sample: documents of each language, windows of each document, languages (more than the world has).
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_LANGS = 240, 4, 10_000
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def has_letter(text: str) -> bool:
    """Whether any character is of a category L; numerals such as ½ and Ⅷ are not."""
    return any(map(str.isalpha, text))


def as_bytes(texts: list[str | None]) -> list[np.ndarray]:
    return [_LOWER[np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)] for t in texts]


class ByteConvNet:
    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.w = {"embed": rng.normal(0, 0.5, (256, DEPTH))}
        for k in WIDTHS:
            self.w[f"conv{k}"] = rng.normal(0, (2 / (k * DEPTH)) ** 0.5, (k * DEPTH, FILTERS))
            self.w[f"bias{k}"] = np.zeros(FILTERS)
        self.w["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))
        self.w["out_bias"] = np.zeros(len(langs))
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.006, seed: int = 11) -> ByteConvNet:
        """Adam on the cross entropy of windows (n by WINDOW, bytes)."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), batch):
                grads, step = self._grads(windows[order[s : s + batch]], labels[order[s : s + batch]]), step + 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, w = len(x), self.w
        e = w["embed"][x]
        views, tops, pooled = {}, {}, []
        for k in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - k + 1, k * DEPTH)
            h = view @ w[f"conv{k}"]
            tops[k] = h.argmax(axis=1)
            views[k] = np.take_along_axis(view, tops[k][:, :, None], axis=1)  # n, filters, k * depth
            pooled.append(np.take_along_axis(h, tops[k][:, None, :], axis=1)[:, 0] + w[f"bias{k}"])
        p = np.concatenate(pooled, axis=1)
        a = np.maximum(p, 0)
        z = a @ w["out"] + w["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        grads = {"out": a.T @ z, "out_bias": z.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        back = (z @ w["out"].T) * (p > 0)
        for j, k in enumerate(WIDTHS):
            d = back[:, j * FILTERS : (j + 1) * FILTERS]
            grads[f"bias{k}"] = d.sum(axis=0)
            grads[f"conv{k}"] = np.einsum("nf,nfd->df", d, views[k])
            de = (d[:, :, None] * w[f"conv{k}"].T[None]).reshape(n, FILTERS, k, DEPTH)
            at = tops[k][:, :, None] + np.arange(k)
            np.add.at(grads["embed"], x[np.arange(n)[:, None, None], at], de)
        return grads

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        """For each width, tables whose rows add up to a filter's value: over pairs of bytes, then over a single one."""
        out = []
        for k in WIDTHS:
            one = [self.w["embed"] @ self.w[f"conv{k}"][j * DEPTH : (j + 1) * DEPTH] for j in range(k)]
            pairs = [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)]
            out.append((k, [*pairs, *one[k // 2 * 2 :]]))
        return out

    def logits(self, data: np.ndarray, tables) -> np.ndarray:
        """Of consecutive windows; data holds them and max(WIDTHS) bytes more, which no filter sees."""
        n = len(data) // WINDOW
        size = n * WINDOW
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        pooled = []
        for k, parts in tables:
            h = parts[0].take(pair[:size], axis=0)
            for j, part in enumerate(parts[1:], 1):
                h += part.take(pair[2 * j : 2 * j + size] if 2 * j + 1 < k else data[2 * j : 2 * j + size], axis=0)
            pooled.append(h.reshape(n, WINDOW, FILTERS)[:, : WINDOW - k + 1].max(axis=1) + self.w[f"bias{k}"])
        out = np.tile(self.w["out_bias"], (n, 1))
        for a, weights in zip(np.maximum(np.concatenate(pooled, axis=1), 0).T, self.w["out"], strict=True):
            out += a[:, None] * weights  # one after the other: a matrix product rounds by the number of rows
        return out

    def predict(self, texts: list[str | None], step: int = 1 << 18) -> tuple[list[str], list[float]]:
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        chosen = [k for k, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        data = dict(zip(chosen, as_bytes([texts[k] for k in chosen]), strict=True))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            padded = np.zeros(size + max(WIDTHS), np.uint8)
            owner, weight, at = [], [], 0
            for k, x in held:
                padded[at : at + len(x)] = x
                n = -(-len(x) // WINDOW)
                owner += [k] * n
                weight += [WINDOW] * (n - 1) + [len(x) - (n - 1) * WINDOW]
                at += n * WINDOW
            np.add.at(sums, owner, self.logits(padded, self._tables) * np.array(weight)[:, None])

        for k in chosen:
            x = data[k]
            for s in range(0, len(x), step):
                held.append((k, x[s : s + step]))
                size += -(-len(held[-1][1]) // WINDOW) * WINDOW
                if size >= step:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        for k in chosen:
            z = sums[k] / max(1, len(data[k]))
            p = np.exp(z - z.max())
            langs[k], scores[k] = self.langs[int(p.argmax())], float(p.max() / p.sum())
        return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = SAMPLE_DOCS, windows_per_doc: int = SAMPLE_WINDOWS) -> ByteConvNet:
    """Fit a net on a bounded sample of labelled rows that are not held out: of the SAMPLE_LANGS most frequent languages the
    docs_per_lang documents of the smallest id hash, and of each the windows that start at even distances in its text."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(~held_out(id_col="id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    counts = {r.lang: r["count"] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGS).collect()}
    # of a language's documents only about four times as many as are wanted are ranked, however many there are
    most = F.try_element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * docs_per_lang / n)))), F.col("lang")) if counts else F.lit(None)
    ranked = d.select("id", "lang").where(share(F.col("id")) <= most).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(share(F.col("id")), "id")))
    ids = [r.id for r in ranked.where(F.col("r") <= docs_per_lang).select("id").collect()]
    cut = [F.substring("text", (F.greatest(F.length("text") - WINDOW, F.lit(0)) * (k / max(1, windows_per_doc - 1))).cast("int") + 1, F.lit(WINDOW)) for k in range(windows_per_doc)]
    sample = d.where(F.col("id").isin(ids)).select("id", "lang", F.array_distinct(F.array(*cut)).alias("parts")).dropDuplicates(["id"]) if ids else d.limit(0).select("id", "lang", F.array().cast("array<string>").alias("parts"))
    rows = sorted((r.lang, r.id, p) for r in sample.collect() for p in r.parts if has_letter(p))
    net = ByteConvNet(sorted({r[0] for r in rows}))
    if not rows:
        return net
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for k, x in enumerate(as_bytes([r[2] for r in rows])):
        windows[k, : min(WINDOW, len(x))] = x[:WINDOW]
    return net.fit(windows, np.array([net.langs.index(r[0]) for r in rows]))


def identify(docs: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs plus lang_pred and score (columns of those names are replaced).

    Every window of the whole text counts. lang_pred is `und`, with score 0, for null texts, texts without a letter, and if the
    net has learned no language; else one of the net's. A prediction sees nothing but the text, so equal texts get equal
    results; nothing is shuffled.
    """
    docs = batched(docs.drop("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_identified(docs: DataFrame, net: ByteConvNet, langs: list[str] | None = None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose language is known (and one of langs, if given) with min_score or more."""
    pred, score = fresh(docs, "lang_pred", "score")
    named = identify(docs.withColumnsRenamed({c: n for c, n in (("lang_pred", pred), ("score", score)) if c in docs.columns}), net, text_col)
    ok = (F.col("lang_pred") != "und") & (F.col("score") >= min_score)
    kept = named.where(ok & F.col("lang_pred").isin(langs) if langs else ok).drop("lang_pred", "score")
    return kept.withColumnsRenamed({pred: "lang_pred", score: "score"})
