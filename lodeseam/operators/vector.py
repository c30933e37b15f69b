"""Dense retrieval over ARRAY<FLOAT> vectors, and their maintenance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.functions.text import let
from lodeseam.operators.lexical import top

#: Query vectors that go to a scan of the vectors together; more take further scans.
BROADCAST_QUERIES = 4_096


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A deterministic bag of hashed words of unit length; the default encoder, built-in functions only."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    bucket = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim)
    # each step is computed once for a text, not once for each place of the vector
    raw = let(bucket, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(own, lambda b: b == k)).cast("double")))

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(counts, lambda x: (x / F.greatest(n, F.lit(1e-12))).cast("float")))

    return let(raw, unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_hits(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, score = max(0, cosine) of the best `limit` vectors (unit length) for each query vector; ties by id.

    The queries go to every partition of the vectors, in blocks of BROADCAST_QUERIES with a scan each; a matrix product per Arrow
    batch keeps the best of each partition, so what is shuffled is at most limit rows for each query and partition.
    """
    rows, local = queries.select("query_id", "vector").toLocalIterator(), None
    while (wanted := list(islice(rows, BROADCAST_QUERIES))) or local is None:
        hits = _block_hits(vectors, wanted, limit, id_col)
        local = hits if local is None else local.unionByName(hits)
    return top(local, limit, "cosine", tie=id_col).withColumn("score", F.greatest("cosine", F.lit(0.0)))


def _block_hits(vectors: DataFrame, wanted: list[Row], limit: int, id_col: str) -> DataFrame:
    """query_id, id, cosine: the best of each partition of the vectors for each of the wanted queries."""
    ids = [r.query_id for r in wanted]
    matrix = np.array([r.vector for r in wanted], dtype=np.float64).reshape(len(ids), -1) if ids else np.zeros((0, 0))
    kind = dict(vectors.dtypes)[id_col]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lists = batch.column(1)
            fit = np.array(lists.value_lengths().fill_null(-1)) == matrix.shape[1]
            if not fit.any() or not len(ids):
                continue
            flat = lists.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
            keys, scores = keys[fit], matrix @ flat.T
            for q in range(len(ids)):
                s, k = np.concatenate([held[q][0], scores[q]]), np.concatenate([held[q][1], keys])
                order = np.lexsort((k, -s))[:limit]
                held[q] = s[order], k[order]
        q = np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in q], pa.int64()), pa.array(np.concatenate([h[1] for h in held]) if ids else [], pa.int64()), pa.array(np.concatenate([h[0] for h in held]) if ids else [], pa.float64())], names=["query_id", id_col, "cosine"])

    return vectors.select(id_col, "vector").mapInArrow(best, f"query_id long, {id_col} {kind}, cosine double")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str, sources: list[str] | None = None) -> DataFrame:
    """Chunks without a vector of this model."""
    scoped = chunks if sources is None else chunks.where(F.col("source_id").isin(sources) if sources else F.lit(False))
    return scoped.join(vectors.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def embed_missing(chunks: DataFrame, vectors: DataFrame, model: str, dim: int = 64, encoder=hashed_vector, sources: list[str] | None = None) -> DataFrame:
    """vectors with one for each missing chunk; a vector of another model is replaced."""
    new = missing_vectors(chunks, vectors, model, sources).select("chunk_id", F.lit(model).alias("model"), F.lit(dim).alias("dim"), encoder(F.col("text"), dim).alias("vector"))
    return upsert_vectors(vectors, new)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return vectors.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def delete_vectors(vectors: DataFrame, chunks: DataFrame, model: str | None = None, sources: list[str] | None = None) -> DataFrame:
    gone = vectors if model is None else vectors.where(F.col("model") == model)
    if sources is not None:
        gone = gone.join(chunks.where(F.col("source_id").isin(sources) if sources else F.lit(False)).select("chunk_id"), "chunk_id", "left_semi")
    return vectors.join(gone.select("chunk_id"), "chunk_id", "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """source_id, chunks, embedded: how many chunks of each source have a vector of the model."""
    own = vectors.where(F.col("model") == model).select("chunk_id").distinct().withColumn("ok", F.lit(1))
    return chunks.join(own, "chunk_id", "left").groupBy("source_id").agg(F.count("*").alias("chunks"), F.count("ok").alias("embedded"))


def load_vectors(vectors: DataFrame, chunks: DataFrame, model: str, dim: int, sources: list[str] | None = None) -> DataFrame:
    """Vectors of the model and of the right length whose chunks exist, by source if sources are given."""
    own = chunks if sources is None else chunks.where(F.col("source_id").isin(sources) if sources else F.lit(False))
    return vectors.where((F.col("model") == model) & (F.size("vector") == dim)).join(own.select("chunk_id"), "chunk_id", "left_semi")


@F.pandas_udf(T.BinaryType())
def to_bytes(v):
    """Little-endian f32 bytes of a vector."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(b):
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))
