"""Searches take every query vector whose id is divisible by 20, in blocks."""

import numpy as np

from lodeseam.operators import vector
from lodeseam.plans import fixtures
from tests.conftest import SF


def test_query_set(spark):
    every = {r.chunk_id for r in fixtures.vectors(spark, SF).collect()}
    assert {r.query_id for r in fixtures.query_vectors(spark, SF).collect()} == {k for k in every if k % 20 == 0} != set()


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 7)
    unit = np.random.default_rng(5).normal(size=(40, 8))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(unit)], "chunk_id long, vector array<float>").repartition(3)
    got = vector.cosine_hits(v, v.selectExpr("chunk_id AS query_id", "vector"), 5).collect()
    cosine = unit.astype(np.float64) @ unit.T.astype(np.float64)
    want = {(q, int(k), n + 1) for q in range(40) for n, k in enumerate(np.lexsort((np.arange(40), -np.round(cosine[q], 9)))[:5])}
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == want and len(got) == 200
