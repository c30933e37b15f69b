from collections import Counter
from math import log

import numpy as np
from helpers import awkward, empty

from lodeseam.llm import cross_entropy, queries
from lodeseam.llm.decontaminate import words_of
from tests.conftest import SF


def test_target_scores_lower(spark):
    rows = [(k, ("alpha beta gamma " if k % 2 else "omega psi chi ") * 5, "en") for k in range(20)]
    docs = awkward(spark, rows)
    out = cross_entropy.score(docs, cross_entropy.train(docs, docs.where("doc_id % 2 = 1"))).collect()
    assert max(r.difference for r in out if r.doc_id % 2) < 0 < min(r.difference for r in out if r.doc_id % 2 == 0)


def test_copies_stand_apart(spark):
    """A text that occurs once knows nothing of itself; of two copies each knows the other."""
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(60)), "en") for k in range(40)]
    rows += [(100 + k, rows[k][1], "en") for k in range(4)]
    docs = awkward(spark, rows)
    got = {r.doc_id: r.difference for r in cross_entropy.score(docs, cross_entropy.train(docs, docs.where("doc_id >= 20 AND doc_id < 40"))).collect()}
    twice = [got[k] for k in (*range(4), *range(100, 104))]
    assert min(twice) > max(abs(v) for k, v in got.items() if 4 <= k < 40) + 1


def test_numbers_survive_packing():
    rng = np.random.default_rng(0)
    for top in (1, 2, 255, 256, 70_000, 1 << 40, 1 << 63):
        x = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (cross_entropy._spread(cross_entropy._squeezed(x), 1000) == x).all()
    assert len(cross_entropy._spread(cross_entropy._squeezed(np.zeros(0)), 0)) == 0


def unhashed(docs, chosen, scored, own=True):
    """Losses by plain counts of all words and pairs; a document that is one of the counted ones is taken off first."""
    single, pair, heads = ([Counter(), Counter()] for _ in range(3))
    for k, text in docs:
        x = words_of(text)
        for m in (0, 1) if k in chosen else (1,):
            single[m].update(x)
            pair[m].update(zip([None, *x], x))
            heads[m].update([None, *x] if x else [])
    v, total, out = len(single[1]) + 1, [sum(c.values()) for c in single], {}
    least = 0.5 / max(1, total[1])
    for k, text in scored:
        x = words_of(text)
        loss = []
        for m in (0, 1):
            mine = own and (m == 1 or k in chosen)
            s, p, h = ((Counter(y) if mine else Counter()) for y in (x, zip([None, *x], x), [None, *x]))
            each = [-log(0.5 * (pair[m][a, b] - p[a, b]) / max(1, heads[m][a] - h[a]) + 0.5 * ((single[m][b] - s[b]) / max(1, total[m] - len(x) * mine) + least) / (1 + least * v)) for a, b in zip([None, *x], x)]
            loss.append(sum(each) / max(1, len(x)))
        out[k] = [len(x), *loss, loss[0] - loss[1]]
    return out


def exact(docs, models, want):
    got = cross_entropy.score(docs, models).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r.n_tokens, r.ce_target, r.ce_background, r.difference], want[r.doc_id], rtol=1e-9), r


def test_every_word_and_pair_counts(spark, monkeypatch):
    # small blocks and parts, so that sums cross both
    monkeypatch.setattr(cross_entropy, "BLOCK_TOKENS", 3_000)
    monkeypatch.setattr(cross_entropy, "PART_TOKENS", 10_000)
    made = [(k, " ".join(f"w{(k * 613 + i * i * 7) % 45_000}" for i in range(1_200))) for k in range(80)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    models, chosen = cross_entropy.train(docs, target), set(range(0, 80, 3))
    exact(docs, models, unhashed(made, chosen, made))
    other = [(1, "w1 never seen w2 w3"), (2, ""), (3, made[4][1])]
    exact(spark.createDataFrame(other, "doc_id long, text string"), models, unhashed(made, chosen, other, False))


def test_unhashed_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    rows = [tuple(r) for r in docs.collect()]
    exact(docs, cross_entropy.train(docs, target), unhashed(rows, {r.doc_id for r in target.collect()}, rows))


def test_op8_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    chosen = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").collect()}
    want, got = unhashed(docs, chosen, docs), queries.op8_cross_entropy(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert np.allclose([r.n_tokens, r.ce_target, r.ce_background, r.difference], want[r.doc_id], rtol=1e-9)


def test_awkward_unbounded(spark):
    docs = awkward(spark)
    rows = cross_entropy.score(docs, cross_entropy.train(docs, empty(spark).select("doc_id"))).collect()
    assert len(rows) == 10 and {r.difference for r in rows if r.doc_id in (1, 2, 5)} == {0.0} and sum(r.doc_id is None for r in rows) == 1
    nothing = empty(spark)
    models = cross_entropy.train(nothing, nothing)
    assert cross_entropy.score(nothing, models).count() == 0 and cross_entropy.score(docs, models).count() == 10
