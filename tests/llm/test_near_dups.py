import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, awkward, empty

from lodeseam.llm import near_dups


def sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, n, t=0.8):
    s, up = sets([r[1] for r in rows], n), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)].append(r[0])
    return sorted(((r[0], len(s[k]), None if r[0] is None else min(least[top(k)])) for k, r in enumerate(rows)), key=repr)


def corpus(seed, n=150):
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(400)]
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        rows.append((k, " ".join(w), "en"))
    return rows


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 2, 512), (2, 5, 4)])
def test_against_brute_force(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = corpus(seed) + [(1000 + k, t, x) for k, (_, t, x) in enumerate(AWKWARD)] + [(None, "w1 w2", "en"), (500, "w1 W2", "en"), (500, "w1 W2", "en")]
    got = near_dups.link_near_duplicates(awkward(spark, rows), shingle=n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_shingle_hashes_know_words():
    texts = ["a b c", "A b\x0bc", "a b", "b", "", None, "a" * 5000 + " b c", "a" * 5001 + " b c", "é b c", "ab c", "a bc", "a b c a b c"]
    for n in (1, 2, 3, 5):
        ours, theirs = [frozenset(x.tolist()) for x in near_dups.shingle_sets(texts, n, 20)], sets(texts, n)
        for a in range(len(texts)):
            for b in range(len(texts)):
                assert len(ours[a] & ours[b]) == len(theirs[a] & theirs[b]), (n, a, b)


@pytest.mark.parametrize("edges_a_task", [200_000, 30])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(near_dups, "EDGES_A_TASK", edges_a_task)
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000, int(k)) for k in range(1001, 1200)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (150, 2)) if a != b]
    got = {r.v: r.root for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(301)}) == 1 and len({got[k] for k in range(1000, 1200)}) == 1 and got[0] != got[1000]
    assert set(got) == {x for e in edges for x in e} and all(got[a] == got[b] for a, b in edges)


def test_blocks_meet_where_components_differ(spark, monkeypatch):
    """Every pair of unequal components meets in some dealt group, and the rows sent follow the size of the rest."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    comp = {v: 0 if v < 200 else v for v in range(213)} | {213: 212}
    rows = spark.createDataFrame([(5, v) for v in comp], "key long, v long")
    labels = spark.createDataFrame(list(comp.items()), "v long, root long")
    dealt, met = defaultdict(list), set()
    for r in near_dups._across(near_dups._mixed(rows, labels)).collect():
        dealt[r.key].append(r)
    for group in dealt.values():
        met |= {frozenset((a.v, b.v)) for a in group for b in group if a.comp != b.comp and (not a.apart or a.block != b.block)}
    assert met == {frozenset((a, b)) for a in comp for b in comp if comp[a] != comp[b]}
    assert sum(map(len, dealt.values())) <= 2 * 200 + 14 * 27 + 14 * 2 and max(map(len, dealt.values())) < 40
    assert near_dups._mixed(rows.where("v < 200"), labels) is None


def test_tree_count():
    assert near_dups.trees_for(0.8, 1, 0.99) == 3 and near_dups.trees_for(0.8, 5, 0.999999) > near_dups.trees_for(0.8, 2, 0.999999)


def test_stage_and_empty(spark):
    rows = [(1, "one two three four five six", "en"), (2, "ONE two three four five six", "en"), (2, "other words are these here now", "en"), (3, "one two three four five six", "en"), (None, "one two three four five six", "en"), (4, None, "en")]
    out = near_dups.drop_near_duplicates(awkward(spark, rows))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "2", "4", "None"] and out.columns == awkward(spark).columns
    assert near_dups.link_near_duplicates(empty(spark)).count() == 0 and near_dups.drop_near_duplicates(empty(spark)).count() == 0
