import numpy as np
from helpers import AWKWARD, awkward, empty

from lodeseam.llm import decontaminate, line_dedup, queries
from tests.compare import same
from tests.conftest import SF

SF1 = "/root/testdata/sf0.01"


def test_sql(spark):
    for name, sql in queries.oracle_sql().items():
        ok, said = same(spark, SF, queries.queries()[name], sql)
        assert ok, (name, said)


def test_lines(spark):
    line = "A line that is repeated, and long enough to count É"
    rows = [(k, f"\t {line.upper().replace('É', 'É')} \r\nown {k}\n{line}", "en") for k in range(4)] + [(9, line + "\n", "en")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert out[0].text == "own 0" and (out[0].n_lines, out[0].n_dropped) == (3, 2)
    assert out[9].text == line + "\n" and out[9].n_dropped == 0
    rows[0] = (0, rows[0][1].replace("É", "é"), "en")  # other letters keep their case: four documents only
    assert {r.n_dropped for r in line_dedup.dedup_lines(awkward(spark, rows[:4] + [(9, "x", "en")])).collect()} == {0}


def test_lines_awkward(spark):
    df = line_dedup.dedup_lines(awkward(spark), min_docs=1)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == [*awkward(spark).columns, "n_lines", "n_dropped"]
    assert {r.text for r in rows if r.doc_id == 1} == {None} and {r.n_lines for r in rows if r.doc_id in (1, 2)} == {1}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute(words, items, window):
    hit, met = set(), set()
    for key, item in items:
        m = min(window, len(item))
        for w in {tuple(item[k : k + m]) for k in range(len(item) - m + 1)} if item else ():
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) == w:
                    hit.update(range(i, i + m))
                    met.add(key)
    return hit, met


def test_automaton_against_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(150):
        letters = [b"a", b"b", b"c"][: 2 + trial % 2]
        items = [(k, [letters[x] for x in rng.integers(0, len(letters), rng.integers(0, 9))]) for k in range(rng.integers(0, 5))]
        words = [[*letters, b"z"][x] for x in rng.integers(0, len(letters) + 1, rng.integers(0, 60))]
        window = int(rng.integers(1, 6))
        longest, spans, met = decontaminate.SuffixAutomaton(items, window).scan(words)
        hit, want = brute(words, items, window)
        assert {p for s, e in spans for p in range(s, e)} == hit and met == want
        some = {tuple(i[a:b]) for _, i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        assert longest == max((b - a for a in range(len(words)) for b in range(a + 1, min(len(words), a + 9) + 1) if tuple(words[a:b]) in some), default=0)


def test_blocks_and_awkward(spark, monkeypatch):
    items = spark.createDataFrame([(1, "tie ONE two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "École"), (None, "x"), (4, "école")], "item_id long, text string")
    whole = sorted(decontaminate.find_contamination(awkward(spark), items).collect(), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    monkeypatch.setattr(decontaminate, "AUTOMATA", 1)
    assert sorted(decontaminate.find_contamination(awkward(spark), items).collect(), key=repr) == whole
    by = {r.doc_id: r.found for r in whole}
    assert (by[7].n_hit, by[7].item_ids, by[3].n_hit, by[3].item_ids, by[1].n_words, by[6].n_words) == (11, [1], 1, [], 0, 30_000)
    assert decontaminate.find_contamination(empty(spark), items).count() == 0
    assert decontaminate.find_contamination(awkward(spark), items.limit(0)).where("found.n_hit > 0").count() == 0


def test_removal(spark):
    items = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")], "item_id long, text string")
    passage = "Q1, q2 q3-q4 q5 q6 q7 q8 q9 q10"
    rows = [(1, f"{'clean words ' * 9}{passage} end.", "en"), (2, passage, "en"), *AWKWARD]
    out = decontaminate.remove_contamination(awkward(spark, rows), items).collect()
    assert len(out) == len(rows) - 1 and {r.text for r in out if r.doc_id == 1} == {"clean words " * 9 + "  end.", None}
