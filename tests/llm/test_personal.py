import hashlib
import re

from helpers import awkward, empty

from lodeseam.llm import personal, queries
from tests.conftest import SF

# fixed values: the contract's patterns, as they are given
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


PASS = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 9 <= len(digits(x)) <= 15}


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if PASS[k](m[0])]


TRICKY = [
    "a@b.c_x@y.z, p@q@r.st -.@--.- é𝒳 me.you+tag@mail.example.co.uk. x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.255.0 12.34.5 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12 3-4 49927398716 6011000990139424",
    "+33 6 12 34 56 78, +1 (555) 010-9999. +12 +1234567890123456 ++49 30 1234567-",
    "", "1" * 30_000, "a." * 15_000 + "@", "x@" + "a." * 9000 + "b", "+1" + " " * 9000, "1.1.1.1" * 900,
]


def test_base(spark):
    rows = [(k, t, "en") for k, t in enumerate(TRICKY)]
    for r in personal.find_personal(awkward(spark, rows), None).collect():
        assert [(s.kind, s.first, s.last) for s in r.personal] == brute(r.text), r.text[:80]
    assert sum(len(brute(t)) for t in TRICKY) > 15


def test_op9_query(spark):
    got = {r.doc_id: r for r in queries.op9_personal(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, x = brute(r.text), got[r.doc_id]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert x.spans.split(",")[: len(want)] == [f"{k}:{s}:{e}" for k, s, e in want] or not want


def test_candidates(spark):
    models = personal.train_candidates(spark)
    for kind, (model, least) in models.items():
        fresh = personal._labelled(kind, 300, 99)
        df = spark.createDataFrame([(k, *x) for k, x in enumerate(fresh)], "k int, before string, value string, personal boolean")
        s = df.withColumn("s", model.column(personal.features(df.value, df.before))).collect()
        taken = [r.personal for r in s if r.s >= least]
        assert len(taken) > 90 and sum(taken) >= 0.95 * len(taken), (kind, len(taken), sum(taken))
        assert all(abs(r.s - model.score(x)) < 1e-6 for r, x in zip(s, [list(map(float, y.x)) for y in df.select(__import__("pyspark").sql.functions.array(*personal.features(df.value, df.before)).alias("x")).collect()], strict=True))
    text = "please call 555-010-9999 now, SSN 123-45-6789; order 12-34-56 on 2021-03-04. mail jo.doe(at)example(dot)org"
    r = personal.find_personal(awkward(spark, [(1, text, "en")]), models).first()
    assert {text[s.first : s.last] for s in r.personal} == {"555-010-9999", "123-45-6789", "jo.doe(at)example(dot)org"}


def test_awkward(spark):
    models = personal.train_candidates(spark, 60)
    assert personal.find_personal(awkward(spark), models).count() == 10 and personal.find_personal(empty(spark), models).count() == 0


def test_a_loser_keeps_none_out(spark):
    # a-b-c: b overlaps both others and loses to c, so a stays
    made = [(0, 10, 0.7, "digits"), (5, 25, 0.8, "account"), (20, 30, 0.9, "digits"), (40, 50, 0.7, "digits"), (40, 50, 0.7, "account")]
    rows = [([{"first": f, "order": n, "last": t, "kind": k, "score": x} for n, (f, t, x, k) in enumerate(made)],), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<first: int, order: int, last: int, kind: string, score: double>>")
    got = [sorted((x["first"], x["order"]) for x in r.w) for r in df.select(personal.best_apart(df.s).alias("w")).collect()]
    assert got == [[(0, 0), (20, 2), (40, 3)], []]
