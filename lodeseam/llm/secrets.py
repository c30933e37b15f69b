"""Secret scans: context patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers, both from labelled samples. A token's mean ratio over
its transitions says how much more it looks like a random string. Everything runs as built-in functions.
"""

from __future__ import annotations

from collections import defaultdict
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import fresh, smallest_hashes
from lodeseam.llm.spans import located, matches, overlap, tagged

# fixed values: the patterns of the base spans
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

#: Bounds of the labelled samples: generated random strings, documents that ordinary identifiers come from, words of each.
SAMPLE_STRINGS, SAMPLE_DOCS, SAMPLE_WORDS = 3000, 1500, 400


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: int = SAMPLE_STRINGS, documents: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> DataFrame:
    """value, random: digests in hexadecimal, base 64 and capitals; and words of the documents with the smallest id hashes, those of
    the smallest hashes in each whole text, alone and joined as identifiers are: by _, -, / and +, in camel case, with digits.
    An empty table gives random strings only."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    forms = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 20)))
    positive = spark.range(strings).select(F.explode(forms).alias("value"), F.lit(True).alias("random"))
    ids = smallest_hashes(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")), documents)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t"))
    every = F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z]{4,}"), F.lit(0)))
    least = F.transform(F.slice(F.array_sort(F.transform(every, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, words), lambda s: s["x"])
    mark = F.array(*map(F.lit, "_-/+"))

    def written(x: Column, i: Column) -> Column:
        next_ = F.coalesce(F.get("w", i + 1), F.element_at("w", 1))
        split, camel, numbered = F.concat(x, F.get(mark, F.pmod(F.floor(i / 4), F.lit(4)).cast("int")), next_), F.concat(F.lower(x), F.initcap(next_)), F.concat(F.lower(x), (i % 100).cast("string"))
        return F.when(i % 4 == 0, split).when(i % 4 == 1, camel).when(i % 8 == 2, numbered).otherwise(x)

    joined = F.transform(F.col("w"), written)
    negative = some.select(least.alias("w")).where(F.size("w") > 0).select(F.explode(joined).alias("value"), F.lit(False).alias("random"))
    return positive.unionByName(negative)


def train_markov(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, at 128 * first + second; samples are rows of value and random.

    Counts are of the whole sample and come as at most 2 * 128 * 128 numbers. Characters beyond ASCII are left out.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substr("value", i, F.lit(2)))
    counted = samples.where(F.length("value") > 1).select("random", F.explode(pairs).alias("p")).where(F.length("p") == F.octet_length("p")).groupBy("random", "p").count().collect()
    count, total = defaultdict(float), defaultdict(float)
    for r in counted:
        count[r["random"], ord(r.p[0]), ord(r.p[1])] += r["count"]
        total[r["random"], ord(r.p[0])] += r["count"]
    chance = lambda kind, a, b: (count[kind, a, b] + smooth) / (total[kind, a] + 128 * smooth)
    return [log(chance(True, a, b) / chance(False, a, b)) for a in range(128) for b in range(128)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of an ASCII string of two characters or more."""
    lookup = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in table) + "]"), "array<double>")
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.element_at(lookup, code(i) * 128 + code(i + 1) + 1))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.length(token) - 1)


def find_secrets(docs: DataFrame, table: list[float] | None, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """All rows and columns of docs plus `secrets`, array<struct<first, order, last, kind>>, sorted by start, then kind.

    Base kinds: assign (a value of 12 characters or more after a telling name; the span is the whole match), access keys, hex.
    With a table of train_markov, tokens of 20 characters or more that meet no base span and whose mean ratio is over the
    threshold (nats a transition) are `markov` spans. Places are in code points, ends exclusive. Null text is empty.
    Rows are independent; a column `secrets` of docs is replaced.
    """
    docs = docs.drop("secrets")
    t, a, k, h, m, base = fresh(docs, "text", "assign", "access", "hex", "token", "base")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    t_ = F.col(t)
    found = docs.withColumn(t, text).withColumns({
        a: matches(t_, ASSIGN, t_.rlike(ASSIGN)),
        k: matches(t_, ACCESS, F.contains(t_, F.lit("AKIA"))),
        h: matches(t_, HEX, t_.rlike(HEX)),
        m: matches(t_, TOKEN, t_.rlike(TOKEN)) if table else F.lit(None).cast("struct<gaps:array<string>,values:array<string>>"),
    })
    long = lambda v: F.length(F.regexp_replace(v, ASSIGN_HEAD, "")) >= 12
    always = lambda v: F.lit(True)
    parts = [tagged(located(F.col(c), ok), kind, n) for n, (c, kind, ok) in enumerate(((a, "assign", long), (k, "access", always), (h, "hex", always)))]
    found = found.withColumn(base, F.array_sort(F.concat(*parts)))
    extra = F.array().cast("array<struct<first:int,order:int,last:int,kind:string>>")
    if table:
        new = tagged(located(F.col(m), lambda v: ratio(v, table) >= threshold), "markov", 3)
        extra = F.filter(new, lambda s: ~F.exists(F.col(base), lambda b: overlap(s, b)))
    return found.withColumn("secrets", F.array_sort(F.concat(F.col(base), extra))).drop(t, a, k, h, m, base)
