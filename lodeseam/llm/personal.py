"""Personal data: base patterns, and candidates that boosted trees accept.

Generators with high recall propose overlapping spans: addresses that are spelt out, digit groups without a country code,
identity and account numbers. Boosted trees see a candidate's format and the words before it; a threshold calibrated
on labelled candidates that were held out of training decides. On documents everything runs as built-in functions.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.boosting import BoostedTrees, calibrated
from lodeseam.llm.common import fresh
from lodeseam.llm.spans import located, matches, overlap, tagged

# The base patterns. Where the pattern starts with a run, a match can start only where the run does, or where the
# last match ended; saying so, and never giving back, keeps long runs linear and changes no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: What the candidate generators propose.
CANDIDATES = {
    "spelt": r"[A-Za-z0-9._-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,8}",
    "digits": r"\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}",
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
#: Words that announce personal data, by what follows.
CONTEXT = {"call": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp)\b", "identity": r"(?i)\b(?:ssn|social\s+security|passport|tax\s+id|identity|licen[cs]e)\b", "bank": r"(?i)\b(?:iban|account|bank|transfer)\b", "mail": r"(?i)\b(?:e-?mail|mail|write|reach|contact)\b", "other": r"(?i)\b(?:order|invoice|version|date|page|isbn|model|price|build|since|until|total|chapter)\b"}
#: Labelled candidates of each generator that training makes.
SAMPLE = 900


def _labelled(kind: str, n: int, seed: int) -> list[tuple[str, str, bool]]:
    """before, value, personal: invented from the formats that people use, and from their look-alikes."""
    rng = random.Random(f"{kind}{seed}")
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        good, filler = rng.random() < 0.5, " ".join(word() for _ in range(3))
        if kind == "spelt":
            a, d = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("[at]", ".")]), "com org net info".split()
            value = f"{word()}{rng.choice('._')}{word()}{a[0]}{word()}{a[1]}{rng.choice(d)}" if good else f"{word()} at {word()}{rng.choice(['. ', ' dot '])}{word()[:8]}"
            before = f"{filler} {rng.choice(['email', 'mail me', 'write to', 'reach', 'contact', ''])} " if good else f"{filler} "
        elif kind == "digits":
            s = rng.choice(" -.")
            if good:
                value, head = rng.choice([(s.join((digits(3), digits(3), digits(4))), ["phone:", "call", "tel.", "mobile", "fax"]), (f"({digits(3)}) {digits(3)}-{digits(4)}", ["phone:", "call", "tel.", "cell", "contact"]), (s.join(digits(2) for _ in range(5)), ["tel.", "mobile", "phone"]), (f"{digits(3)}-{digits(2)}-{digits(4)}", ["SSN", "social security number", "tax id"])])
            else:
                value, head = rng.choice([(f"20{digits(2)}-{digits(2)}-{digits(2)}", ["date", "since", "until", ""]), (f"{digits(2)}.{digits(2)}.{digits(4)}", ["date", "build", ""]), (s.join(digits(rng.randint(2, 5)) for _ in range(rng.randint(2, 5))), ["order", "invoice", "page", "isbn", "total", "", ""]), (f"{digits(2)}/{digits(2)}", ["page", ""])])
            before = f"{filler} {rng.choice(head)} "
        else:
            value = rng.choice(["DE", "FR", "GB", "ES", "IT", "NL"]) + digits(2) + rng.choice(["", " "]).join(["", *(digits(4) for _ in range(rng.randint(3, 5)))]) if good else "".join(rng.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(2)) + digits(2) + "".join(rng.choice("ABCDEFGHKLMNPRST0123456789") for _ in range(rng.choice([12, 16])))
            before = f"{filler} {rng.choice(['IBAN', 'account', 'bank transfer to', 'iban:'] if good else ['order', 'model', 'build', '', ''])} "
        out.append((before, value, good))
    return out


def features(value: Column, before: Column) -> list[Column]:
    """Numbers of a candidate's format, then of its context: the 32 characters before it."""
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: F.length(g) > 0)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    least, most = (F.coalesce(f(F.transform(groups, F.length)), F.lit(0)) for f in (F.array_min, F.array_max))
    shape = [F.length(value), digits, F.size(groups), least, most, F.length(F.regexp_replace(value, "[^ ]", "")), F.length(F.regexp_replace(value, "[^-]", "")), F.length(F.regexp_replace(value, "[^.]", "")), F.length(F.regexp_replace(value, "[^()\\[\\]]", "")), F.length(F.regexp_replace(value, "[^A-Z]", "")), F.when(value.rlike(r"^(?:19|20)[0-9]{2}[^0-9]|[^0-9](?:19|20)[0-9]{2}$"), 1).otherwise(0), F.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1).otherwise(0), F.when(value.rlike(r"[.](?:com|org|net|info|de|fr|es)$|(?:dot\x20?[\])]?\x20?)(?:com|org|net|info|de|fr|es)$"), 1).otherwise(0)]
    return [c.cast("double") for c in [*shape, *(F.when(before.rlike(p), 1).otherwise(0) for p in CONTEXT.values())]]


def train_candidates(spark: SparkSession, n: int = SAMPLE, precision: float = 0.98) -> dict[str, tuple[BoostedTrees, float]]:
    """For each generator its trees and threshold. A third of the labelled candidates is kept for calibration."""
    rows = [(kind, k, *x) for kind in CANDIDATES for k, x in enumerate(_labelled(kind, n, 1))]
    df = spark.createDataFrame(rows, "kind string, k int, before string, value string, personal boolean")
    got = df.select("kind", "k", "personal", F.array(*features(F.col("value"), F.col("before"))).alias("x")).collect()
    out = {}
    for kind in CANDIDATES:
        own = sorted((r.k, list(r.x), r.personal) for r in got if r.kind == kind)
        fit, held = [r for r in own if r[0] % 3], [r for r in own if not r[0] % 3]
        model = BoostedTrees().fit([x for _, x, _ in fit], [y for *_, y in fit])
        out[kind] = model, calibrated([model.score(x) for _, x, _ in held], [y for *_, y in held], precision)
    return out


def _luhn(digits: Column) -> Column:
    """Of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(v: Column) -> Column:
    digits = F.regexp_replace(v, "[ -]", "")
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _ip(v: Column) -> Column:
    return F.forall(F.split(v, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 2) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))


def _phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


def best_apart(spans: Column) -> Column:
    """Of spans with first, order, last and score: by descending score, then place, each that overlaps none taken so far."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("key"), s["first"].alias("first"), s["order"].alias("order"), s["last"].alias("last"), s["kind"].alias("kind"))))
    return F.aggregate(ranked, F.filter(ranked, lambda s: F.lit(False)), lambda taken, s: F.when(F.exists(taken, lambda o: overlap(s, o)), taken).otherwise(F.concat(taken, F.array(s))))


def find_personal(docs: DataFrame, models: dict[str, tuple[BoostedTrees, float]] | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs plus `personal`, array<struct<first, order, last, kind>>, sorted by kind as listed, then start.

    Base kinds: email, ip (parts at most 255), card (13 to 19 digits that pass Luhn's test), phone (9 to 15 digits). With models,
    candidates that meet no base span and score over their generator's threshold are added under its name; of those that
    overlap the highest score stays, then the first; one that only overlaps such as do not stay, stays too. Places are in code points, ends exclusive. Null text is empty. Rows are
    independent; a column `personal` of docs is replaced.
    """
    docs = docs.drop("personal")
    models = models or {}
    names = fresh(docs, "text", "base", "new", *KINDS, *models)
    t, base, new, own, cand = names[0], names[1], names[2], names[3:7], names[7:]
    t_, digit = F.col(t), F.col(t).rlike("[0-9]")
    gates = {"email": F.contains(t_, F.lit("@")), "ip": digit & t_.rlike(r"[0-9]\.[0-9]"), "card": t_.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(t_, F.lit("+"))}
    valid = {"email": lambda v: F.lit(True), "ip": _ip, "card": _card, "phone": _phone}
    found = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = found.withColumns({c: matches(t_, p, gates[k]) for c, k, p in zip(own, KINDS, (EMAIL, IP, CARD, PHONE), strict=True)} | {c: matches(t_, CANDIDATES[k], t_.rlike(CANDIDATES[k])) for c, k in zip(cand, models, strict=True)})
    parts = [tagged(located(F.col(c), valid[k]), k, n) for n, (c, k) in enumerate(zip(own, KINDS, strict=True))]
    found = found.withColumn(base, F.concat(*parts))
    if models:

        def judged(c: str, kind: str, n: int) -> Column:
            model, least = models[kind]

            def one(s: Column) -> Column:
                before = F.substring(t_, F.greatest(s["first"] - 31, F.lit(1)), F.least(s["first"], F.lit(32)))
                return F.struct(s["first"].alias("first"), F.lit(n).alias("order"), s["last"].alias("last"), F.lit(kind).alias("kind"), model.column(features(s["value"], before)).alias("score"))

            free = F.filter(located(F.col(c), lambda v: F.lit(True)), lambda s: ~F.exists(F.col(base), lambda b: overlap(s, b)))
            return F.filter(F.transform(free, one), lambda s: s["score"] >= least)

        found = found.withColumn(new, reduce(F.concat, [judged(c, k, len(KINDS) + n) for n, (c, k) in enumerate(zip(cand, models, strict=True))]))
        won = best_apart(F.col(new))
        extra = F.transform(won, lambda s: F.struct(s["first"].alias("first"), s["order"].alias("order"), s["last"].alias("last"), s["kind"].alias("kind")))
        everything = F.concat(F.col(base), extra)
    else:
        everything = F.col(base)
    keyed = F.array_sort(F.transform(everything, lambda s: F.struct(s["order"].alias("order"), s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    ordered = F.transform(keyed, lambda s: F.struct(s["first"].alias("first"), s["order"].alias("order"), s["last"].alias("last"), s["kind"].alias("kind")))
    return found.withColumn("personal", ordered).drop(*names)
