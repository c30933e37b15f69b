"""Regular-expression matches with their places, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """struct<gaps, values>: what stands between the leftmost non-overlapping matches, and they; gate says whether to look."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return F.when(gate, found)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def located(found: Column, valid: Callable[[Column], Column]) -> Column:
    """array<struct<first, last, value>> (code points, last exclusive) of the matches that pass. Only these pay for their place."""
    gaps, values = F.transform(found["gaps"], F.length), F.transform(found["values"], F.length)
    numbered = F.transform(found["values"], lambda v, i: F.struct(i.alias("i"), v.alias("v")))

    def place(x: Column) -> Column:
        first = _total(F.slice(gaps, 1, x["i"] + 1)) + _total(F.slice(values, 1, x["i"]))
        return F.struct(first.alias("first"), (first + F.length(x["v"])).alias("last"), x["v"].alias("value"))

    none = F.array().cast("array<struct<first:int,last:int,value:string>>")
    return F.coalesce(F.transform(F.filter(numbered, lambda x: valid(x["v"])), place), none)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """array<struct<first, order, last, kind>>, fit for sorting and joining of several kinds."""
    return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), F.lit(order).alias("order"), s["last"].alias("last"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlap(a: Column, b: Column) -> Column:
    return (a["first"] < b["last"]) & (b["first"] < a["last"])


def redacted(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """text with each span replaced by its kind; of overlapping spans the one that starts first counts."""
    before, after = mark.split("{}")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, s["first"] - a["at"]), F.lit(before), s["kind"], F.lit(after))
        return F.when(s["first"] >= a["at"], F.struct(more.alias("out"), s["last"].alias("at"))).otherwise(a)

    return F.aggregate(F.array_sort(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
