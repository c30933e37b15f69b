"""Text functions as Column expressions: all JVM-side, usable in any plan."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token budget arithmetic, token patterns, snippet window.
TOKENS_PER_WORD = 1.33
BUDGET = 400
QUERY_TOKEN = r"[a-z0-9][a-z0-9_+\-\.]*"
SNIPPET_WIDTH = 400
#: White space as Python's str methods know it; a line's end as str.splitlines does.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, even where a lambda of body looks at it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int"))


def lines(text: Column) -> Column:
    """As str.splitlines: no empty line after a last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query_tokens(query: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(QUERY_TOKEN), F.lit(0)))


def normalized(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct shingles of n words of the normalized text; of fewer words one shingle, of none nothing."""
    tokens = F.filter(F.split(normalized(text), " "), lambda w: w != "")

    def grams(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def snippet(text: Column, query: Column, width: int = SNIPPET_WIDTH) -> Column:
    """A window of `width` characters that begins a third of it before the first hit of any query token."""
    hits = let(F.lower(text), lambda low: F.filter(F.transform(query_tokens(query), lambda t: F.instr(low, t)), lambda p: p > 0))
    first = F.coalesce(F.array_min(hits) - 1, F.lit(0))
    start = F.greatest(first - width // 3, F.lit(0))
    end = F.least(start + width, F.length(text))
    body = strip(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those letters; from the Unicode tables."""
    pairs = []
    for c in map(chr, range(0x80, min(sys.maxunicode, 0x2000))):
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c and unicodedata.category(c).startswith("L"):
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    low = F.lower(text)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, *_folds()))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def strip_front_matter(text: Column) -> Column:
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\n+", "")).otherwise(text)


def markdown_title(body: Column) -> Column:
    """Of the first line that is not blank, if it is a heading of the first level; else null."""
    first = F.filter(F.transform(lines(body), strip), lambda s: s != "")[0]
    return F.when(first.startswith("# "), strip(F.substring(first, 3, F.length(first))))


def humanize(slug: Column) -> Column:
    """As str.title of the slug with blanks: a letter is a capital where no letter is before it."""
    plain = strip(F.translate(slug, "-_", "  "))
    return let(F.split(F.lower(plain), ""), lambda letters: F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), ""))


def page_url(base: str, rel: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.translate(rel, "\\", "/"), r"\.md$", ""))


TITLE_PREFIX = r"(?i)^(HTB|PG|OSCP|VulnHub|TryHackMe|HackTheBox)\s*[:\-]\s*"


def title_split(title: Column) -> Column:
    """struct<name, kind> of titles such as `PG: name`."""
    kind = F.lower(F.regexp_extract(title, TITLE_PREFIX, 1))
    name = strip(F.regexp_replace(title, TITLE_PREFIX, ""))
    named = F.when(kind != "", F.when(name != "", name))
    return F.struct(named.alias("name"), F.when(kind == "hackthebox", "htb").when(kind == "", "unknown").otherwise(kind).alias("kind"))


def json_list(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def hard_split(text: Column, budget: int = BUDGET) -> Column:
    """Parts of a text without structure: itself, stripped, within the budget; else runs of words joined by one blank."""
    size = max(1, int(budget / TOKENS_PER_WORD))

    def split(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(TOKENS_PER_WORD)).cast("int")) <= budget, F.array(strip(text))).otherwise(runs)

    return F.filter(let(words(text), split), lambda p: p != "")
