"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import BLANKS, fresh, hash128, staged


def _folded(line: Column) -> Column:
    """One-to-one with the line whose A-Z are lower-cased.

    lower() does that for ASCII. For other lines it would also fold other letters, so the UTF-8 bytes are
    first read as Latin-1: only lead bytes C3-DE then change, to E3-FE, and since the number of continuation
    bytes still tells which lead byte it was, different lines stay different.
    """
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.lower(F.decode(line.cast("binary"), "ISO-8859-1")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows and columns of docs, the text without its repeated lines, plus n_lines and n_dropped.

    A line's key is the line, stripped of blanks, with A-Z lower-cased. A key of min_chars or more that
    min_docs or more documents hold stays only in the document of the largest id (every occurrence there).
    Null or empty text is one empty line; a null text stays null when nothing is dropped from it. Rows that
    share an id are one document: they count once, and each row keeps the key if the id is the largest. A row
    without an id belongs to no document: its lines neither count nor go. Existing columns n_lines and
    n_dropped are replaced.

    The text is not shuffled with the lines: keys travel as 128-bit hashes with a position, counts are combined
    before their shuffle, and only positions to drop come back to a document.
    """
    row, pos, line, h1, h2, n, keep, gone = fresh(docs, "row", "pos", "line", "h1", "h2", "n", "keep", "gone")
    text, kept = F.col(f"`{text_col}`"), docs.drop(*(c for c in ("n_lines", "n_dropped") if c in docs.columns))
    id_ = F.col(f"`{id_col}`")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    stripped = F.btrim(F.col(line), F.lit(BLANKS))
    keyed = (
        kept.where(id_.isNotNull() & (F.length(text) >= min_chars))
        .select(id_.alias(keep), F.xxhash64(text).alias(row), F.posexplode(lines).alias(pos, line))
        .where(F.length(stripped) >= min_chars)
        .select(keep, row, pos, *(h.alias(x) for h, x in zip(hash128(_folded(stripped)), (h1, h2), strict=True)))
    )
    last, ids = fresh(keyed, "last", "ids")
    often = (
        keyed.select(h1, h2, keep)
        .distinct()
        .groupBy(h1, h2)
        .agg(F.count("*").alias(n), F.max(keep).alias(last))
        .where(F.col(n) >= min_docs)
        .drop(n)
    )
    often = staged(often, "lines")  # a table of known size: broadcast if small, else joined by shuffles that can be split
    drops = (
        keyed.join(often, [h1, h2])
        .where(F.col(keep) != F.col(last))
        .groupBy(keep, row)
        .agg(F.collect_set(pos).alias(gone))
        .withColumnsRenamed({keep: ids, row: last})
    )
    joined = kept.join(drops, (id_ == F.col(ids)) & (F.xxhash64(text) == F.col(last)), "left")
    stay = F.filter(lines, lambda _, i: ~F.array_contains(F.col(gone), i))
    return joined.select(
        *(F.when(F.col(gone).isNull(), text).otherwise(F.array_join(stay, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
