"""Structure-aware chunking.

Lines are exploded with their position and a few windows over a document's lines find fences, chunk starts and the heading
in force at each level; a group by (document, chunk) puts the text together. One shuffle, by document, serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import BUDGET, SPACE, TOKENS_PER_WORD, hard_split, lines, strip, token_estimate

HEADING = r"^(#{1,6})[\s\x1c-\x1f]+(.*?)[\s\x1c-\x1f]*#*[\s\x1c-\x1f]*$"
MAX_WORDS = int(BUDGET / TOKENS_PER_WORD)


def _groups(parts: Column, budget: int) -> Column:
    """Lines put together at blank lines that come once a group is full; only an unclosed fence has such lines."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        t = token_estimate(line)
        full = (F.size(a["cur"]) > 0) & (a["n"] + t > budget) & (strip(line) == "")
        closed = F.struct(F.concat(a["out"], F.array(F.array_join(a["cur"], "\n"))).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
        grown = F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(line)).alias("cur"), (a["n"] + t).alias("n"))
        return F.when(full, closed).otherwise(grown)

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["out"]))


def markdown_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, budget: int = BUDGET) -> DataFrame:
    """id, ordinal, text, section_path, kind (text or code), token_estimate of the chunks of each document.

    A chunk ends at a fence's opening or closing, before a heading, at a blank line and at the end. Headings start the next
    chunk and replace those of their own level or deeper. Oversized chunks are split only at a blank line or the end.
    path_col, an array, comes before the headings. Null text has no chunks; ids must be unique.
    """
    base = F.coalesce(F.col(path_col), F.array().cast("array<string>")) if path_col else F.array().cast("array<string>")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), base.alias("base"), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    w = Window.partitionBy("id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = strip(F.col("line")).startswith("```")
    n = F.sum(fence.cast("int")).over(upto)
    kind = F.when(fence & (n % 2 == 1), "open").when(fence, "close").when(n % 2 == 1, "code").when(F.col("line").rlike(HEADING), "heading").when(strip(F.col("line")) == "", "blank").otherwise("text")
    rows = rows.withColumn("type", kind).withColumn("level", F.when(F.col("type") == "heading", F.length(F.regexp_extract("line", HEADING, 1))))
    before = F.lag("type").over(w)
    starts = F.col("type").isin("open", "heading") | F.coalesce(before.isin("blank", "close"), F.lit(True))
    title = F.struct(F.col("pos"), strip(F.regexp_extract("line", HEADING, 2)).alias("t"))
    rows = rows.withColumn("cid", F.sum(starts.cast("int")).over(upto)).withColumns({f"h{k}": F.last(F.when(F.col("level") == k, title), ignorenulls=True).over(upto) for k in range(1, 7)})
    rows = rows.withColumn("end", F.coalesce(F.lead("type").over(w), F.lit("end")))

    def visible(k: int) -> Column:
        own = F.col(f"h{k}")
        return F.when(own.isNotNull() & (own["pos"] > F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"h{j}")["pos"], F.lit(-1)) for j in range(1, k)))), own["t"])

    path = F.concat(F.col("base"), F.filter(F.array(*(visible(k) for k in range(1, 7))), lambda t: t.isNotNull()))
    body = rows.where("type <> 'blank' ").withColumn("path", path)
    chunks = body.groupBy("id", "cid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line", "type", "end"))).alias("l"), F.max_by("path", "pos").alias("path"), F.max_by("base", "pos").alias("base")
    )
    parts, last = F.transform("l", lambda x: x["line"]), F.element_at("l", -1)
    coded = F.col("l")[0]["type"].isin("open")
    joined = F.array_join(parts, "\n")
    splits = last["end"].isin("blank", "end") & (last["type"] != "close") & (token_estimate(joined) > budget)
    pieces = F.when(~splits, F.array(joined)).when(coded, F.flatten(F.transform(_groups(parts, budget), lambda g: hard_split(g, budget)))).otherwise(hard_split(joined, budget))
    pieces = F.filter(F.transform(pieces, strip), lambda p: p != "")
    out = chunks.select("id", "cid", "path", F.when(coded, "code").otherwise("text").alias("kind"), F.posexplode(pieces).alias("part", "text"))
    order = Window.partitionBy("id").orderBy("cid", "part")
    return out.select(F.col("id").alias(id_col), (F.row_number().over(order) - 1).alias("ordinal"), "text", F.col("path").alias("section_path"), "kind", token_estimate(F.col("text")).alias("token_estimate"))


def packed_pages(text: Column, budget: int = BUDGET) -> Column:
    """Paragraphs of a page packed in order up to the budget; a larger paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        t = token_estimate(p)
        full = F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), p.alias("cur"), t.alias("n"))
        more = F.struct(a["out"].alias("out"), F.when(a["n"] == 0, p).otherwise(F.concat(a["cur"], F.lit("\n"), p)).alias("cur"), (a["n"] + t).alias("n"))
        return F.when((a["n"] > 0) & (a["n"] + t > budget), full).otherwise(more)

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def page_chunks(pages: DataFrame, id_col: str, page_col: str, text_col: str = "text", headings_col: str | None = None, code_col: str | None = None, budget: int = BUDGET) -> DataFrame:
    """id, ordinal, page, text, section_path, kind. With headings_col (an array) the first heading of the latest page that has one is
    the section; with code_col (an array) each distinct block of a page, in order, is a fenced chunk after the page's text."""
    head = F.get(F.col(headings_col), F.lit(0)) if headings_col else F.lit(None).cast("string")
    w = Window.partitionBy("id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    code = F.filter(F.array_distinct(F.coalesce(F.col(code_col), F.array().cast("array<string>"))), lambda b: b != "") if code_col else F.array().cast("array<string>")
    rows = pages.select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), head.alias("h"), code.alias("c"))
    rows = rows.withColumn("section", F.last("h", ignorenulls=True).over(w)) if headings_col else rows.withColumn("section", F.col("h"))
    kinds = F.concat(F.transform(packed_pages(F.col("t"), budget), lambda p: F.struct(p.alias("text"), F.lit("text").alias("kind"))), F.transform("c", lambda b: F.struct(strip(F.concat(F.lit("```\n"), b, F.lit("\n```"))).alias("text"), F.lit("code").alias("kind"))))
    parts = rows.select("id", "page", "section", F.posexplode(kinds).alias("k", "x"))
    order = Window.partitionBy("id").orderBy("page", "k")
    path = F.when(F.col("section").isNull(), F.array().cast("array<string>")).otherwise(F.array("section"))
    return parts.select(F.col("id").alias(id_col), (F.row_number().over(order) - 1).alias("ordinal"), F.col("page").alias(page_col), "x.text", path.alias("section_path"), "x.kind")


def plain_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """All columns but the text, with ordinal and the text of each part. No shuffle."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(hard_split(F.coalesce(F.col(text_col), F.lit("")), budget)).alias("ordinal", text_col))
