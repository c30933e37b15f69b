"""The knowledge graph: entities and evidence-linked edges from a controlled vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions import vocab
from lodeseam.functions.text import lower_ascii
from lodeseam.scratch import settled

# Confidences by tier, the body's scan length, predicates.
HEADING, METADATA, BODY, TOGETHER, STRUCTURAL = 0.9, 0.75, 0.6, 0.5, 1.0
BODY_CHARS = 500_000
INTO_CASE = {"technique": "demonstrated_in", "tool": "used_in", "service": "present_in"}


def mentions(docs: DataFrame, chunks: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, kind, term, tier (2 heading, 1 metadata, 0 body) for all terms of a document.

    docs: doc_id, title, and arrays services, techniques, tools where known. Headings are the title and all section paths of the
    document's chunks, the body its chunks in order up to BODY_CHARS characters. Terms of the metadata are not checked.
    """
    vocabulary = vocabulary or vocab.VOCABULARY
    body = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text", "section_path"))).alias("l"))
    full = docs.join(body, "doc_id", "left").withColumns({
        "body": F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 1, BODY_CHARS),
        "head": F.concat_ws("\n", "title", F.array_join(F.flatten(F.transform("l", lambda x: x["section_path"])), "\n")),
    })
    tiers = []
    for kind, terms in vocabulary.items():
        column = f"{kind}s"
        known = F.transform(F.col(column), F.lower) if column in docs.columns else F.array().cast("array<string>")
        for tier, found in ((2, vocab.found_terms(F.col("head"), terms)), (1, F.coalesce(known, F.array().cast("array<string>"))), (0, vocab.found_terms(F.col("body"), terms))):
            tiers.append(_tagged(found, kind, tier))
    rows = full.select("doc_id", F.explode(F.flatten(F.array(*tiers))).alias("m"))
    return rows.groupBy("doc_id", "m.kind", "m.term").agg(F.max("m.tier").alias("tier"))


def _tagged(terms: Column, kind: str, tier: int) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), F.lit(tier).alias("tier")))


def is_case(docs: DataFrame, case_sources: list[str], markers: list[str] | None = None) -> Column:
    """Of a case source, of a case category, or with a case's name or kind in its metadata."""
    out = F.col("source_id").isin(case_sources) if case_sources else F.lit(False)
    out = out | vocab.is_case_category(F.col("categories"), markers)
    if "machine_name" in docs.columns:
        out = out | (F.coalesce(F.col("machine_name"), F.lit("")) != "")
    if "kind" in docs.columns:
        out = out | ~F.coalesce(F.col("kind"), F.lit("")).isin("", "unknown")
    return F.coalesce(out, F.lit(False))


def edges(docs: DataFrame, chunks: DataFrame, vocabulary: dict[str, list[str]] | None = None, case_sources: list[str] | None = None, markers: list[str] | None = None) -> DataFrame:
    """subject, subject_type, predicate, object, object_type, doc_id (evidence), confidence, inferred; one for each of the first six.

    docs also needs source_id, source_name, categories. Nothing relates to itself.
    """
    m = mentions(docs, chunks, vocabulary)
    has_os = "os" in docs.columns
    facts = docs.select("doc_id", "title", F.coalesce("source_name", "source_id").alias("source_name"), (F.col("os") if has_os else F.lit(None).cast("string")).alias("os"), is_case(docs, case_sources or [], markers).alias("case"))
    both = m.join(facts, "doc_id")
    confidence = F.when(F.col("tier") == 2, HEADING).when(F.col("tier") == 1, METADATA).otherwise(BODY)

    def edge(df: DataFrame, s, st, p, o, ot, c, inferred: bool) -> DataFrame:
        return df.select(s.alias("subject"), st.alias("subject_type"), p.alias("predicate"), o.alias("object"), ot.alias("object_type"), "doc_id", c.cast("double").alias("confidence"), F.lit(inferred).alias("inferred"))

    lit, col = F.lit, F.col
    into = F.create_map(*(lit(x) for pair in INTO_CASE.items() for x in pair))
    t = m.where("kind = 'technique'").select("doc_id", col("term").alias("technique"))
    beside = t.join(m.where("kind <> 'technique'"), "doc_id")
    parts = [
        edge(facts.where("case"), col("title"), lit("writeup"), lit("documented_by"), col("source_name"), lit("source"), lit(STRUCTURAL), False),
        edge(facts.where("case AND coalesce(os, '') <> ''"), col("title"), lit("writeup"), lit("runs_on"), col("os"), lit("os"), lit(STRUCTURAL), False),
        edge(both.where("case"), col("term"), col("kind"), into[col("kind")], col("title"), lit("writeup"), confidence, True),
        edge(both.where("kind = 'technique'"), col("term"), lit("technique"), lit("documented_by"), col("source_name"), lit("source"), F.when(col("tier") == 2, HEADING).otherwise(BODY), True),
        edge(beside, col("technique"), lit("technique"), F.when(col("kind") == "tool", "uses").otherwise("targets"), col("term"), col("kind"), lit(TOGETHER), True),
    ]
    key = ["subject", "subject_type", "predicate", "object", "object_type", "doc_id"]
    every = reduce(DataFrame.unionByName, parts).where("NOT (subject = object AND subject_type = object_type)")
    return every.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.min("inferred").alias("inferred"))


def entities(docs: DataFrame, chunks: DataFrame, vocabulary: dict[str, list[str]] | None = None, case_sources: list[str] | None = None, markers: list[str] | None = None) -> DataFrame:
    """name, entity_type, description, doc_id (of a writeup: its first document), one for each name and type; entity_id in that order."""
    m = mentions(docs, chunks, vocabulary).select(F.col("term").alias("name"), F.col("kind").alias("entity_type"), F.lit("").alias("description"), F.lit(None).cast("long").alias("doc_id"))
    case = docs.where(is_case(docs, case_sources or [], markers))
    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in docs.columns else F.lit("")
    parts = [m, docs.select(F.coalesce("source_name", "source_id").alias("name"), F.lit("source").alias("entity_type"), F.concat(F.lit("source:"), F.col("source_id")).alias("description"), F.lit(None).cast("long").alias("doc_id")), case.select(F.col("title").alias("name"), F.lit("writeup").alias("entity_type"), summary.alias("description"), F.col("doc_id").cast("long").alias("doc_id"))]
    if "os" in docs.columns:
        parts.append(case.where("coalesce(os, '') <> ''").select(F.col("os").alias("name"), F.lit("os").alias("entity_type"), F.lit("").alias("description"), F.lit(None).cast("long").alias("doc_id")))
    first = F.min(F.struct("doc_id", "description")).alias("f")
    return reduce(DataFrame.unionByName, parts).groupBy("name", "entity_type").agg(first).select("name", "entity_type", "f.description", "f.doc_id")


def with_ids(frame: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Ids from 1 in the given order. The count of entities is bounded by the vocabulary, the sources and the cases' titles; a range
    sort with offsets by partition numbers them without one task for all."""
    ordered = frame.orderBy(*order)
    # settled: a second evaluation of a range sort may draw other ranges
    numbered = settled(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("c"), F.min("_m").alias("first")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = numbered.join(F.broadcast(sizes.drop("c")), "_p").withColumn(id_col, F.col("before") + F.col("_m") - F.col("first") + 1)
    return out.drop("_p", "_m", "first", "before").select(id_col, *frame.columns)


def graph_stats(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """what, name, n: counts of entities by type and of edges by predicate."""
    a = ents.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), "name", "n")
    return a.unionByName(rels.groupBy(F.col("predicate").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n"))


def neighbours(rels: DataFrame, name: str, entity_type: str | None = None, predicate: str | None = None) -> DataFrame:
    """Edges of an entity in both directions: direction, other, other_type, predicate, confidence, inferred, doc_id."""
    e = rels if predicate is None else rels.where(F.col("predicate") == predicate)

    def side(own: str, other: str, direction: str) -> DataFrame:
        hit = F.col(own) == name if entity_type is None else (F.col(own) == name) & (F.col(f"{own}_type") == entity_type)
        return e.where(hit).select(F.lit(direction).alias("direction"), F.col(other).alias("other"), F.col(f"{other}_type").alias("other_type"), "predicate", "confidence", "inferred", "doc_id")

    return side("subject", "object", "out").unionByName(side("object", "subject", "in")).orderBy(F.desc("confidence"), "direction", "predicate", "other", "doc_id")


def find_entities(ents: DataFrame, like: str, entity_type: str | None = None) -> DataFrame:
    """Names with the given part, whatever the case of ASCII letters; no wildcards."""
    hit = F.contains(lower_ascii(F.col("name")), lower_ascii(F.lit(like)))
    return ents.where(hit if entity_type is None else hit & (F.col("entity_type") == entity_type)).orderBy("entity_type", "name")


def doc_techniques(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """doc_id, techniques of the writeups' own documents (a title that several share counts for the first only)."""
    case = ents.where("entity_type = 'writeup'").select(F.col("name").alias("object"), F.col("doc_id").alias("of"))
    hit = rels.where("predicate = 'demonstrated_in' AND subject_type = 'technique'").join(case, "object")
    return hit.groupBy(F.col("of").alias("doc_id")).agg(F.array_sort(F.collect_set("subject")).alias("techniques"))
