"""Merging of lexical and dense hits, metadata-aware reranking and greedy diversity, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions import vocab
from lodeseam.functions.text import jaccard, let, query_tokens, shingles
from lodeseam.operators.lexical import TIE_DIGITS, bm25, top
from lodeseam.operators.vector import cosine_hits

# Weights and bonuses, thresholds, limits.
AUTHORITY = {"official": 1.0, "trusted": 0.9, "user": 0.75}
OTHER_AUTHORITY = 0.6
OVERLAP, PLATFORM, CATEGORY, INTENT = 0.25, 0.15, 0.15, 0.30
NEAR = 0.9
DEFAULT_LIMIT, MOST, PER_DOCUMENT, LEAST_POOL = 8, 50, 2, 30
LEXICAL_MODES = ("keyword", "hybrid", "technique", "case_similarity")
SEMANTIC_MODES = ("semantic", "hybrid")


def clamp(limit: Column) -> Column:
    return F.least(F.when(F.coalesce(limit, F.lit(0)) == 0, DEFAULT_LIMIT).otherwise(limit), F.lit(MOST))


def pool(limit: Column) -> Column:
    return F.greatest(clamp(limit) * 3, F.lit(LEAST_POOL))


def merged(lexical: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """query_id, chunk_id, score, merge_pos: for each chunk the higher score, the lexical one at ties; lexical hits come first.

    Both sides have query_id, chunk_id, score, rank; a pool is a few dozen rows a query.
    """
    hits = lexical.select("query_id", "chunk_id", "score", "rank", F.lit(0).alias("backend"))
    if semantic is not None:
        hits = hits.unionByName(semantic.select("query_id", "chunk_id", "score", "rank", F.lit(1).alias("backend")))
    place = F.min(F.struct("backend", "rank"))
    out = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), place.alias("place"))
    w = Window.partitionBy("query_id").orderBy("place", "chunk_id")
    return out.withColumn("merge_pos", F.row_number().over(w)).drop("place")


def heading_text(title: Column, path: Column) -> Column:
    return F.concat(title, F.lit(" "), F.array_join(path, " "))


def keyword_overlap(query: Column, title: Column, path: Column) -> Column:
    """Share of the distinct query tokens that occur in title and headings, as substrings."""
    tokens = query_tokens(query)
    met = let(F.lower(heading_text(title, path)), lambda hay: F.size(F.filter(tokens, lambda t: F.contains(hay, t))))
    return F.when(F.size(tokens) > 0, met / F.greatest(F.size(tokens), F.lit(1))).otherwise(0.0)


def authority_factor(authority: Column) -> Column:
    out = F.lit(OTHER_AUTHORITY)
    for name, weight in AUTHORITY.items():
        out = F.when(authority == name, weight).otherwise(out)
    return out


def metadata_bonus(own: Column, platform: Column, categories: Column) -> Column:
    low = F.transform(F.coalesce(own, F.array().cast("array<string>")), F.lower)
    wanted = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    a = F.when(F.coalesce(F.lower(platform), F.lit("")) != "", F.when(F.array_contains(low, F.lower(platform)), PLATFORM).otherwise(0.0)).otherwise(0.0)
    return a + F.when(F.coalesce(F.arrays_overlap(low, wanted), F.lit(False)), CATEGORY).otherwise(0.0)


def intent_bonus(mode: Column, own: Column, title: Column, path: Column, techniques: list[str] | None = None, markers: list[str] | None = None) -> Column:
    case = (mode == "case_similarity") & vocab.is_case_category(own, markers)
    about = F.size(vocab.found_terms(heading_text(title, path), vocab.TECHNIQUES if techniques is None else techniques)) > 0
    return F.when(F.coalesce(case | ((mode == "technique") & about), F.lit(False)), INTENT).otherwise(0.0)


def rerank_scores(hits: DataFrame, techniques: list[str] | None = None, markers: list[str] | None = None) -> DataFrame:
    """hits with query, mode, platform, wanted_categories, title, section_path, authority, categories, score: adds bonus and final."""
    bonus = OVERLAP * keyword_overlap(F.col("query"), F.col("title"), F.col("section_path")) + metadata_bonus(F.col("categories"), F.col("platform"), F.col("wanted_categories")) + intent_bonus(F.col("mode"), F.col("categories"), F.col("title"), F.col("section_path"), techniques, markers)
    return hits.withColumn("bonus", bonus).withColumn("final", F.col("score") * authority_factor(F.col("authority")) * (1.0 + F.col("bonus")))


def diversified(hits: DataFrame, per_document: int = PER_DOCUMENT, near: float = NEAR) -> DataFrame:
    """query_id, chunk_id, final, rank: in order of final, a hit is taken unless its document is full or it is nearly one taken.

    hits has query_id, doc_id, chunk_id, final, merge_pos, text, limit. A query's pool is bounded by the limits, so it is folded
    within one row; hits that are not taken neither fill a document nor keep others out.
    """
    row = F.struct((-F.round("final", TIE_DIGITS)).alias("key"), "merge_pos", "chunk_id", "doc_id", F.col("final").alias("exact"), shingles(F.col("text")).alias("grams"))
    pools = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("l"), F.max("limit").alias("limit"))
    none = F.filter(F.col("l"), lambda x: F.lit(False))

    def step(taken: Column, x: Column) -> Column:
        full = F.size(F.filter(taken, lambda t: t["doc_id"] == x["doc_id"])) >= per_document
        close = F.exists(taken, lambda t: jaccard(t["grams"], x["grams"]) >= near)
        return F.when((F.size(taken) >= F.col("limit")) | full | close, taken).otherwise(F.concat(taken, F.array(x)))

    folded = pools.select("query_id", F.posexplode(F.aggregate("l", none, step)).alias("pos", "x"))
    return folded.select("query_id", "x.chunk_id", F.col("x.exact").alias("final"), (F.col("pos") + 1).alias("rank"))


def search(chunks: DataFrame, tokens: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, encoder=None, sources: DataFrame | None = None, techniques: list[str] | None = None, markers: list[str] | None = None, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The whole retrieval of a batch of queries as one plan.

    chunks: chunk_id, doc_id, source_id, title, section_path, text, authority, categories. queries: query_id, query and, where
    given, mode, platform, categories, limit. `sources` (query-independent source_id rows) filters hits but no statistics; an
    empty one lets nothing through. With vectors (chunk_id, vector) and an encoder, semantic and hybrid queries use them.
    Texts and metadata are joined to the pools only, after scoring.
    """
    have = set(queries.columns)
    q = queries.select("query_id", "query", *(F.col(c).alias(n) if c in have else F.lit(d).cast(t).alias(n) for c, n, d, t in (("mode", "mode", "hybrid", "string"), ("platform", "platform", None, "string"), ("categories", "wanted_categories", None, "array<string>"), ("limit", "limit", None, "int"))))
    q = q.withColumn("pool", pool(F.col("limit"))).withColumn("limit", clamp(F.col("limit")))
    allowed = None if sources is None else chunks.join(sources.select("source_id"), "source_id", "left_semi").select("chunk_id")
    lexical_q = q.where(F.col("mode").isin(*LEXICAL_MODES))
    hits = bm25(tokens, lexical_q, allowed).join(F.broadcast(q.select("query_id", "pool")), "query_id")
    lexical = top(hits, F.col("pool"))
    semantic = None
    if vectors is not None and encoder is not None:
        own = vectors if allowed is None else vectors.join(allowed, "chunk_id", "left_semi")
        asked = q.where(F.col("mode").isin(*SEMANTIC_MODES) & (F.trim("query") != "")).select("query_id", encoder(F.col("query")).alias("vector"))
        dense = cosine_hits(own, asked, MOST * 3).join(F.broadcast(q.select("query_id", "pool")), "query_id")
        semantic = dense.where(F.col("rank") <= F.col("pool"))
    found = merged(lexical, semantic).join(q, "query_id").join(chunks.select("chunk_id", "doc_id", "source_id", "title", "section_path", "text", "authority", "categories"), "chunk_id")
    scored = rerank_scores(found, techniques, markers)
    best = diversified(scored, per_document)
    return best.join(scored.drop("final", "merge_pos", "pool", "limit"), ["query_id", "chunk_id"])
