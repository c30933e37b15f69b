"""Lexical retrieval: an inverted index as DataFrames and BM25 over phrases.

A batch of queries is scored in one plan. Query phrases are the small side (checked before they are broadcast), so the scan of
the token table yields only occurrences of them, shuffled once, by chunk: counts, weights and sums of a chunk stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import index_tokens, query_tokens

#: BM25 parameters and the floor of the inverse document frequency.
K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Scores that agree to so many digits are ties: sums of the same terms in another order must not change a ranking.
TIE_DIGITS = 9
#: Phrases of a query batch up to which they are broadcast.
BROADCAST_PHRASES = 200_000
FIELDS = ("title", "section", "text")


def token_table(chunks: DataFrame) -> DataFrame:
    """chunk_id, tokens of each field, dl. chunks has chunk_id, title, section_path (an array), text; of the path only the last heading counts."""
    section = F.try_element_at("section_path", F.lit(-1))
    cols = {"title": F.col("title"), "section": section, "text": F.col("text")}
    out = chunks.select("chunk_id", *(index_tokens(c).alias(f) for f, c in cols.items()))
    return out.withColumn("dl", sum((F.size(f) for f in FIELDS), F.lit(0)))


def postings(tokens: DataFrame) -> DataFrame:
    """term, chunk_id, tf over all fields."""
    return tokens.select("chunk_id", F.explode(F.concat(*FIELDS)).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def compacted(index: DataFrame, parts: int | None = None) -> DataFrame:
    """Postings in ranges of terms, sorted, so a reader skips row groups by their least and greatest term."""
    n = parts or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(n, "term").sortWithinPartitions("term", "chunk_id")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("total"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, n (number of the phrase), phrase: each query token, split again as the index splits text."""
    p = queries.select("query_id", F.posexplode(F.transform(query_tokens(F.col("query")), index_tokens)).alias("n", "phrase"))
    return p.where(F.size("phrase") > 0)


def matches(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """chunk_id, dl, phrase, f: how often each of the distinct phrases (key, phrase, term: its first token) occurs in a chunk, as adjacent
    tokens of one field. Only occurrences of a phrase's first token leave the scan, dealt by chunk. A phrase of the empty token is
    in every chunk once, which no true token is."""
    fields = tokens.select("chunk_id", "dl", F.explode(F.array(*FIELDS, F.array(F.lit("")))).alias("field"))
    each = fields.select("chunk_id", "dl", "field", F.posexplode("field").alias("at", "term")).join(phrases, "term")
    whole = (F.size("phrase") == 1) | (F.slice("field", F.col("at") + 1, F.size("phrase")) == F.col("phrase"))
    return each.where(whole).select("chunk_id", "dl", "key").repartition("chunk_id").groupBy("chunk_id", "dl", "key").agg(F.count("*").alias("f"))


def bm25(tokens: DataFrame, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, bm25 (negative, lower is better) and score = s / (1 + s) of every matching chunk.

    A chunk matches if it has any phrase of the query. `allowed` (chunk_id) filters after the statistics, which are always of all
    chunks. Queries without tokens match nothing. A phrase's weight in a chunk is worked out once, whatever the number of queries
    that have it, and all that belongs to a chunk stays in its partition until the sums are made.
    """
    phrases = query_phrases(queries).withColumn("key", F.array_join("phrase", " "))  # tokens hold no blank
    n = phrases.agg(F.count("*").alias("all")).first()["all"]
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_PHRASES else (lambda df: df)
    distinct = phrases.select("key", "phrase", F.col("phrase")[0].alias("term")).distinct()
    whole = tokens.sparkSession.createDataFrame([("", [""], "")], distinct.schema)  # what it finds counts the chunks, so one scan does for all
    found = matches(tokens, small(distinct.union(whole)))
    df = found.groupBy("key").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    every = F.col("key") == ""
    stats = df.agg(F.max(F.when(every, F.col("n"))).alias("total"), F.max(F.when(every, F.col("tokens") / F.col("n"))).alias("avgdl"))
    raw = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = df.select("key", "n").crossJoin(F.broadcast(stats)).select("key", F.when(raw <= 0, FLOOR).otherwise(raw).alias("idf"), "avgdl")  # stats is one row
    if allowed is not None:
        found = found.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    weight = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = found.join(small(idf), "key").select("chunk_id", "key", weight.alias("w"))
    hits = weighted.join(small(phrases.select("query_id", "key")), "key").groupBy("query_id", "chunk_id").agg((-F.sum("w")).alias("bm25"))
    s = F.greatest(-F.col("bm25"), F.lit(0.0))
    return hits.withColumn("score", s / (1 + s))


def top(hits: DataFrame, limit: int | Column, by: str = "score", offset: int = 0, tie: str = "chunk_id") -> DataFrame:
    """The best `limit` of each query after `offset`, with rank from 1. Spark keeps only each partition's best before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.round(by, TIE_DIGITS).desc(), tie)
    ranked = hits.withColumn("rank", F.row_number().over(w))
    last = limit + offset if isinstance(limit, int) else limit + F.lit(offset)
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= last))
