"""The tables' roles in the registered queries: documents as sources and chunks, pages as markdown, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.text import content_hash, hard_split, normalized_hash, token_estimate
from lodeseam.operators.lexical import token_table
from lodeseam.plans.api import Engine
from lodeseam.plans.ingest import ingest
from lodeseam.plans.store import SCHEMAS
from lodeseam.scratch import scratch_dir
from lodeseam.sources.config import Settings, SourceConfig

AUTHORITIES = ("official", "trusted", "user", "unknown")
VOCABULARY = {"service": ["queen", "thatre", "ouver"], "technique": ["clown", "idiot", "ingthe"], "tool": ["leau", "ciónes", "schen"]}
CASE_SOURCES, MARKERS = ["src3"], ["de", "src7"]
RUNS = [
    ("a", 1, 0, "Chapter One", "Serif", 18.0), ("a", 1, 1, "continued", "Serif", 17.0), ("a", 1, 2, "body text", "Serif", 11.0), ("a", 1, 3, "ls -la", "DejaVu Sans Mono", 9.0),
    ("a", 1, 4, "\ncat x", "Courier", 9.0), ("a", 1, 5, "more body", "Serif", 11.0), ("a", 1, 6, "4. Services of it\nplain", "Serif", 11.0), ("a", 1, 7, "ab", "Courier", 11.0), ("a", 1, 8, "end", "Serif", 11.0),
    ("a", 2, 0, "Chapter One", "Serif", 18.0), ("a", 2, 1, "x", "Serif", 10.0), ("a", 2, 2, "y", "Serif", 10.0), ("a", 2, 3, "Chapter One", "Serif", 18.0), ("b", 1, 0, "none", "Serif", 0.0), ("b", 1, 1, "3.2  Deep heading", "", 0.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "doc string, page int, idx int, text string, font string, size double")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_id, source_name, title, categories, authority, text."""
    n = F.substring("source", 4, 9).cast("int") % 4
    authority = F.when(n == 0, AUTHORITIES[0]).when(n == 1, AUTHORITIES[1]).when(n == 2, AUTHORITIES[2]).otherwise(AUTHORITIES[3])
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.concat(F.lit("Source "), F.col("source")).alias("source_name"), F.concat_ws(" ", "source", "doc_id").alias("title"), F.array("lang", "source").alias("categories"), authority.alias("authority"), "text", "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    parts = d.select(*(c for c in d.columns if c != "text"), F.posexplode(hard_split(F.col("text"))).alias("ordinal", "text"))
    return parts.select((F.col("doc_id") * 1000 + F.col("ordinal")).alias("chunk_id"), "*", F.array("lang").alias("section_path"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(chunks(spark, sf_dir))


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rewritten as markdown with headings of three levels and fences."""
    p = F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))
    block = F.transform(p, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).when(i % 4 == 2, F.concat(F.lit("### Detail "), i.cast("string"), F.lit(" ##\n\n"), x)).when(i % 5 == 3, F.concat(F.lit("```sh\n"), x, F.lit("\n\n# no heading\n```"))).otherwise(x))
    head = F.concat(F.lit("# "), F.regexp_extract("html", "<h1>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.concat(F.array(head), block), "\n\n").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, as a query of that id."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each document with an embedding, of two models and lengths by id."""
    v = vectors(spark, sf_dir)
    return v.select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, "old").otherwise("now").alias("model"), F.size("vector").alias("dim"), F.when(F.col("chunk_id") % 5 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")).alias("vector"))


#: Engines over the tables of a folder, one for each running Spark application.
_engines: dict[tuple[str, str, str], Engine] = {}


def _kept(spark: SparkSession, sf_dir: str, what: str, build) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _engines:
        _engines[key] = build()
    return _engines[key]


def _filled(df: DataFrame, name: str) -> DataFrame:
    """df with the store's columns of that table, null where df has none."""
    wanted = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in df.columns})


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """A store of the tables: documents with their chunks and tokens, embeddings as vectors, conversations as cases."""

    def build() -> Engine:
        e = Engine(spark, Settings(data_dir=scratch_dir(spark), model="now"))
        docs, parts, turns = documents(spark, sf_dir), chunks(spark, sf_dir), table(spark, sf_dir, "conversations")
        text = F.col("text")
        e.store.commit(
            sources=_filled(docs.select("source_id", F.col("source_name").alias("name"), "authority", F.lit(True).alias("enabled")).distinct(), "sources"),
            documents=_filled(docs.withColumns({"external_id": F.col("doc_id").cast("string"), "content_hash": content_hash(text)}), "documents"),
            chunks=_filled(parts.withColumns({"kind": F.lit("text"), "token_estimate": token_estimate(text), "content_hash": normalized_hash(text)}), "chunks"),
            tokens=token_table(parts),
            vectors=model_vectors(spark, sf_dir),
            cases=_filled(turns.select(F.col("conv_id").alias("case_id"), F.concat(F.lit("case "), "conv_id").alias("name")).distinct(), "cases"),
            observations=_filled(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("obs_id"), F.col("conv_id").alias("case_id"), F.col("role").alias("kind"), "text", F.lit("open").alias("status")), "observations"),
        )
        return e

    return _kept(spark, sf_dir, "tables", build)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored: even documents. Parsed: all of the first 80 % ids by remainder, every third with another text."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), "doc_id", "text")
    stored = docs.where("doc_id % 2 = 0").withColumn("content_hash", content_hash(F.col("text")))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    parsed = docs.where("doc_id % 5 <> 4").withColumn("text", text).drop("doc_id").withColumn("content_hash", content_hash(F.col("text")))
    return parsed, stored


def ingested(spark: SparkSession, sf_dir: str) -> Engine:
    """A store that took the stored half and then the parsed documents, all as one source."""

    def build() -> Engine:
        e, book = Engine(spark, Settings(data_dir=scratch_dir(spark))), SourceConfig("book", "markdown", "Book")
        for part in reversed(halves(spark, sf_dir)):
            named = part.withColumns({"title": F.concat_ws(" ", "source_id", "external_id"), "url": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "categories": F.array("source_id")})
            ingest(e.store, named.drop("doc_id", "source_id"), book, build_graph=False)
        return e

    return _kept(spark, sf_dir, "ingested", build)
