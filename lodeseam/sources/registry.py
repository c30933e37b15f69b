"""Which reader a source uses: by its id, else by its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.text import content_hash
from lodeseam.sources.config import SourceConfig
from lodeseam.sources.html import parse_posts
from lodeseam.sources.markdown import read_markdown, under
from lodeseam.sources.pdf import Decoder, parse_pdfs, scan_pdfs

Reader = Callable[[SparkSession, SourceConfig], DataFrame]
_readers: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    _readers[name] = reader


def reader_for(source: SourceConfig) -> Reader:
    for key in (source.source_id, source.type):
        if key in _readers:
            return _readers[key]
    raise ValueError(f"no reader for source {source.source_id} of type {source.type}")


def _markdown(spark: SparkSession, s: SourceConfig) -> DataFrame:
    return read_markdown(spark, s.path, s.url, s.max_files)


def _posts(spark: SparkSession, s: SourceConfig) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(s.path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html$", "")
    docs = parse_posts(files.select(stem.alias("name"), F.decode("content", "UTF-8").alias("html")), "name")
    return docs.withColumn("content_hash", content_hash(F.col("text"))).withColumn("path", F.col("external_id"))


def pdf_reader(decode: Decoder) -> Reader:
    """A reader of PDF folders for register(), with the decoder that it is given."""

    def read(spark: SparkSession, s: SourceConfig) -> DataFrame:
        return parse_pdfs(scan_pdfs(spark, s.path, s.max_bytes, s.max_files).withColumn("path", under(s.path)), decode)

    return read


def _undecoded(_: bytes) -> list:
    raise ValueError("no PDF decoder is registered")


# without a decoder each file of a PDF folder counts as an error
for _name, _reader in (("markdown", _markdown), ("blog", _posts), ("filesystem", pdf_reader(_undecoded)), ("pdf", pdf_reader(_undecoded))):
    register(_name, _reader)
