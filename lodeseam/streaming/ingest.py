"""Files that arrive, ingested by the same merge: a file stream that takes what is there and stops, or keeps waiting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeseam.plans.ingest import ingest
from lodeseam.plans.store import Store
from lodeseam.sources.config import Settings, SourceConfig
from lodeseam.sources.markdown import named_files, parse_markdown


def markdown_stream(spark: SparkSession, store: Store, source: SourceConfig, checkpoint: str, once: bool = True, settings: Settings | None = None):
    """Names, categories and skipped folders are those of a scan. A batch twice delivered changes nothing: its documents are unchanged by then."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(source.path)

    def merge(batch: DataFrame, _: int) -> None:
        ingest(store, parse_markdown(named_files(batch, source.path), source.url), source, settings=settings)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
