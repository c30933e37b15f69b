"""Incremental ingest: classify by content hash, merge documents, replace the chunks of changed ones, maintain the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import token_estimate
from lodeseam.operators.chunking import markdown_chunks
from lodeseam.operators.dedup import first_of_each
from lodeseam.operators.graph import edges, entities, with_ids
from lodeseam.operators.lexical import token_table
from lodeseam.plans.store import Store, Written
from lodeseam.sources.config import Settings, SourceConfig

#: Chunk ids are doc_id times this plus the ordinal, so they are stable and need no counter.
CHUNKS_PER_DOCUMENT = 1_000_000


def classified(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """parsed with `status`: new, changed or unchanged, and the doc_id where there is one. One join on (source_id, external_id)."""
    now = documents.select("source_id", "external_id", F.col("doc_id"), F.col("content_hash").alias("stored_hash"))
    both = parsed.join(now, ["source_id", "external_id"], "left")
    status = F.when(F.col("doc_id").isNull(), "new").when(F.col("content_hash") == F.col("stored_hash"), "unchanged").otherwise("changed")
    return both.withColumn("status", status).drop("stored_hash")


def merged_documents(marked: DataFrame, documents: DataFrame) -> DataFrame:
    """documents after the new and changed rows of marked; ids stay, new ones follow the largest."""
    known = {f.name for f in documents.schema.fields}
    fresh = marked.where("status = 'new'").drop("doc_id")
    top = documents.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    numbered = with_ids(fresh, "n", "source_id", "external_id").crossJoin(F.broadcast(top)).withColumn("doc_id", F.col("top") + F.col("n"))  # top is one row
    touched = numbered.drop("n", "top").unionByName(marked.where("status = 'changed'"))
    born = documents.select(F.col("doc_id").alias("old"), F.col("created_at").alias("born"))
    rows = touched.join(born, F.col("doc_id") == F.col("old"), "left").withColumn("updated_at", F.current_timestamp()).withColumn("created_at", F.coalesce("born", "updated_at"))
    missing = {c: F.lit(None).cast(documents.schema[c].dataType) for c in known if c not in rows.columns}
    rows = rows.withColumns(missing).select(*documents.columns)
    return documents.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows)


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, source_id, title, text, categories, perhaps chunks): those given where there are any, else by
    structure; in a document each normalized text once."""
    path = F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.array("title"))
    has = "chunks" in docs.columns
    paged = has and "page" in docs.schema["chunks"].dataType.elementType.names
    page = (F.col("c")["page"] if paged else F.lit(None)).cast("int").alias("page")
    own = docs.where("size(chunks) > 0").select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.ordinal", "c.text", "c.section_path", "c.kind", page) if has else None
    rest = docs.where("coalesce(size(chunks), 0) <= 0") if has else docs
    made = markdown_chunks(rest.withColumn("_path", path), path_col="_path").select("doc_id", "ordinal", "text", "section_path", "kind", F.lit(None).cast("int").alias("page"))
    both = made if own is None else made.unionByName(own)
    first = first_of_each(both).join(docs.select("doc_id", "source_id"), "doc_id")
    return first.select((F.col("doc_id") * CHUNKS_PER_DOCUMENT + F.col("ordinal")).alias("chunk_id"), "doc_id", "source_id", F.col("ordinal").cast("int").alias("ordinal"), "text", "section_path", "page", "kind", token_estimate(F.col("text")).cast("int").alias("token_estimate"), "content_hash")


def replaced(rows: DataFrame, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(touched.select(key), key, "left_anti").unionByName(new)


def upsert_sources(sources: DataFrame, configs: list[SourceConfig]) -> DataFrame:
    """All but last_fetched and version come from the configuration."""
    spark = sources.sparkSession
    given = spark.createDataFrame([(c.source_id, c.name, c.authority, c.type, c.url, c.enabled) for c in configs], "source_id string, name string, authority string, source_type string, url string, enabled boolean")
    kept = sources.select("source_id", "last_fetched", "version", "meta")
    return sources.join(given, "source_id", "left_anti").unionByName(given.join(kept, "source_id", "left").select(*sources.columns))


def one_of_each(parsed: DataFrame) -> DataFrame:
    """Of rows of one name in a source the one of the least content hash, then title: the same whatever the order of files."""
    (n,) = [next(c for c in ("_n", "_n_", "_n__") if c not in parsed.columns)]
    w = Window.partitionBy("source_id", "external_id").orderBy("content_hash", "title")
    return parsed.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def ingest(store: Store, parsed: DataFrame, source: SourceConfig, build_graph: bool = True, settings: Settings | None = None) -> dict[str, int]:
    """Merge one source's parsed documents (external_id, title, url, path, categories, text, content_hash, and more).

    All tables are written first and made visible by one commit at the end, so a run that breaks off leaves the store as it was
    and the next one starts anew. Documents that are gone upstream stay. Nothing but the source's row is written when no document
    is new or changed. If the graph cannot be built, the rest is committed with the old graph and `graph` says why. Returns the
    counts by status, of chunks, and of parse errors.
    """
    errors = parsed.where("error IS NOT NULL").count() if "error" in parsed.columns else 0
    good = parsed.where("error IS NULL") if "error" in parsed.columns else parsed
    facts = [c for c in ("machine_name", "kind", "os", "difficulty", "summary", "date", "format", "page_count", "code_block_count", "author", "subject", "title_inferred") if c in good.columns]
    pairs = [x for c in facts for x in (F.lit(c), F.col(c).cast("string"))]
    good = one_of_each(good.withColumn("metadata", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None).cast("map<string,string>")).withColumn("source_id", F.lit(source.source_id)))
    marked = classified(good, store.read("documents")).persist()
    try:
        counts = {r.status: r["count"] for r in marked.groupBy("status").count().collect()}
        changed = counts.get("new", 0) + counts.get("changed", 0)
        out = {"discovered": sum(counts.values()) + errors, "errors": errors, "chunks": 0, **{s: counts.get(s, 0) for s in ("new", "changed", "unchanged")}}
        new = {"sources": store.write("sources", upsert_sources(store.read("sources"), [source]))}
        if not changed:
            store.commit(**new)
            return out
        new["documents"] = store.write("documents", merged_documents(marked, store.read("documents")))
        documents = new["documents"].rows
        texts = marked.where("status <> 'unchanged'").drop("doc_id", "status", "title", "categories").join(documents.select("doc_id", "source_id", "external_id", "title", "categories"), ["source_id", "external_id"])
        touched, old = texts.select("doc_id"), store.read("chunks")
        new["chunks"] = store.write("chunks", replaced(old, chunks_of(texts), touched))
        gone, fresh = old.join(touched, "doc_id", "left_semi").select("chunk_id"), new["chunks"].rows.join(touched, "doc_id", "left_semi")
        new["vectors"] = store.write("vectors", store.read("vectors").join(gone, "chunk_id", "left_anti"))
        new["tokens"] = store.write("tokens", store.read("tokens").join(gone, "chunk_id", "left_anti").unionByName(token_table(fresh.join(documents.select("doc_id", "title"), "doc_id"))))
        out["chunks"] = fresh.count()
        if build_graph:
            try:
                new |= graph_tables(store, documents, new["sources"].rows, new["chunks"].rows, settings.case_sources if settings else [])
            except Exception as e:  # noqa: BLE001
                out["graph"] = f"{type(e).__name__}: {e}"[:500]
        store.commit(**new)
        return out
    finally:
        marked.unpersist()


def graph_documents(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """documents with what the graph looks at."""
    d = documents.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")
    return d.withColumns({k: F.try_element_at("metadata", F.lit(k)) for k in ("machine_name", "kind", "os", "summary")})


def graph_tables(store: Store, documents: DataFrame, sources: DataFrame, chunks: DataFrame, case_sources: list[str] | None = None) -> dict[str, Written]:
    docs = graph_documents(documents, sources)
    return {"entities": store.write("entities", with_ids(entities(docs, chunks, case_sources=case_sources), "entity_id", "entity_type", "name")), "edges": store.write("edges", edges(docs, chunks, case_sources=case_sources))}


def rebuild_graph(store: Store, case_sources: list[str] | None = None, sources: list[str] | None = None) -> None:
    """All of the graph anew; with sources, from their documents only."""
    docs = store.read("documents")
    docs = docs if sources is None else docs.where(F.col("source_id").isin(sources) if sources else F.lit(False))
    store.commit(**graph_tables(store, docs, store.read("sources"), store.read("chunks"), case_sources))


def delete_documents(store: Store, gone: DataFrame) -> None:
    """Remove documents (doc_id) with their chunks, vectors, tokens and edges in one commit; an entity's evidence becomes null."""
    ids = gone.select("doc_id").distinct()
    own = store.read("chunks").join(ids, "doc_id", "left_semi").select("chunk_id")
    out = {t: store.read(t).join(ids, "doc_id", "left_anti") for t in ("documents", "chunks", "edges")}
    out |= {t: store.read(t).join(own, "chunk_id", "left_anti") for t in ("vectors", "tokens")}
    ents, lost = store.read("entities"), ids.withColumn("lost", F.lit(True))
    out["entities"] = ents.join(lost, "doc_id", "left").withColumn("doc_id", F.when(F.col("lost").isNull(), F.col("doc_id")))
    store.commit(**out)


def rebuild_index(store: Store) -> None:
    chunks = store.read("chunks").join(store.read("documents").select("doc_id", "title"), "doc_id")
    store.commit(tokens=token_table(chunks).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"))
