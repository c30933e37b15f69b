import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.operators import evaluate, graph, vector
from lodeseam.plans.api import Engine
from lodeseam.plans.ingest import ingest
from lodeseam.sources import html, pdf, registry, staging
from lodeseam.sources.config import Settings, SourceConfig, load_settings
from lodeseam.sources.markdown import read_markdown
from lodeseam.streaming.ingest import markdown_stream

PAGES = {
    "ad/roasting.md": "---\nx: 1\n---\n# Kerberoasting basics\n\nRequest tickets over kerberos with rubeus.\n\n## Cracking\n\nUse hashcat on the tickets.\n\n```\nhashcat -m 13100\n```\n",
    "web/injection.md": "# SQL injection notes\n\nTest mysql forms with sqlmap.\n\n## Blind\n\nTime based queries.\n",
    "images/skip.md": "# no",
    "web/empty.md": "  \n",
}


@pytest.fixture()
def engine(spark, tmp_path):
    for rel, text in PAGES.items():
        (tmp_path / "src" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / rel).write_text(text)
    sources = {"book": SourceConfig("book", "markdown", "The Book", str(tmp_path / "src"), "https://b.example", "trusted"), "cases": SourceConfig("cases", "blog", "Cases", str(tmp_path / "posts"), authority="user", enabled=False), "off": SourceConfig("off", enabled=False)}
    return Engine(spark, Settings(data_dir=f"file://{tmp_path}/data", embeddings=True, case_sources=["cases"], sources=sources))


POST = """<html><head><meta property="og:title" content="HTB: Forest"><meta property="article:published_time" content="2020-03-21T10:00:00"><meta property="og:description" content="A domain.">
<meta property="og:url" content="https://c.example/f"></head><body><div class="htb-card"><span>Easy</span><b>OS</b><i>Windows</i><b>Creator</b><i>someone</i></div>
<div id="postBody"><p>Start with nmap and ldap.<p>Then more.<h2>Shell</h2><p>Roast <code>x</code> tickets: kerberoasting.</p><pre>GetUsers -dc</pre><h3>Root</h3>dcsync works</div></body></html>"""


def test_round_trip(engine, tmp_path, spark):
    assert engine.ingest()["book"] == {"discovered": 2, "errors": 0, "chunks": 9, "new": 2, "changed": 0, "unchanged": 0}
    assert engine.ingest()["book"]["unchanged"] == 2
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "forest.html").write_text(POST)
    engine.settings.sources["cases"].enabled = True
    assert engine.ingest(["cases", "off", "none"])["cases"]["new"] == 1
    ids = {r.external_id: r.doc_id for r in engine.store.read("documents").collect()}
    text = PAGES["web/injection.md"] + "\nNew lines on ssrf.\n"
    (tmp_path / "src/web/injection.md").write_text(text)
    r = engine.ingest(["book"])["book"]
    assert (r["changed"], r["unchanged"]) == (1, 1) and {x.external_id: x.doc_id for x in engine.store.read("documents").collect()} == ids
    assert engine.embed() == engine.store.read("chunks").count() and engine.embed() == 0
    for mode in ("keyword", "hybrid", "technique", "case_similarity", "semantic"):
        top = engine.search("kerberoasting tickets", mode=mode).first()
        assert top is not None and top.rank == 1 and top.snippet, mode
    assert {r.source_id for r in engine.search("kerberoasting tickets", sources=["book"]).collect()} == {"book"}
    assert engine.search("kerberoasting", sources=["none"]).count() == 0 and engine.search("'\"; DROP *", mode="keyword").count() == 0
    with pytest.raises(ValueError):
        engine.search("x", mode="magic")
    chunk = engine.search("ssrf", mode="keyword").first()
    assert engine.source(chunk_id=chunk.chunk_id).first().title == "SQL injection notes"
    assert engine.source(title="sql INJ", section="Blind").count() >= 1
    brief = engine.technique("Kerberoast")
    assert brief["technique"] == "kerberoasting" and {("documented_by", "The Book"), ("demonstrated_in", "HTB: Forest"), ("uses", "rubeus")} <= {(r.predicate, r.other) for r in brief["neighbours"].collect()}
    found = engine.case_search("roast tickets").where("source_id = 'cases'").first()
    assert found.techniques == ["dcsync", "kerberoasting"]
    packet = engine.research("smb open, kerberoasting with nmap", ["pth"])
    assert packet["techniques"] == ["kerberoasting", "pass the hash"] and packet["signals"]["tool"] == ["nmap"]
    assert engine.doctor()["embedded"] == engine.doctor()["chunks"] and {r.table: r.n for r in engine.counts().collect()}["documents"] == 3
    assert {(r.source_id, r.documents) for r in engine.source_stats().collect()} == {("book", 2), ("cases", 1)}
    gold = spark.createDataFrame([(1, "kerberoasting tickets rubeus", "keyword", ["ad/roasting.md"]), (2, "sql injection mysql", "technique", ["web/injection.md"])], "query_id long, query string, mode string, relevant array<string>")
    report = engine.evaluate(gold)
    assert report["integrity"] == 1 and report["mrr"] == 1 and report["ok"]
    assert engine.store.vacuum() > 0 and engine.search("ssrf", mode="keyword").count() == 1


def test_cases(engine):
    engine.case_create("one", "10.0.0.1")
    engine.case_create("two")
    n = engine.case_add("one", "finding", "open share")
    assert engine.case_update("one", n, "confirmed") and not engine.case_update("two", n, "open")
    with pytest.raises(ValueError):
        engine.case_add("one", "dance", "x")
    assert [(r.name, r.observation_count) for r in engine.case_list().collect()] == [("two", 0), ("one", 1)]
    engine.case_create("one")
    assert engine.case_list().first().name == "one" and engine.case_get("one").first().status == "confirmed"


def test_stream(engine, tmp_path):
    import os

    os.makedirs(tmp_path / "flat")
    (tmp_path / "flat" / "a.md").write_text("# A page\n\nof words")
    for folder in ("one", "two", "images"):
        os.makedirs(tmp_path / "flat" / folder)
        (tmp_path / "flat" / folder / "same.md").write_text(f"# In {folder}\n\nof words")
    source = SourceConfig("flat", "markdown", path=str(tmp_path / "flat"))
    for _ in range(2):
        markdown_stream(engine.spark, engine.store, source, str(tmp_path / "cp")).awaitTermination()
    assert {(r.external_id, r.title, *r.categories) for r in engine.store.read("documents").collect()} == {("a.md", "A page"), ("one/same.md", "In one", "One"), ("two/same.md", "In two", "Two")}


def test_a_broken_ingest_leaves_nothing(engine, monkeypatch):
    from lodeseam.plans import ingest as plan

    def broken(*_, **__):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(plan, "token_table", broken)
        with pytest.raises(RuntimeError):
            engine.ingest()
    assert engine.store.version == 0 and engine.store.read("documents").count() == 0
    with monkeypatch.context() as m:
        m.setattr(plan, "edges", broken)
        assert "executor lost" in engine.ingest()["book"]["graph"]
    assert engine.store.version == 1 and engine.store.read("chunks").count() == 9 and engine.store.read("edges").count() == 0
    plan.rebuild_graph(engine.store)
    gone = engine.store.read("documents").where("external_id = 'ad/roasting.md'")
    some = gone.first().doc_id
    assert engine.store.read("edges").where(F.col("doc_id") == some).count() > 0
    plan.delete_documents(engine.store, gone)
    assert all(engine.store.read(t).where(F.col("doc_id") == some).isEmpty() for t in ("documents", "chunks", "edges", "entities"))
    assert engine.store.read("tokens").count() == engine.store.read("chunks").count() > 0


def test_html_card_and_sections(spark):
    bare = '<meta name="name" content="Bare"><div class="post-content"><h3>Deep</h3>one<h2></h2><h2>Top</h2><h3>Under</h3><pre> x <b>y</b></pre><h3>Next</h3>two</div>tail'
    pages = spark.createDataFrame([("forest", POST), ("bare", bare), ("none", "<p>no body"), ("null", None)], "name string, html string")
    got = {r.external_id: r for r in html.parse_posts(pages, "name").collect()}
    p = got["forest"]
    assert (p["machine_name"], p["kind"], p["date"], p["os"], p["difficulty"], p["creator"], p["summary"], p["url"]) == ("Forest", "htb", "2020-03-21", "Windows", "Easy", "someone", "A domain.", "https://c.example/f")
    assert p["sections"] == ["Shell", "Root"] and p["categories"] == ["htb", "Windows", "Easy"]
    assert [c["section_path"] for c in p["chunks"]] == [["HTB: Forest"], ["HTB: Forest", "Shell"], ["HTB: Forest", "Shell", "Root"]]
    assert p["chunks"][1]["text"] == "Shell\nRoast\ntickets: kerberoasting.\n```\nGetUsers -dc\n```" and [c["ordinal"] for c in p["chunks"]] == [0, 1, 2]
    assert [(c["text"], c["section_path"][1:]) for c in got["bare"]["chunks"]] == [("Deep\none", ["Deep"]), ("Top", ["Top"]), ("Under\n```\nx y\n```\ny", ["Top", "Under"]), ("Next\ntwo", ["Top", "Next"])]
    assert got["bare"]["title"] == "Bare" and got["bare"]["sections"] == ["Deep", "", "Top", "Under", "Next"] and got["bare"]["kind"] == "unknown"
    assert (got["none"]["title"], got["none"]["text"], got["none"]["chunks"]) == ("none", "", []) and got["null"]["error"] and got["forest"]["error"] is None


def test_html_text(spark):
    page = "<head><title>t</title></head><nav>n</nav>a <b>b</b><!-- c --><br>d<p>e<script>f</script><div>g<style>h</style></div>i"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string")
    assert [r.text for r in html.html_text(rows, "k").orderBy("k").collect()] == ["a b\nd\ne\ng\ni", "", ""]


def test_staging(tmp_path, spark):
    (tmp_path / "x.txt").write_text("hi")
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.add(tmp_path / "x.txt", "ok/x.txt")
        tar.add(tmp_path / "x.txt", "../evil.txt")
        link = tarfile.TarInfo("ok/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    assert staging.unpack(str(tmp_path / "a.tar"), str(tmp_path / "out"), "v1") and not staging.unpack(str(tmp_path / "a.tar"), str(tmp_path / "out"), "v1")
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == [".version", "x.txt"] and not (tmp_path / "evil.txt").exists()
    for bad in ("/abs", "../up", "a/../../b", "c:\\x"):
        with pytest.raises(ValueError):
            staging.relative(bad)
    page = spark.createDataFrame([('<a href="/2024/01/02/b.html">1</a><a href="/x">2</a><a href="/2024/01/02/b.html">3</a><a href="/2023/11/12/a.html">4</a>',)], "html string")
    assert [r.url for r in staging.post_urls(page).orderBy("pos").collect()] == ["/2024/01/02/b.html", "/2023/11/12/a.html"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"limit": 5, "sources": {"b": {}, "a": {}, "c": {"enabled": false}}}')
    s = load_settings(str(tmp_path / "c.json"), {"LODESEAM_LIMIT": "7", "LODESEAM_MODEL": "m"})
    assert (s.limit, s.model, s.source_ids(), s.source_ids(["all"]), s.source_ids(["b", "c", "a"]), s.source_ids(["c"])) == (7, "m", ["a", "b"], ["a", "b"], ["b", "a"], [])


def test_pdf_pages(spark):
    files = spark.createDataFrame([("p/x.pdf", bytearray(b"ok")), ("p/bad.pdf", bytearray(b"no"))], "path string, content binary")

    def decode(data):
        if data != b"ok":
            raise ValueError
        return [[("Big", "Serif", 20), ("body words", "Serif", 10), ("x = 1", "Courier", 10), ("tail", "Serif", 10)], None]

    runs = pdf.decoded_runs(files, decode).withColumnRenamed("doc", "doc")
    one, two = pdf.pages(runs).orderBy("page").collect()
    assert (one.headings, one.code_blocks) == (["Big"], ["x = 1"]) and (two.text, two.headings, two.code_blocks) == ("", None, None)


def test_pdfs_into_the_store(engine, tmp_path, monkeypatch):
    folder = tmp_path / "papers"
    for name, content in (("one.pdf", "ok"), ("deep/two.PDF", "meta"), ("bad.pdf", "no"), ("blank.pdf", "blank"), ("none.pdf", ""), ("x.txt", "ok")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(content)

    def decode(data):
        if data == b"no":
            raise ValueError("broken")
        page = [("Big", "Serif", 20), ("body words", "Serif", 10), ("x = 1", "Courier", 10), ("tail", "Serif", 10)]
        if data == b"meta":
            return {"title": "A paper", "author": "Anonymous", "subject": "ssrf", "pages": [page, [("Big", "Serif")], [("other words", "Serif", 10)]]}
        return [page, None] if data == b"ok" else [[("  ", "Serif", 10)]] if data else []

    monkeypatch.setattr(registry, "_readers", dict(registry._readers))
    engine.settings.sources["papers"] = SourceConfig("papers", "pdf", "Papers", str(folder))
    assert engine.ingest(["papers"])["papers"] == {"discovered": 4, "errors": 4, "chunks": 0, "new": 0, "changed": 0, "unchanged": 0}
    registry.register("pdf", registry.pdf_reader(decode))
    assert engine.ingest(["papers"])["papers"] == {"discovered": 3, "errors": 1, "chunks": 5, "new": 2, "changed": 0, "unchanged": 0}
    docs = {r.external_id: r for r in engine.store.read("documents").collect()}
    assert {k: (r.title, r.path, r.categories) for k, r in docs.items()} == {"one.pdf": ("one", "one.pdf", ["local_pdf"]), "deep/two.PDF": ("A paper", "deep/two.PDF", ["local_pdf"])}
    assert docs["deep/two.PDF"].metadata == {"format": "pdf", "page_count": "3", "code_block_count": "1", "subject": "ssrf", "title_inferred": "false"}
    two = docs["deep/two.PDF"].doc_id
    chunks = engine.store.read("chunks").where(f"doc_id = {two}").orderBy("ordinal").collect()
    assert [(r.page, r.kind, list(r.section_path)) for r in chunks] == [(1, "text", ["A paper", "Big"]), (1, "code", ["A paper", "Big"]), (3, "text", ["A paper", "Big"])]
    assert engine.search("other words", mode="keyword").first().doc_id == two and engine.ingest(["papers"])["papers"]["unchanged"] == 2


def test_vectors(spark):
    c = spark.createDataFrame([(1, "s", "alpha beta"), (2, "s", "gamma"), (3, "z", "alpha")], "chunk_id long, source_id string, text string")
    none = spark.createDataFrame([], "chunk_id long, model string, dim int, vector array<float>")
    v = vector.embed_missing(c, none, "m", sources=["s"])
    assert v.count() == 2 and vector.missing_vectors(c, v, "m").count() == 1 and vector.missing_vectors(c, v, "other").count() == 3
    q = spark.createDataFrame([(7, "alpha")], "query_id long, query string").select("query_id", vector.hashed_vector(F.col("query")).alias("vector"))
    assert vector.cosine_hits(vector.embed_missing(c, none, "m"), q, 2).orderBy("rank").first().chunk_id == 3
    assert vector.delete_vectors(v, c, "m", ["s"]).count() == 0 and vector.delete_vectors(v, c, "m", []).count() == 2
    plain = spark.createDataFrame([([1.5, -2.0],), (None,)], "vector array<float>")
    assert [r.x for r in plain.select(vector.from_bytes(vector.to_bytes("vector")).alias("x")).collect()] == [[1.5, -2.0], None]


def test_graph_rules(spark):
    docs = spark.createDataFrame([(1, "s1", "S one", "Kerberoasting guide", ["ref"]), (2, "s2", "S two", "HTB: Box", ["htb"])], "doc_id long, source_id string, source_name string, title string, categories array<string>")
    chunks = spark.createDataFrame([(1, 1, 0, "use rubeus on kerberos", ["Intro"]), (2, 2, 0, "kerberoasting then smb", ["HTB: Box"])], "doc_id long, chunk_id long, ordinal int, text string, section_path array<string>")
    e = {(r.subject, r.predicate, r.object): r.confidence for r in graph.edges(docs, chunks).collect()}
    assert e["kerberoasting", "documented_by", "S one"] == 0.9 and e["kerberoasting", "documented_by", "S two"] == 0.6 and e["kerberoasting", "demonstrated_in", "HTB: Box"] == 0.6
    assert e["HTB: Box", "documented_by", "S two"] == 1.0 and e["kerberoasting", "uses", "rubeus"] == 0.5
    ids = [r.entity_id for r in graph.with_ids(graph.entities(docs, chunks), "entity_id", "entity_type", "name").orderBy("entity_type", "name").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3), (2, 12, 1)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, [11, 99]), (2, [12]), (3, [5])], "query_id long, relevant array<long>")
    r = evaluate.report(hits, gold, 5).first()
    assert (r.queries, round(r.recall, 4), round(r.mrr, 4), round(r.hit_rate, 4)) == (3, 0.5, 0.5, 0.6667)
    none = hits.limit(0).select("query_id", "doc_id", F.col("doc_id").alias("chunk_id"))
    assert evaluate.citation_integrity(none, none.select("chunk_id", "doc_id")).first().integrity == 1.0


def test_reader_registry(spark, tmp_path):
    from lodeseam.sources.registry import reader_for

    with pytest.raises(ValueError):
        reader_for(SourceConfig("x", "carrier-pigeon"))
    assert ingest and read_markdown and reader_for(SourceConfig("x"))


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SORTED_VALUES", 5)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 300).round(2), np.full(200, 0.5), rng.normal(50, 9, 20)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    got = evaluate.percentiles(df, "x", 0, 37, 50, 95, 100).first()
    assert np.allclose(list(got), np.percentile(values, [0, 37, 50, 95, 100]), atol=1e-12)
    assert list(evaluate.percentiles(df.where("x IS NULL"), "x", 50).first()) == [None]
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert evaluate.percentiles(odd, "x", 50).first().p50 == 2.0 and np.isnan(evaluate.percentiles(odd, "x", 100).first().p100)


def test_lookups(engine, spark):
    engine.ingest()
    first = engine.documents("book", 1).first()
    assert engine.document(first.doc_id).first().title == first.title and engine.document(-1).isEmpty()
    assert engine.entity("The Book", "source").count() == 1 and engine.entity("The Book", "writeup").isEmpty()
    assert {tuple(r.section_path[-1:]) for r in engine.excerpts("BLIND").collect()} == {("Blind",)} and engine.excerpts().count() == engine.store.read("chunks").count()
