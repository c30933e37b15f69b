"""python -m lodeseam COMMAND: a thin command line over the engine."""

from __future__ import annotations

import argparse
import json
import sys

from lodeseam import __version__


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodeseam")
    p.add_argument("--config", default="lodeseam.json")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "update", "embed"):
        s = sub.add_parser(name)
        s.add_argument("sources", nargs="*")
        s.add_argument("--no-graph", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--source", action="append")
    s.add_argument("--platform")
    s.add_argument("--limit", type=int, default=8)
    s = sub.add_parser("source-show")
    s.add_argument("source")
    s.add_argument("--limit", type=int, default=20)
    for name in ("stats", "sources", "rebuild-index", "graph-build", "graph-show", "doctor", "version"):
        sub.add_parser(name)
    s = sub.add_parser("eval")
    s.add_argument("gold", help="JSON lines of query_id, query, mode, relevant")
    s.add_argument("-k", type=int, default=5)
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from lodeseam.operators.graph import graph_stats
    from lodeseam.plans.api import Engine
    from lodeseam.plans.ingest import rebuild_graph, rebuild_index
    from lodeseam.sources.config import load_settings

    e = Engine(SparkSession.builder.getOrCreate(), load_settings(a.config))
    if a.command in ("ingest", "update"):
        print(json.dumps(e.ingest(a.sources, not a.no_graph)))
    elif a.command == "embed":
        print(e.embed(a.sources or None))
    elif a.command == "search":
        e.search(a.query, a.mode, a.source, platform=a.platform, limit=a.limit).show(a.limit, truncate=80)
    elif a.command == "source-show":
        e.documents(a.source, a.limit).show(a.limit, truncate=80)
    elif a.command == "stats":
        e.counts().show()
        e.source_stats().show()
    elif a.command == "sources":
        e.store.read("sources").orderBy("source_id").show()
    elif a.command == "rebuild-index":
        rebuild_index(e.store)
    elif a.command == "graph-build":
        rebuild_graph(e.store, e.settings.case_sources)
    elif a.command == "graph-show":
        graph_stats(e.store.read("entities"), e.store.read("edges")).show(100)
    elif a.command == "doctor":
        print(json.dumps(e.doctor()))
    elif a.command == "eval":
        r = e.evaluate(e.spark.read.schema("query_id long, query string, mode string, relevant array<string>").json(a.gold), a.k)
        print(json.dumps(r))
        return 0 if r["ok"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
