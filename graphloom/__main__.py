"""``python -m graphloom index|query|watch``: exit 0 if well, 1 on a failure, 2 on wrong use."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Index a workspace, query a graph, watch a stream of changes.")
    p.add_argument("--store", help="folder or URI of the stored graphs (default: graphloom in the warehouse)")
    p.add_argument("--graph", default="cpg", help="name of the graph")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="scan a folder, extract declarations and write them")
    index.add_argument("root")
    index.add_argument("--exclude", action="append", default=[], help="further patterns to leave out")
    index.add_argument("--config", help="JSON file with include, exclude, excludeExtra and maxBytes")
    index.add_argument("--dry-run", action="store_true", help="only count")
    query = sub.add_parser("query", help="run a reading query")
    query.add_argument("text")
    query.add_argument("--param", action="append", default=[], metavar="NAME=JSON")
    query.add_argument("--json", action="store_true", help="one JSON object a line")
    query.add_argument("--explain", action="store_true", help="the plan instead of the result")
    watch = sub.add_parser("watch", help="follow a folder of JSON events")
    watch.add_argument("events")
    watch.add_argument("--every", help="processing-time interval; without it what is there is processed once")
    return p


def stored_graph(spark, store):
    """A stored graph's tables by label and type, properties as columns."""
    from pyspark.sql import functions as F

    from .graph import Edges, Graph, Nodes
    from .schema import CONSTRAINTS, EDGE_SPECS, INDEXES, NODE_SPECS, TYPES

    nodes, edges = store.read()

    def typed(df, spec):
        return [F.col("props")[p.name].cast(TYPES[p.type]).alias(p.name) if p.type != "list" else F.from_json(F.col("props")[p.name], "array<string>").alias(p.name) for p in spec.properties]

    tables = []
    for label, spec in NODE_SPECS.items():
        key = spec.key or "key"
        own = nodes.where(F.col("label") == label)
        tables.append(Nodes(label, own.select(F.col("key").alias(key), *[c for c, p in zip(typed(own, spec), spec.properties) if p.name != key]), key, ("CPG",) if spec.cpg else ()))
    links = [Edges(kind, edges.where((F.col("type") == kind) & (F.col("from_label") == a) & (F.col("to_label") == b)).select("from_key", "to_key", *typed(edges, spec)), a, b, "from_key", "to_key") for kind, spec in EDGE_SPECS.items() for a in spec.sources for b in spec.targets]
    return Graph(tables, links, "string", list(INDEXES), [(c[0], c[1]) for c in CONSTRAINTS])


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from .cypher import CypherError, explain, run
    from .operators.write import open_store
    from .sources import outputs, workspace
    from .streaming import changes

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        store = open_store(spark, given.store or f"{spark.conf.get('spark.sql.warehouse.dir')}/graphloom", given.graph, bootstrap=False)
        if given.command == "index":
            scope = workspace.scope_from(given.config) if given.config else workspace.Scope()
            scope = workspace.define_scope(scope.include, scope.exclude, tuple(given.exclude), scope.max_bytes)
            if given.dry_run:
                found = workspace.walk(given.root, scope)
                print(json.dumps({"files": len(found.files), "directories": len(found.directories), "stats": found.counts}, sort_keys=True))
            else:
                store.bootstrap()
                print(json.dumps(workspace.index_workspace(spark, given.root, store, scope), sort_keys=True))
        elif given.command == "query":
            params = {k: json.loads(v) for k, _, v in (p.partition("=") for p in given.param)}
            graph = stored_graph(spark, store)
            if given.explain:
                print(explain(graph, spark, given.text, params))
            else:
                df = run(graph, spark, given.text, params)
                print("\n".join(r["line"] for r in outputs.json_lines(df).collect()) if given.json else outputs.format_table(df))
        else:
            changes.watch(changes.read_events(spark, given.events), f"{store.path}/watch", f"{store.path}/log", every=given.every).awaitTermination()
    except (CypherError, OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
