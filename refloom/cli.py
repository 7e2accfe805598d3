"""Command line over the operators: trace, reverse, analyze, diff, query and config.

Exit codes: 0 done, 2 wrong arguments, 4 a root that names no paper.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom import settings as S
from refloom.operators import diff as D
from refloom.operators import graph as G
from refloom.operators import trace as TR
from refloom.operators.export import build_manifest, export_graph, gather
from refloom.operators.matching import credited_contexts
from refloom.plans import registry
from refloom.plans.trace_queries import links_of
from refloom.sources.root import root_id, root_source, supplied_files
from refloom.sources.tables import table

CONFIG = Path.home() / ".config" / "refloom" / "settings"
#: Shown with stars in place of all but their first four characters.
SECRETS = ("key", "token", "email")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refloom", description="Keyword traces through a citation graph held in tables")
    p.add_argument("--config", type=Path, default=CONFIG, help="settings file")
    sub = p.add_subparsers(dest="command", required=True)

    def common(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--data", required=True, help="folder of parquet tables")
        c.add_argument("--out", help="folder or file to write to")
        c.add_argument("--format", choices=("json", "graphml"))
        return c

    for name, text in (("trace", "follow references beside a keyword"), ("reverse", "follow citing papers whose contexts mention a keyword")):
        c = common(name, text)
        c.add_argument("--keyword", action="append", required=True)
        for flag in ("--pdf", "--doi", "--arxiv", "--url"):
            c.add_argument(flag)
        c.add_argument("--depth", type=int)
        c.add_argument("--match-mode", choices=("any", "all"), default="any")
        c.add_argument("--limit", type=int)
        c.add_argument("--since")
        c.add_argument("--baseline", help="JSON snapshot to compare with")
        c.add_argument("--supply", action="append", default=[], metavar="ID=PATH")
    common("analyze", "measure the whole graph")
    q = common("query", "run a registered query")
    q.add_argument("name")
    c = sub.add_parser("config", help="settings kept for later runs")
    c.add_argument("action", choices=("show", "get", "set", "clear", "path"))
    c.add_argument("name", nargs="?")
    c.add_argument("value", nargs="?")
    return p


def masked(name: str, value: str) -> str:
    return value[:4] + "*" * max(0, len(value) - 4) if any(s in name for s in SECRETS) else value


def config(path: Path, action: str, name: str | None, value: str | None) -> list[str]:
    """Lines to print; ``set`` and ``clear`` rewrite the file, readable by its owner only. Wrong use raises ValueError."""
    kept = S.read_file(path)
    if action == "path":
        return [str(path)]
    if action == "show":
        return [f"{k} = {masked(k, v)}" for k, v in sorted(kept.items())]
    if not name or (action == "set") != (value is not None):
        raise ValueError(f"config {action} needs a name" + (" and a value" if action == "set" else " only"))
    name = name.replace("-", "_").lower()
    if action == "get":
        return [kept[name]] if name in kept else []
    kept.pop(name, None)
    if action == "set":
        kept[name] = value
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{k} = {v}\n" for k, v in sorted(kept.items())), encoding="utf-8")
    path.chmod(0o600)
    return []


def _nodes(spark: SparkSession, data: str) -> DataFrame:
    return G.node_view(table(spark, data, "paper_nodes")).withColumnsRenamed({"pub_year": "year", "node_status": "status"})


def _described(spark: SparkSession, data: str, found: DataFrame) -> DataFrame:
    """Nodes of a trace with what the tables know about them."""
    facts = _nodes(spark, data).select("id", "title", "authors", "year", "publication_date", "doi", "arxiv_id", "abstract", "citation_count", "url")
    return found.join(facts, "id", "left").withColumn("keyword_hits", F.array().cast("array<string>"))


def traced(spark: SparkSession, args: argparse.Namespace, cfg: S.Settings) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a forward or reverse trace."""
    root = spark.createDataFrame([(root_id(*root_source(args.pdf, args.doi, args.arxiv, args.url)),)], "id string")
    supplied_files(args.supply)
    if args.command == "trace":
        links, matched, readable = links_of(spark, args.data, args.keyword)
        nodes, edges = TR.trace(links, matched, readable, root, args.depth if args.depth is not None else cfg.depth_forward)
        edges = edges.select("src", "dst", F.lit("primary").alias("edge_type"), "depth", F.lit(None).cast("string").alias("context"))
    else:
        e = credited_contexts(G.edge_view(table(spark, args.data, "citation_edges")), args.keyword)
        need = len(args.keyword) if args.match_mode == "all" else 1
        depth = max(1, args.depth if args.depth is not None else cfg.depth_reverse)
        found = G.reverse_trace(e, root, depth, args.limit or cfg.citing_rows, need)
        nodes = found.select("id", "depth", F.when(F.col("depth") == 0, "root").otherwise("analyzed").alias("status"))
        edges = G.inside(e.filter("kw_no is not null"), nodes).select("src", "dst", "edge_type", "depth", "context")
    return _described(spark, args.data, nodes), edges


def run(args: argparse.Namespace, cfg: S.Settings, spark: SparkSession) -> None:
    if args.command == "query":
        known = registry.queries()
        if args.name not in known:
            raise ValueError(f"no query {args.name!r}")
        df = known[args.name](spark, args.data)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=60)
        return
    if args.command == "analyze":
        nodes, edges = _nodes(spark, args.data), G.edge_view(table(spark, args.data, "citation_edges"))
        for name, df in TR.analyze(nodes, G.inside(edges, nodes)).items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}") if args.out else df.show(truncate=60)
        return
    nodes, edges = traced(spark, args, cfg)
    base = D.load_baseline(spark, args.baseline) if args.baseline else (None, None)
    nodes = D.mark_nodes(nodes, base[0], args.since)
    edges = D.mark_edges(edges, base[1]) if base[1] is not None else edges.withColumn("is_new", F.lit(False))
    nodes, edges = nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst", "edge_type"])
    if not args.out:
        nodes.select("id", "depth", "status", "title").orderBy("depth", "id").show(truncate=60)
        return
    if (args.format or Path(args.out).suffix.lstrip(".")) == "graphml":
        from refloom.plans.numbering import number_rows

        edges = number_rows(edges.withColumn("_k", F.concat_ws("\x1f", "src", "dst", "edge_type")), "_k", "no").withColumn("no", F.col("no") - 1).drop("_k")
    export_graph(nodes, edges, f"{args.out}.parts", args.format or export_suffix(args.out), metadata=build_manifest(nodes, edges, {"keywords": args.keyword}))
    gather(spark, f"{args.out}.parts", args.out)


def export_suffix(path: str) -> str:
    return Path(path).suffix.lstrip(".") or "json"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "config":
            print("\n".join(config(args.config, args.action, args.name, args.value)))
            return 0
        known = {f for f in S.read_file(args.config) if hasattr(S.SETTINGS, f)}
        cfg = S.load({k: v for k, v in S.read_file(args.config).items() if k in known})
        if args.command in ("trace", "reverse"):
            kind, _ = root_source(args.pdf, args.doi, args.arxiv, args.url)
            if kind == "pdf":
                print("a file alone names no paper", file=sys.stderr)
                return 4
        run(args, cfg, spark or SparkSession.builder.appName("refloom").getOrCreate())
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0
