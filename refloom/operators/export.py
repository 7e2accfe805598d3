"""Graphs as text: JSON and GraphML, built row by row so that writing stays distributed."""

from __future__ import annotations

import html
import json
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refloom import __version__
from refloom.functions.texts import escape_xml
from refloom.plans.numbering import number_rows

#: Keys of the file: id, for, name, type; fixed values.
GRAPHML_KEYS = (
    ("title", "node", "title", "string"), ("authors", "node", "authors", "string"), ("year", "node", "year", "int"), ("status", "node", "status", "string"), ("depth", "node", "depth", "int"),
    ("doi", "node", "doi", "string"), ("arxiv_id", "node", "arxiv_id", "string"), ("abstract", "node", "abstract", "string"), ("citation_count", "node", "citation_count", "int"), ("url", "node", "url", "string"),
    ("keyword_hits", "node", "keyword_hits", "int"), ("publication_date", "node", "publication_date", "string"), ("is_new", "node", "is_new", "boolean"), ("betweenness", "node", "betweenness", "double"),
    ("pagerank", "node", "pagerank", "double"), ("is_pivot", "node", "is_pivot", "boolean"), ("edge_type", "edge", "edge_type", "string"), ("edge_depth", "edge", "depth", "int"), ("context", "edge", "context", "string"), ("edge_is_new", "edge", "is_new", "boolean"),
)


def _data(key: str, value: Column) -> Column:
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.concat(F.lit(f'      <data key="{key}">'), escape_xml(text), F.lit("</data>"))


def graphml_node(df: DataFrame) -> Column:
    """Element of a node; nulls and empty strings are left out, ``is_new`` is named only where true."""
    have = set(df.columns)
    parts = [F.concat(F.lit('    <node id="'), escape_xml(F.col("id")), F.lit('">'))]
    for key, kind, _, _ in GRAPHML_KEYS:
        if kind != "node" or key not in have:
            continue
        value = F.when(F.size("authors") > 0, F.array_join("authors", ", ")) if key == "authors" else F.when(F.col("is_new"), F.lit("True")) if key == "is_new" else F.col(key)
        parts.append(_data(key, value))
    return F.concat_ws("\n", *parts, F.lit("    </node>"))


def graphml_edge() -> Column:
    """Element of an edge (no, src, dst, edge_type, depth, context, is_new)."""
    head = F.concat(F.lit('    <edge id="e'), F.col("no").cast("string"), F.lit('" source="'), escape_xml(F.col("src")), F.lit('" target="'), escape_xml(F.col("dst")), F.lit('">'))
    return F.concat_ws("\n", head, _data("edge_type", F.col("edge_type")), _data("edge_depth", F.col("depth")), _data("context", F.col("context")), _data("edge_is_new", F.when(F.col("is_new"), F.lit("True"))), F.lit("    </edge>"))


def graphml_frame(name: str = "refloom") -> tuple[str, str]:
    """Text before the elements and after them."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">']
    head += [f'  <key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in GRAPHML_KEYS]
    return "\n".join([*head, f'  <graph id="{name}" edgedefault="directed">']), "  </graph>\n</graphml>"


def export_format(path: str, fmt: str | None = None) -> str:
    """json or graphml, by name or by the path's ending; anything else raises ValueError."""
    kind = (fmt or PurePath(path).suffix.lstrip(".")).lower()
    if kind not in ("json", "graphml"):
        raise ValueError(f"unknown export format: {kind!r}")
    return kind


#: Fields of a node and of an edge in the JSON file, in order; fixed values.
JSON_NODE = ("id", "title", "authors", "year", "publication_date", "status", "depth", "doi", "arxiv_id", "abstract", "citation_count", "url", "keyword_hits", "is_new")
JSON_EDGE = ("source", "target", "type", "depth", "context", "is_new")


def json_node(df: DataFrame) -> Column:
    """Object of a node; fields that the table lacks are null."""
    have = set(df.columns)
    return F.to_json(F.struct(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in JSON_NODE)), {"ignoreNullFields": "false"})


def json_edge() -> Column:
    """Object of an edge (src, dst, edge_type, depth, context, is_new)."""
    own = {"source": "src", "target": "dst", "type": "edge_type"}
    return F.to_json(F.struct(*(F.col(own.get(c, c)).alias(c) for c in JSON_EDGE)), {"ignoreNullFields": "false"})


def json_lines(nodes: DataFrame, edges: DataFrame, metadata: dict | None = None, analytics: dict | None = None) -> DataFrame:
    """(o, i, value): the lines of one JSON object with metadata, analytics, nodes and edges, in order of (o, i).

    ``i`` numbers the elements; a comma ends all but the last of each list. Metadata and analytics are small
    and come from the caller; per-node figures belong into the nodes' columns.
    """
    spark = nodes.sparkSession
    head = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}, " for k, v in (("metadata", metadata), ("analytics", analytics)) if v is not None)
    frame = [(0, 0, head + '"nodes": ['), (2, 0, '], "edges": ['), (4, 0, "]}")]
    rows = spark.createDataFrame(frame, "o int, i bigint, value string")
    for o, df, obj, key in ((1, nodes, json_node(nodes), "id"), (3, edges, json_edge(), "_k")):
        keyed = df.withColumn("value", obj)
        if key == "_k":
            keyed = keyed.withColumn("_k", F.concat_ws("\x1f", "src", "dst", "edge_type"))
        numbered = number_rows(keyed.select(F.col(key).alias("k"), "value"), "k", "i")
        last = numbered.agg(F.max("i").alias("n"))  # one row
        lines = numbered.join(F.broadcast(last)).select(F.lit(o).alias("o"), "i", F.when(F.col("i") < F.col("n"), F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
        rows = rows.unionByName(lines)
    return rows


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(o, i, value): the lines of a GraphML document; edges are numbered by ``no``."""
    head, foot = graphml_frame()
    rows = nodes.sparkSession.createDataFrame([(0, 0, head), (4, 0, foot)], "o int, i bigint, value string")
    numbered = number_rows(nodes.withColumn("value", graphml_node(nodes)).select("id", "value"), "id", "i")
    return rows.unionByName(numbered.select(F.lit(1).alias("o"), "i", "value")).unionByName(edges.select(F.lit(3).alias("o"), F.col("no").cast("bigint").alias("i"), graphml_edge().alias("value")))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str | None = None, metadata: dict | None = None, analytics: dict | None = None) -> None:
    """Writes a folder of text parts that, put one after the other, are the document; :func:`gather` makes them one file.

    Nodes are unique by id, edges by source, target and type. Parts are ranges of line numbers, not of text.
    """
    rows = json_lines(nodes, edges, metadata, analytics) if export_format(path, fmt) == "json" else graphml_lines(nodes, edges)
    rows.repartitionByRange("o", "i").sortWithinPartitions("o", "i").select("value").write.mode("overwrite").text(path)


def gather(spark: SparkSession, folder: str, path: str) -> None:
    """Puts the parts of an export one after the other into one file, block by block, through the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for p in sorted(str(f.getPath()) for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()


def node_html(title: str, nodes_json: str, edges_json: str) -> str:
    """A page that lists a graph of a few thousand nodes; both lists are JSON text and are escaped here."""
    safe = lambda s: s.replace("</", "<\\/")
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul id='n'></ul>"
        f"<script>const nodes={safe(nodes_json)},edges={safe(edges_json)};const deg={{}};edges.forEach(e=>deg[e.target]=(deg[e.target]||0)+1);"
        "nodes.forEach(n=>{const li=document.createElement('li');li.textContent=`${n.title||n.id} (${n.year||'?'}) - ${n.status} - cited ${deg[n.id]||0}`;document.getElementById('n').append(li)});</script></body></html>"
    )


def render_html(nodes: DataFrame, edges: DataFrame, path: str, title: str = "Citation graph", most: int = 5_000) -> None:
    """Writes the page of a graph; graphs of more than ``most`` nodes are no page for a browser and raise ValueError."""
    if nodes.count() > most:
        raise ValueError(f"a page holds at most {most} nodes")
    n = [r[0] for r in nodes.select(json_node(nodes)).collect()]
    e = [r[0] for r in edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(json_edge()).collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write(node_html(title, "[" + ",".join(n) + "]", "[" + ",".join(e) + "]"))


def manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, n): counts of a run: nodes, edges, nodes by status."""
    total = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("item"), "n")
    return total.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("item"), "n")).unionByName(
        nodes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("status:"), F.coalesce("status", F.lit("?"))).alias("item"), "n")
    )


def build_manifest(nodes: DataFrame, edges: DataFrame, settings: dict | None = None, started: str | None = None, ended: str | None = None) -> dict:
    """A run's record: versions, settings, root (the first node with that status), counts and times as given."""
    counts = {r["item"]: r["n"] for r in manifest(nodes, edges).collect()}  # a row per status
    root = nodes.filter("status = 'root'").select("id", "title").orderBy("id").limit(1).collect()
    return {
        "version": __version__, "spark": nodes.sparkSession.version, "started": started, "ended": ended, "settings": settings or {},
        "root": root[0].asDict() if root else None, "n_nodes": counts["nodes"], "n_edges": counts["edges"], "status": {k[7:]: v for k, v in counts.items() if k.startswith("status:")},
    }
