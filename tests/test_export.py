import json
import xml.etree.ElementTree as ET

import pytest

from refloom.operators import export as E
from refloom.operators.diff import load_baseline, mark_edges, mark_nodes, parse_since, passes_since

_NODE = "id string, title string, authors array<string>, year int, status string, depth int, is_new boolean, keyword_hits int, citation_count int"
_EDGE = "no bigint, src string, dst string, edge_type string, depth int, context string, is_new boolean"


@pytest.fixture
def graph(spark):
    nodes = [("doi:1", 'A "quoted" <title> & more', ["Ann", "Bob"], 2001, "root", 0, True, 2, 0), ("doi:2", None, [], None, "analyzed", 1, False, 0, None), ("arxiv:3", "é", None, 1999, "unavailable", 2, False, 0, 5)]
    edges = [(0, "doi:1", "doi:2", "primary", 1, "see <1>", True), (1, "doi:1", "arxiv:3", "secondary", 2, None, False)]
    return spark.createDataFrame(nodes, _NODE), spark.createDataFrame(edges, _EDGE)


def test_json_is_one_document_and_comes_back(spark, graph, tmp_path):
    E.export_graph(*graph, f"file:{tmp_path}/g.parts", "json", metadata={"k": "é\"</x>"}, analytics={"global": {"n_nodes": 3}})
    E.gather(spark, f"file:{tmp_path}/g.parts", f"file:{tmp_path}/g.json")
    doc = json.loads((tmp_path / "g.json").read_text(encoding="utf-8"))
    assert list(doc) == ["metadata", "analytics", "nodes", "edges"] and doc["metadata"]["k"] == "é\"</x>"
    assert {n["id"] for n in doc["nodes"]} == {"doi:1", "doi:2", "arxiv:3"} and all(list(n) == list(E.JSON_NODE) for n in doc["nodes"])
    assert [(e["source"], e["target"], e["type"]) for e in doc["edges"]] == [("doi:1", "arxiv:3", "secondary"), ("doi:1", "doi:2", "primary")]
    nodes, edges = load_baseline(spark, f"file:{tmp_path}/g.json")
    assert {(r.id, r.status) for r in nodes.collect()} == {("doi:1", "root"), ("doi:2", "analyzed"), ("arxiv:3", "unavailable")}
    assert {(r.src, r.dst, r.edge_type) for r in edges.collect()} == {("doi:1", "doi:2", "primary"), ("doi:1", "arxiv:3", "secondary")}


def test_empty_graph_is_a_document(spark, graph, tmp_path):
    E.export_graph(graph[0].limit(0), graph[1].limit(0), f"file:{tmp_path}/e.parts", "json")
    E.gather(spark, f"file:{tmp_path}/e.parts", f"file:{tmp_path}/e.json")
    assert json.loads((tmp_path / "e.json").read_text()) == {"nodes": [], "edges": []}


def test_graphml_is_well_formed(spark, graph, tmp_path):
    E.export_graph(*graph, f"file:{tmp_path}/g.parts", "graphml")
    E.gather(spark, f"file:{tmp_path}/g.parts", f"file:{tmp_path}/g.graphml")
    root = ET.fromstring((tmp_path / "g.graphml").read_text(encoding="utf-8"))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    data = {n.get("id"): {d.get("key"): d.text for d in n} for n in root.iter(f"{ns}node")}
    assert data["doi:1"]["title"] == 'A "quoted" <title> & more' and data["doi:1"]["authors"] == "Ann, Bob" and data["doi:1"]["is_new"] == "True"
    assert "title" not in data["doi:2"] and "is_new" not in data["doi:2"] and data["doi:1"]["keyword_hits"] == "2"
    assert [e.get("id") for e in root.iter(f"{ns}edge")] == ["e0", "e1"] and len(list(root.iter(f"{ns}key"))) == 20


@pytest.mark.parametrize(("path", "fmt", "kind"), [("a.json", None, "json"), ("a.GraphML", None, "graphml"), ("a.txt", "json", "json")])
def test_format_by_name_or_ending(path, fmt, kind):
    assert E.export_format(path, fmt) == kind


@pytest.mark.parametrize("path", ["a.txt", "a", "a.gexf"])
def test_unknown_format_is_refused(path):
    with pytest.raises(ValueError, match="unknown"):
        E.export_format(path)


def test_page_and_manifest(spark, graph, tmp_path):
    E.render_html(*graph, str(tmp_path / "p.html"), "T </script>")
    page = (tmp_path / "p.html").read_text(encoding="utf-8")
    assert page.count("</script>") == 1 and "doi:2" in page
    with pytest.raises(ValueError, match="at most"):
        E.render_html(*graph, str(tmp_path / "q.html"), most=2)
    m = E.build_manifest(*graph, settings={"depth": 3})
    assert m["n_nodes"] == 3 and m["n_edges"] == 2 and m["status"] == {"root": 1, "analyzed": 1, "unavailable": 1} and m["root"]["id"] == "doi:1"


@pytest.mark.parametrize("text", ["{", "{}", '{"nodes": [{"title": "x"}]}'])
def test_bad_snapshots_are_refused(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ValueError, match="no snapshot"):
        load_baseline(spark, f"file:{tmp_path}/b.json")


@pytest.mark.parametrize(("value", "out"), [("2020", (2020, None)), ("2020-3", (2020, 3)), (" 2020-12 ", (2020, 12))])
def test_since(value, out):
    assert parse_since(value) == out


@pytest.mark.parametrize("value", ["", "20", "2020-13", "2020-0", "2020-01-01", "next"])
def test_bad_since_is_refused(value):
    with pytest.raises(ValueError, match="year or month"):
        parse_since(value)


def test_what_is_new(spark):
    from pyspark.sql import functions as F

    n = spark.createDataFrame([("a", 2021, None), ("b", 2019, None), ("c", None, None), ("d", 2020, "2020-02-01"), ("old", 2022, None)], "id string, year int, publication_date string")
    base = spark.createDataFrame([("old",)], "id string")
    got = {r.id: (r.is_new, r.unknown_date) for r in mark_nodes(n, base, "2020-03").collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, True), "d": (False, False), "old": (False, False)}
    assert {r.id for r in mark_nodes(n, base.limit(0), None).filter("is_new").collect()} == {"a", "b", "c", "d", "old"}
    assert mark_nodes(n, None, None).filter("is_new").count() == 0
    assert [r[0] for r in n.select(passes_since(F.col("year"), F.col("publication_date"), "2020")).collect()] == [True, False, None, True, True]
    e = spark.createDataFrame([("a", "b", "primary"), ("a", "b", "secondary")], "src string, dst string, edge_type string")
    assert {r.edge_type: r.is_new for r in mark_edges(e, e.limit(1)).collect()} == {"primary": False, "secondary": True}
