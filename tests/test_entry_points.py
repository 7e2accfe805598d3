import sys

import pytest

from refloom import cli
from refloom.settings import SETTINGS, load, read_file
from refloom.sources.root import root_id, root_source, route_url, supplied_files


@pytest.mark.parametrize(
    ("url", "out"),
    [
        ("https://arxiv.org/abs/1234.5678v2", ("arxiv", "1234.5678")),
        ("http://arxiv.org/pdf/1234.5678.pdf", ("arxiv", "1234.5678")),
        ("https://doi.org/10.1/A", ("doi", "10.1/a")),
        ("https://doi.org/10.48550/arXiv.1234.5678", ("arxiv", "1234.5678")),
        ("https://openreview.net/forum?id=aB-1&x=2", ("openreview", "aB-1")),
        ("https://www.biorxiv.org/content/10.1101/2020.01.01.1v3.full.pdf", ("doi", "10.1101/2020.01.01.1")),
        ("https://medrxiv.org/content/10.1101/2020.1v1", ("doi", "10.1101/2020.1")),
        ("https://papers.ssrn.com/sol3/papers.cfm?abstract_id=77", ("doi", "10.2139/ssrn.77")),
    ],
)
def test_addresses(url, out):
    assert route_url(url) == out


@pytest.mark.parametrize("url", ["https://example.org/x", "arxiv.org/abs/1", "", "ftp://arxiv.org/abs/1"])
def test_other_addresses_are_refused(url):
    with pytest.raises(ValueError, match="no known kind"):
        route_url(url)


def test_exactly_one_root():
    assert root_source(doi="10.48550/arxiv.1.2v3") == ("arxiv", "1.2") and root_source(arxiv_id="arXiv:1.2v1") == ("arxiv", "1.2") and root_source(pdf="a.pdf") == ("pdf", "a.pdf")
    for bad in ({}, {"doi": "x", "url": "y"}, {"doi": " "}):
        with pytest.raises(ValueError, match="is needed"):
            root_source(**bad)
    assert root_id("doi", "10.1/A") == "doi:10.1/a"
    with pytest.raises(ValueError, match="names no paper"):
        root_id("pdf", "x")


def test_supplied_files():
    assert supplied_files(["DOI:1=/a=b.pdf", "x = https://y", "doi:1=/c"]) == {"doi:1": "/c", "x": "https://y"}
    with pytest.raises(ValueError, match="ID=PATH"):
        supplied_files(["no path"])


def test_settings_by_priority(tmp_path):
    f = tmp_path / "s"
    f.write_text("# comment\ndepth_forward = 5\nsemantic_least='0.3'\nsearch_least = 80\n")
    s = load({"depth_forward": 7, "search_least": None}, {"REFLOOM_SEMANTIC_LEAST": "0.5"}, f)
    assert (s.depth_forward, s.semantic_least, s.search_least, s.batch_keys) == (7, 0.5, 80.0, SETTINGS.batch_keys)
    assert load({}, {}) == SETTINGS and read_file(tmp_path / "none") == {}
    with pytest.raises(ValueError, match="unknown"):
        load({"nothing": 1}, {})
    with pytest.raises(ValueError):
        load({}, {"REFLOOM_DEPTH_FORWARD": "x"})


def test_config_commands(tmp_path, capsys):
    f = tmp_path / "c" / "settings"
    run = lambda *a: cli.main(["--config", str(f), "config", *a])
    assert run("set", "api-key", "secret123") == 0 and run("set", "depth_forward", "2") == 0 and run("get", "depth_forward") == 0 and run("show") == 0
    out = capsys.readouterr().out
    assert "api_key = secr*****" in out and "secret123" not in out and f.stat().st_mode & 0o77 == 0
    assert run("clear", "api_key") == 0 and "api_key" not in read_file(f) and run("path") == 0 and run("set", "x") == 2 and run("get") == 2


def test_wrong_arguments():
    assert cli.main([]) == 2 and cli.main(["trace", "--data", "x"]) == 2
    assert cli.main(["trace", "--data", "x", "--keyword", "k"]) == 2 and cli.main(["trace", "--data", "x", "--keyword", "k", "--pdf", "a.pdf"]) == 4
    assert cli.main(["trace", "--data", "x", "--keyword", "k", "--doi", "a", "--url", "b"]) == 2


@pytest.fixture
def data(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("papers", [("doi:r", "We use a recurrent net [1]. More. Other words [2].", "R", None, "10.r", None)], "paper_id string, text string, title string, authors array<string>, doi string, arxiv_id string")
    put("inline_refs", [(1, "doi:r", "b1", 23, 26), (2, "doi:r", "b2", 46, 49)], "ref_id bigint, paper_id string, bib_key string, start_pos int, end_pos int")
    put("bib_entries", [(1, "doi:r", "b1", "One", "10.1", None), (2, "doi:r", "b2", "Two", "10.2", None)], "entry_id bigint, paper_id string, bib_key string, title string, doi string, arxiv_id string")
    node = "paper_id string, title string, authors array<string>, pub_year int, original_year int, publication_date string, doi string, arxiv_id string, abstract string, citation_count int, node_status string, depth int, url string, added_at string"
    put("paper_nodes", [(f"doi:{k}", t, [], y, y, None, f"10.{k}", None, None, 0, "analyzed", 0, None, "2024") for k, t, y in (("1", "One", 2001), ("2", "Two", 2002), ("c", "Citer", 2020))], node)
    put("citation_edges", [(1, "doi:c", "doi:1", "primary", 1, "a recurrent model", None), (2, "doi:2", "doi:1", "primary", 1, "nothing", None)], "edge_id bigint, source_id string, target_id string, edge_type string, depth int, context string, seen_at string")
    return str(tmp_path)


def test_trace_and_reverse_from_the_command_line(spark, data):
    import json

    assert cli.main(["trace", "--data", data, "--keyword", "recurrent", "--doi", "r", "--out", f"{data}/t.json", "--since", "2000"], spark) == 0
    doc = json.load(open(f"{data}/t.json", encoding="utf-8"))
    assert {(n["id"], n["status"], n["depth"]) for n in doc["nodes"]} == {("doi:r", "root", 0), ("doi:1", "unavailable", 1)} and [e["target"] for e in doc["edges"]] == ["doi:1"]
    assert next(n for n in doc["nodes"] if n["id"] == "doi:1")["is_new"] and doc["metadata"]["n_nodes"] == 2
    assert cli.main(["reverse", "--data", data, "--keyword", "recurrent", "--doi", "1", "--out", f"{data}/r.graphml"], spark) == 0
    text = open(f"{data}/r.graphml", encoding="utf-8").read()
    assert 'id="doi:c"' in text and 'id="doi:2"' not in text
    assert cli.main(["trace", "--data", data, "--keyword", "recurrent", "--doi", "r", "--baseline", f"{data}/t.json"], spark) == 0
    assert cli.main(["query", "none", "--data", data], spark) == 2


def test_entry_survives_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    from pathlib import Path

    root = Path(cli.__file__).parent.parent
    shutil.copytree(root / "refloom", tmp_path / "refloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kw_sentence_hits' in q and not any(k.startswith('p1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


def test_streams_equal_batches(spark, tmp_path):
    import datetime

    from refloom.streaming import monitor

    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    rows = [(i, "a", f"b{i % 3}", "primary", day(i % 4)) for i in range(12)] + [(50, "a", None, "primary", day(0)), (51, "A ", "a", "primary", day(1))]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "edge_id bigint, source_id string, target_id string, edge_type string, seen_at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/edges{k}")
    stream = lambda: monitor.edge_stream(spark, f"{tmp_path}/edges*", f"{tmp_path}/edges0", 1)
    counts = monitor.drain(monitor.window_counts(stream()), ["window", "edge_type"]).collect()
    assert sorted(r.n for r in counts) == [3, 3, 4, 4]
    old = spark.createDataFrame([("a", "b0", "primary")], "src string, dst string, edge_type string")
    assert {r.dst for r in monitor.new_edges(stream(), old).collect()} == {"b1", "b2"}
