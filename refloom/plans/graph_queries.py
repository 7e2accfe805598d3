"""Queries over the citation graph and over the neighbour graph of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.operators import graph as G
from refloom.operators import matching as M
from refloom.operators.export import graphml_edge, graphml_node, manifest
from refloom.operators.views import node_size, search, size_tier, spread, uncollide, visible
from refloom.plans.text_queries import _BAR, KEYWORDS
from refloom.sources.tables import table

DEPTH, LIMIT, ROUNDS = 3, 500, 20


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.node_view(table(spark, d, "paper_nodes")).withColumnsRenamed({"pub_year": "year", "node_status": "status"})


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_view(table(spark, d, "citation_edges"))


def _root(edges: DataFrame) -> DataFrame:
    """The paper that cites most others."""
    n = G.pairs(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "id").limit(1).select("id")


def _knn(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest_smaller(table(spark, d, "embeddings"), 3)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as dated papers: a year and a status by id and label."""
    status = F.when(F.col("label") % 3 == 0, "analyzed").otherwise("no_match")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.lit(1990) + F.pmod("vec_id", F.lit(35))).cast("int").alias("year"), status.alias("status"))


def node_first(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, the one added first for each id."""
    return _nodes(spark, d).select("id", "title", "year", "status")


def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Edges without loops, the first of each source, target and type."""
    return _edges(spark, d).select("src", "dst", "edge_type", "edge_id")


def bfs_forward(spark: SparkSession, d: str) -> DataFrame:
    """Papers within three citations of the paper that cites most."""
    e = _edges(spark, d)
    return G.bfs(e, _root(e), DEPTH)


def bfs_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose contexts name a keyword and that cite their way to the most cited paper."""
    e = M.credited_contexts(_edges(spark, d), KEYWORDS)
    n = G.pairs(e).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return G.reverse_trace(e, n.orderBy(F.col("n").desc(), "id").limit(1).select("id"), 2, LIMIT, 1)


def reverse_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first five citing rows of every paper."""
    return G.first_per_target(_edges(spark, d), 5).select("dst", "src", "edge_id", "rank")


def degree(spark: SparkSession, d: str) -> DataFrame:
    """In- and out-degree of every node."""
    return G.degrees(_edges(spark, d), _nodes(spark, d))


def pagerank_fixed(spark: SparkSession, d: str) -> DataFrame:
    """PageRank after twenty rounds."""
    return G.pagerank(_edges(spark, d), _nodes(spark, d), ROUNDS).select("id", F.round("pagerank", 9).alias("pagerank"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """PageRank until it settles."""
    return G.pagerank(_edges(spark, d), _nodes(spark, d)).select("id", F.round("pagerank", 6).alias("pagerank"))


def components(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected component of every node and edge end."""
    e = _edges(spark, d)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return G.components(e, _nodes(spark, d).select("id").union(ends))


def graph_global(spark: SparkSession, d: str) -> DataFrame:
    """Size, density, average degree and number of components of the graph on known nodes."""
    n = _nodes(spark, d)
    return G.graph_summary(G.inside(_edges(spark, d), n), n)


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's three most similar vectors of smaller id."""
    return _knn(spark, d).select("src", "dst", F.round("similarity", 4).alias("similarity"))


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness in the neighbour graph."""
    return G.betweenness(_knn(spark, d), _vectors(spark, d))


def pivots(spark: SparkSession, d: str) -> DataFrame:
    """Pivots of the neighbour graph."""
    e, n = _knn(spark, d), _vectors(spark, d)
    return G.pivots(n, G.components(e, n), G.betweenness(e, n), F.col("status") == "analyzed")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per year and the share of them with the keyword."""
    return G.timeline(_nodes(spark, d), F.col("status").isin("analyzed", "root"))


def year_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of every node by its year."""
    return G.year_levels(_nodes(spark, d))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of nodes, edges and statuses."""
    return manifest(_nodes(spark, d), _edges(spark, d))


def visible_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are not pending, sized by their visible primary citations."""
    n, _ = visible(_nodes(spark, d), _edges(spark, d), ["pending"], ["secondary"])
    return n.select("id", "shown_as", "visible_in_degree", F.round(node_size("degree", F.col("visible_in_degree"), F.col("status")), 6).alias("size"), size_tier(F.col("visible_in_degree")).alias("tier"))


def search_top8(spark: SparkSession, d: str) -> DataFrame:
    """The eight best nodes for a word."""
    return search(_nodes(spark, d), "learning")


def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    """GraphML elements of nodes and edges."""
    n = _nodes(spark, d).select("id", "title", "authors", "year", "status", "depth", "doi", "arxiv_id", "abstract", "citation_count", "url", "publication_date", "is_new")
    e = _edges(spark, d).withColumns({"no": F.col("edge_id"), "is_new": F.lit(False)})
    return n.select("id", graphml_node(n).alias("xml")).unionByName(e.select(F.concat(F.lit("e"), F.col("no").cast("string")).alias("id"), graphml_edge().alias("xml")))


def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects of nodes and edges."""
    keep = {"ignoreNullFields": "false"}
    n = _nodes(spark, d).select(F.to_json(F.struct("id", "title", "authors", "year", "publication_date", "status", "depth", "doi", "arxiv_id", "abstract", "citation_count", "url", "is_new"), keep).alias("json"))
    return n.unionByName(_edges(spark, d).select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), "depth", "context"), keep).alias("json")))


def layout(spark: SparkSession, d: str) -> DataFrame:
    """Nodes placed by year and depth, spread out, and set apart where they fall together."""
    p = _nodes(spark, d).filter("year is not null").select("id", (F.col("year") - 1970).cast("double").alias("x"), F.col("depth").cast("double").alias("y"))
    q = spread(uncollide(p), 1.5)
    return q.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


QUERIES = {f.__name__: f for f in (node_first, edge_dedupe, bfs_forward, bfs_reverse, reverse_limit, degree, pagerank_fixed, pagerank_converged, components, graph_global, knn_edges, betweenness, pivots, timeline, year_levels, manifest_counts, visible_graph, search_top8, graphml_lines, json_nodes, layout)}

NV = """nv as (select * replace (authors as authors), pub_year as year, node_status status from (select *, nullif(lower(trim(paper_id)), '') id from paper_nodes) where id is not null
  qualify row_number() over (partition by id order by added_at nulls last, url nulls last, title nulls last) = 1)"""
EV = """ev as (select * from (select edge_id, nullif(lower(trim(source_id)), '') src, nullif(lower(trim(target_id)), '') dst, edge_type, depth, context, seen_at from citation_edges) where src is not null and dst is not null and src <> dst
  qualify row_number() over (partition by src, dst, edge_type order by edge_id) = 1), pr as (select distinct src, dst from ev)"""
_ROOT = "root as (select src id from pr group by 1 order by count(*) desc, 1 limit 1)"
_CASE = "case " + " ".join(f"when regexp_matches(context, '{p}') then {i}" for i, p in enumerate(_BAR)) + " end"
_INE = "ine as (select src, dst from pr where src in (select id from nv) and dst in (select id from nv))"
_KNN = "knn as (select a.vec_id src, b.vec_id dst, list_dot_product(a.embedding::double[], b.embedding::double[]) v from embeddings a join embeddings b on b.vec_id < a.vec_id qualify row_number() over (partition by src order by v desc, dst) <= 3)"
_VEC = "vec as (select vec_id id, (1990 + vec_id % 35)::int as year, case when label % 3 = 0 then 'analyzed' else 'no_match' end status from embeddings)"


def _pagerank_sql() -> str:
    steps = ["with " + NV, EV, _INE, "ids as materialized (select id, count(*) over () n from nv)", "deg as materialized (select src, count(*) o from ine group by 1)", "w as materialized (select src, dst, 1.0::double / o w from ine join deg using (src))", "r0 as materialized (select id, n, 1.0::double / n r from ids)"]
    for k in range(1, ROUNDS + 1):
        steps.append(
            f"r{k} as materialized (select id, n, 0.85::double * (coalesce(got, 0) + (select coalesce(sum(r), 0) from r{k - 1} where id not in (select src from deg)) / n) + 0.15::double / n r "
            f"from ids left join (select dst id, sum(w * r) got from w join r{k - 1} on id = src group by 1) using (id))"
        )
    return ", ".join(steps) + f" select id, round(r, 9) pagerank from r{ROUNDS}"


def _component_sql(edges: str, ids: str, rounds: int = 12) -> str:
    steps = [f"und as materialized (select src a, dst b from {edges} union select dst, src from {edges})", f"c0 as materialized (select distinct id, id c from ({ids}))"]
    for k in range(1, rounds + 1):
        steps.append(f"c{k} as materialized (select x.id, least(x.c, coalesce(min(y.c), x.c)) c from c{k - 1} x left join und on und.a = x.id left join c{k - 1} y on y.id = und.b group by x.id, x.c)")
    return ", ".join(steps)


_BTW = """walk(s, v, d, c) as (select id, id, 0, 1::double from vec union all select s, dst, d + 1, sum(c) from walk join knn on knn.src = walk.v group by s, dst, d + 1),
  sp as materialized (select s, v, d, c from walk qualify row_number() over (partition by s, v order by d) = 1),
  btw as materialized (select id, round(coalesce(b, 0) / ((select count(*) from vec) - 1) / ((select count(*) from vec) - 2), 6) betweenness from vec left join
    (select x.v id, sum(x.c * y.c / z.c) b from sp x join sp y on y.s = x.v join sp z on z.s = x.s and z.v = y.v and z.d = x.d + y.d where x.s <> x.v and y.v <> x.v group by 1) using (id))"""
_TEXT = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_DATA = lambda k, c: f"chr(10) || '      <data key=\"{k}\">' || " + _TEXT(f"nullif(({c})::varchar, '')") + " || '</data>'"
_NODE_DATA = " || ".join(f"coalesce({_DATA(k, c)}, '')" for k, c in (("title", "title"), ("authors", "case when len(authors) > 0 then array_to_string(authors, ', ') end"), ("year", "year"), ("status", "status"), ("depth", "depth"), ("doi", "doi"), ("arxiv_id", "arxiv_id"), ("abstract", "abstract"), ("citation_count", "citation_count"), ("url", "url"), ("publication_date", "publication_date"), ("is_new", "case when is_new then 'True' end")))
_EDGE_DATA = " || ".join(f"coalesce({_DATA(k, c)}, '')" for k, c in (("edge_type", "edge_type"), ("edge_depth", "depth"), ("context", "context")))

ORACLES = {
    "node_first": f"with {NV} select id, title, year, status from nv",
    "edge_dedupe": f"with {EV} select src, dst, edge_type, edge_id from ev",
    "bfs_forward": f"with recursive {EV}, {_ROOT}, r(id, depth) as (select id, 0 from root union select dst, depth + 1 from r join pr on src = id where depth < {DEPTH}) select id, min(depth)::int depth from r group by 1",
    "bfs_reverse": f"""with recursive {EV}, lim as (select *, {_CASE} kw from ev qualify row_number() over (partition by dst order by edge_id) <= {LIMIT}),
        ok as materialized (select src citing, dst cited, count(*) n from lim where kw is not null group by all), root as (select dst id from pr group by 1 order by count(*) desc, 1 limit 1),
        r(id, depth) as (select id, 0 from root union select citing, depth + 1 from r join ok on cited = id where depth < 2), f as (select id, min(depth)::int depth from r group by 1)
        select f.id, f.depth, case when f.depth = 0 then 0 else (select max(n) from ok join f g on g.id = ok.cited and g.depth = f.depth - 1 where ok.citing = f.id) end n_contexts from f""",
    "reverse_limit": f"with {EV} select dst, src, edge_id, row_number() over (partition by dst order by edge_id)::int as rank from ev qualify rank <= 5",
    "degree": f"with {NV}, {EV} select id, coalesce(i, 0)::bigint in_degree, coalesce(o, 0)::bigint out_degree from nv left join (select dst id, count(*) i from pr group by 1) using (id) left join (select src id, count(*) o from pr group by 1) using (id)",
    "pagerank_fixed": _pagerank_sql(),
    "components": f"with {NV}, {EV}, " + _component_sql("pr", "select id from nv union select src from pr union select dst from pr") + " select id, c component from c12",
    "graph_global": f"with {NV}, {EV}, {_INE}, " + _component_sql("ine", "select id from nv") + """ select (select count(*) from nv) n_nodes, (select count(*) from ine) n_edges,
        round((select count(*) from ine) / ((select count(*) from nv) * ((select count(*) from nv) - 1))::double, 6) density, round(2 * (select count(*) from ine) / (select count(*) from nv)::double, 2) avg_degree, (select count(distinct c) from c12) n_components""",
    "knn_edges": f"with {_KNN} select src, dst, round(v, 4) similarity from knn",
    "betweenness": f"with recursive {_KNN}, {_VEC}, {_BTW} select id, betweenness from btw",
    "pivots": f"with recursive {_KNN}, {_VEC}, {_BTW}, " + _component_sql("knn", "select id from vec", 20) + """, f as (select c, id from vec join c20 using (id) where status = 'analyzed' qualify row_number() over (partition by c order by year, id) = 1)
        select id from f union select id from btw join vec using (id) where status = 'analyzed' and betweenness > 2 * (select avg(betweenness) from btw)""",
    "timeline": f"with {NV} select year, count(*) total, count(*) filter (status in ('analyzed', 'root')) with_keyword, round(count(*) filter (status in ('analyzed', 'root')) / count(*), 4) keyword_density from nv where year is not null group by 1",
    "year_levels": f"with {NV}, y as (select year, row_number() over (order by year) - 1 l from (select distinct year from nv where year is not null)) select id, nv.year, coalesce(l, (select count(*) from y))::int as level from nv left join y on nv.year = y.year",
    "manifest_counts": f"with {NV}, {EV} select 'nodes' item, count(*) n from nv union all select 'edges', count(*) from ev union all select 'status:' || coalesce(status, '?'), count(*) from nv group by 1",
    "visible_graph": f"""with {NV}, {EV}, vis as (select *, case when is_new then 'new' else coalesce(status, 'pending') end shown_as from nv where shown_as <> 'pending'),
        i as (select dst id, count(*) n from ev where edge_type <> 'secondary' and src in (select id from vis) and dst in (select id from vis) group by 1), j as (select vis.id, shown_as, status, coalesce(n, 0) n from vis left join i using (id))
        select id, shown_as, n visible_in_degree, round(least(80, case when status = 'root' then greatest(16 + 6 * sqrt(n), 30) else 16 + 6 * sqrt(n) end), 6) size, case when n <= 60 then 'small' when n <= 200 then 'medium' when n <= 600 then 'large' else 'huge' end tier from j""",
    "search_top8": f"""with {NV}, s as (select id, title, (case when contains(lower(coalesce(title, '')), 'learning') then 10 else 0 end + case when contains(lower(array_to_string(coalesce(authors, []), ' ')), 'learning') then 5 else 0 end)::int score from nv)
        select * from s where score > 0 order by score desc, id limit 8""",
    "graphml_lines": f"""with {NV}, {EV} select id, '    <node id="' || {_TEXT('id')} || '">' || {_NODE_DATA} || chr(10) || '    </node>' as xml from nv
        union all select 'e' || edge_id, '    <edge id="e' || edge_id || '" source="' || {_TEXT('src')} || '" target="' || {_TEXT('dst')} || '">' || {_EDGE_DATA} || chr(10) || '    </edge>' from ev""",
    "json_nodes": f"""with {NV}, {EV} select to_json(struct_pack(id, title, authors, "year" := year, publication_date, status, depth, doi, arxiv_id, abstract, citation_count, url, is_new))::varchar as json from nv
        union all select to_json(struct_pack("source" := src, "target" := dst, "type" := edge_type, depth, context))::varchar from ev""",
    "layout": f"""with {NV}, p as (select id, (year - 1970)::double x, depth::double y from nv where year is not null), c as (select *, count(*) over (partition by x, y) n, row_number() over (partition by x, y order by id) - 1 k from p),
        q as (select id, case when n > 1 then x - (n - 1) * 120.0 / 2 + k * 120.0 else x end x, y from c), m as (select avg(x) cx, avg(y) cy from q) select id, round(cx + (x - cx) * 1.5, 3) x, round(cy + (y - cy) * 1.5, 3) y from q, m""",
}
