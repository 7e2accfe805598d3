"""Queries over texts: passages, references beside them, document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.functions import texts as T
from refloom.operators import matching as M
from refloom.operators import search as S
from refloom.operators import tei
from refloom.operators.graph import nearest
from refloom.operators.views import highlight_spans
from refloom.sources.tables import table

#: Likeness asked for among the test vectors, few of which are nearer to each other.
SEMANTIC_DEMO = 0.20
KEYWORDS = ["recurrent", "tensor factorisation", "baseline"]


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", "text")


def kw_sentence_hits(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of papers that mention a keyword, each with the next one."""
    return M.sentence_hits(_papers(spark, d), "paper_id", KEYWORDS).select("paper_id", "keyword", "sent_no", "start_pos", "end_pos", "passage")


def kw_count_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the first keyword per document."""
    n = F.regexp_count("text", F.lit(M.build_pattern(KEYWORDS[0])))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).filter("n > 0")


def kw_char_window(spark: SparkSession, d: str) -> DataFrame:
    """Every mention in documents with 40 characters on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.windows(S.mentions(docs, "doc_id", KEYWORDS[:1]), S.CHARACTERS, 40).select("doc_id", "start_pos", "end_pos", F.col("passage").alias("snippet"))


def kw_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every mention in papers with its sentence and window."""
    found = S.windows(S.mentions(_papers(spark, d), "paper_id", KEYWORDS))
    return found.select("paper_id", "kw_no", "start_pos", "end_pos", "sent_no", "win_start", "win_end", "passage")


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents searched by pattern and by meaning: a sentence has the vector of its document and number, a keyword that of its place."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.max("vec_id") + 1).first()[0]  # a number
    place = S.sentences(docs, "doc_id").select("doc_id", "sent_no", F.pmod(F.col("doc_id") * 7 + F.col("sent_no"), F.lit(n)).alias("vec_id"))
    queries = v.filter(F.col("vec_id") < len(KEYWORDS)).select(F.col("vec_id").cast("int").alias("kw_no"), F.col("embedding").alias("query"))
    hits = S.search(docs, "doc_id", KEYWORDS, vectors=place.join(v, "vec_id").drop("vec_id"), queries=queries)
    return hits.select("doc_id", "kw_no", "match_type", "start_pos", "end_pos", "win_end", F.round("score", 4).alias("score"))


def kw_match_mode(spark: SparkSession, d: str) -> DataFrame:
    """Papers that mention any or all of the keywords."""
    return M.match_mode(_papers(spark, d), "paper_id", KEYWORDS)


def window_refs(spark: SparkSession, d: str) -> DataFrame:
    """Reference keys inside the window of each hit."""
    refs = table(spark, d, "inline_refs").filter("bib_key is not null").select("paper_id", F.lower(F.trim("bib_key")).alias("bib_key"), F.col("start_pos").alias("ref_start"), F.col("end_pos").alias("ref_end"))
    hits = M.sentence_hits(_papers(spark, d), "paper_id", KEYWORDS)
    return M.refs_in_windows(hits, refs, "paper_id").select("paper_id", "keyword", "sent_no", "ref_keys", "n_refs")


def hit_ref_contexts(spark: SparkSession, d: str) -> DataFrame:
    """For each paper and reference key the first passage of its hits."""
    return M.first_seen_keys(table(spark, d, "keyword_hits"), "paper_id")


def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hits per paper by kind, the best score, and the first five hits."""
    h = table(spark, d, "keyword_hits")
    return h.groupBy("paper_id").agg(F.count_if(F.col("match_type") == "regex").alias("n_regex"), F.count_if(F.col("match_type") == "semantic").alias("n_semantic"), F.max("semantic_score").alias("best_score"), F.array_join(F.slice(F.array_sort(F.collect_list("hit_id")), 1, 5), " ").alias("first_hits"))  # one paper's hits


def ref_to_bib(spark: SparkSession, d: str) -> DataFrame:
    """Inline references with the title of their entry."""
    norm = F.regexp_replace(F.lower(F.trim("bib_key")), "^#", "")
    refs = table(spark, d, "inline_refs").filter("bib_key is not null").select("ref_id", "paper_id", norm.alias("bib_key"))
    bib = table(spark, d, "bib_entries").select("entry_id", "paper_id", norm.alias("bib_key"), "title")
    return M.references_of(refs, bib).select("ref_id", "entry_id", "title")


def reverse_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Citation contexts credited to the first keyword that they mention."""
    e = M.credited_contexts(table(spark, d, "citation_edges").select("edge_id", "context"), KEYWORDS)
    return e.filter("kw_no is not null").select("edge_id", "kw_no")


def semantic_hits(spark: SparkSession, d: str) -> DataFrame:
    """Vectors close to the first one that do not share its label."""
    v = table(spark, d, "embeddings")
    seed = v.orderBy("vec_id").limit(1).collect()[0]  # the question
    s = M.dot(F.col("embedding"), list(seed["embedding"]))
    return v.filter(F.col("label") != seed["label"]).select("vec_id", F.round(s, 4).alias("score")).filter(F.col("score") >= SEMANTIC_DEMO)


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors closest to the first one."""
    v = table(spark, d, "embeddings")
    seed = v.orderBy("vec_id").limit(1).collect()[0]  # the question
    s = M.dot(F.col("embedding"), list(seed["embedding"]))
    return v.filter(F.col("vec_id") != seed["vec_id"]).select("vec_id", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(10)


def semantic_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors closest to each vector whose id is divisible by 50, among all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(v.filter(F.col("vec_id") % 50 == 0), v, 10).select("src", "dst", F.round("similarity", 6).alias("score"))


def math_noise(spark: SparkSession, d: str) -> DataFrame:
    """Lines of papers with three mathematical letters or more, and with three signs of punctuation or more."""
    lines = _papers(spark, d).select("paper_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("paper_id", "line_no", T.math_chars(F.col("line")).alias("n_math"), F.regexp_count("line", F.lit(r"[()=<>%+*/]")).alias("n_signs")).filter("n_math >= 3 or n_signs >= 3")


def numbered_ref_expand(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in brackets, ranges spelled out, that are keys of the paper's entries."""
    marks = _papers(spark, d).select("paper_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[([0-9]+(?:\s*[-,]\s*[0-9]+)*)\]"), F.lit(1))).alias("mark_no", "mark"))
    parts = marks.select("paper_id", "mark_no", F.explode(F.split("mark", ",")).alias("p"))
    a, b = (F.try_element_at(F.split(F.trim("p"), r"\s*-\s*"), F.lit(i)).try_cast("int") for i in (1, 2))
    ends = parts.select("paper_id", "mark_no", a.alias("a"), F.coalesce(b, a).alias("b")).filter("a <= b")
    nums = ends.select("paper_id", "mark_no", F.explode(F.sequence("a", "b")).alias("n"))
    keys = table(spark, d, "bib_entries").select("paper_id", F.lower(F.trim("bib_key")).alias("bib_key")).distinct()
    return nums.select("paper_id", "mark_no", F.concat(F.lit("b"), F.col("n").cast("string")).alias("bib_key")).join(keys, ["paper_id", "bib_key"], "left_semi")


def numbered_entries(spark: SparkSession, d: str) -> DataFrame:
    """A plain reference list of each paper, numbered, and split again into its entries."""
    bib = table(spark, d, "bib_entries").filter("raw <> ''").select("paper_id", "entry_id", F.regexp_replace("raw", r"\s+", " ").alias("raw"))
    lists = bib.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "raw"))).alias("x"))  # bounded by one paper's list
    text = F.array_join(F.transform("x", lambda e, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), e["raw"])), "")
    pieces = lists.select("paper_id", F.split(text, r"\n\s*\[[0-9]+\]\s*").alias("p"), F.regexp_extract_all(text, F.lit(r"\n\s*\[([0-9]+)\]\s*"), F.lit(1)).alias("k"))
    rows = pieces.select("paper_id", F.posexplode("k").alias("i", "key"), "p").select("paper_id", F.concat(F.lit("b"), "key").alias("bib_key"), F.get("p", F.col("i") + 1).alias("raw"))
    return rows.filter(F.trim("raw") != "").select("paper_id", "bib_key", F.nullif(F.regexp_extract("raw", r"\b(?:19|20)[0-9]{2}\b", 0), F.lit("")).try_cast("int").alias("year"), F.substring(F.trim("raw"), 1, 200).alias("title"))


def surname_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose first surname and year no other entry of the paper shares."""
    words = F.filter(F.split(F.regexp_replace(F.get("authors", F.lit(0)), ",", " "), " +"), lambda w: (w != "") & ~F.lower(F.rtrim(w, F.lit("."))).isin("jr", "sr", "ii", "iii", "iv"))
    name = F.lower(F.rtrim(F.try_element_at(words, F.lit(-1)), F.lit(".,;:")))
    b = table(spark, d, "bib_entries").select("paper_id", "entry_id", name.alias("surname"), F.col("pub_year").alias("year")).filter("length(surname) > 1 and year is not null")
    one = b.groupBy("paper_id", "surname", "year").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("entry_id"))
    return one.filter("n = 1").select("paper_id", "entry_id", "surname", "year")


def inverted_index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents rebuilt from an index of words to positions."""
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    pos = docs.select("doc_id", F.posexplode("w").alias("p", "word")).groupBy("doc_id", "word").agg(F.collect_list("p").alias("ps"))
    index = pos.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "ps"))).alias("index"))  # one document's words
    return index.select("doc_id", F.size("index").alias("n_words"), F.md5(T.from_inverted_index(F.col("index")).cast("binary")).alias("digest"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Labels, search words, phrases, file names, escaped and masked forms of titles."""
    b = table(spark, d, "bib_entries").filter("title is not null")
    t = F.col("title")
    return b.select(
        "entry_id", T.short_label(t, F.col("pub_year")).alias("label"), T.query_words(t).alias("words"), T.query_phrase(t).alias("phrase"), T.safe_filename(t).alias("file"),
        T.escape_xml(t).alias("xml"), T.mask(F.col("bib_key")).alias("masked"), T.keyword_color(F.col("entry_id")).alias("color"),
    )


def session_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of each paper's reference keys."""
    b = table(spark, d, "inline_refs").filter("bib_key is not null").groupBy("paper_id").agg(F.collect_set(F.lower(F.trim("bib_key"))).alias("ids"))
    return b.select("paper_id", T.fnv1a(F.col("ids")).alias("hash"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Spans to highlight in the passages of hits."""
    return highlight_spans(table(spark, d, "keyword_hits").select(F.col("hit_id").cast("string").alias("id"), F.col("passage").alias("text")), KEYWORDS)


def _tei_documents(spark: SparkSession, d: str) -> DataFrame:
    """Papers as structured documents: header, a paragraph a line, numbers in brackets as references, the paper's entries as bibliography."""
    plain = lambda c: T.escape_xml(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", ""))
    marked = F.regexp_replace(plain("text"), r"\[([0-9]+)\]", '<ref type="bibr" target="#b$1">[$1]</ref>')
    body = F.concat(F.lit("<p>"), F.replace(marked, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    wrap = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), plain(c), F.lit(f"</{tag.split()[0]}>")), F.lit(""))
    people = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><persName>"), wrap("surname", a), F.lit("</persName></author>"))), "")
    year = lambda c: F.coalesce(F.concat(F.lit('<date when="'), c.cast("string"), F.lit('-01-01"/>')), F.lit(""))
    idno = F.concat(wrap('idno type="DOI"', F.col("doi")), wrap('idno type="arXiv"', F.col("arxiv_id")))
    entry = F.struct(
        "entry_id",
        F.concat(
            F.lit('<biblStruct xml:id="'), plain("bib_key"), F.lit('"><analytic>'), wrap('title type="main"', F.col("title")), people(F.col("authors")), idno, F.lit("</analytic><monogr><imprint>"), year(F.col("pub_year")),
            F.lit("</imprint></monogr>"), wrap('note type="raw_reference"', F.col("raw")), F.lit("</biblStruct>"),
        ).alias("x"),
    )
    bib = table(spark, d, "bib_entries").filter("bib_key is not null").select("paper_id", entry.alias("e"))
    bib = bib.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "").alias("bib"))  # one paper's list
    papers = table(spark, d, "papers").filter("text is not null").join(bib, "paper_id", "left")
    head = F.concat(
        F.lit("<teiHeader><fileDesc><titleStmt>"), wrap("title", F.coalesce("title", F.lit(""))), F.lit("</titleStmt><publicationStmt>"), year(F.col("pub_year")), F.lit("</publicationStmt><sourceDesc><biblStruct><analytic>"),
        people(F.col("authors")), F.lit("</analytic>"), idno, F.lit("</biblStruct></sourceDesc></fileDesc></teiHeader>"),
    )
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0">'), head, F.lit("<text><body><div>"), body, F.lit("</div></body><back><div><listBibl>"), F.coalesce("bib", F.lit("")), F.lit("</listBibl></div></back></text></TEI>"))
    return papers.select(F.col("paper_id").alias("id"), xml.alias("xml"))


def tei_parse(spark: SparkSession, d: str) -> DataFrame:
    """Structured documents parsed into text and marked references."""
    p = tei.parse_documents(_tei_documents(spark, d))
    mark = F.filter("refs", lambda r: F.substr("text", r["start_pos"] + 1, F.lit(1)) == "[")
    return p.select(F.col("id").alias("paper_id"), "title", F.size(mark).alias("n_refs"), F.length("text").alias("n_chars"))


def tei_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of structured documents."""
    p = tei.parse_documents(_tei_documents(spark, d))
    return p.select(F.col("id").alias("paper_id"), F.array_join("authors", "; ").alias("authors"), "year", "doi", "arxiv_id")


def tei_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Bibliographies of structured documents; of a key that comes twice the later entry counts."""
    b = tei.parse_documents(_tei_documents(spark, d)).select(F.col("id").alias("paper_id"), F.explode("bib").alias("b"))
    return b.select("paper_id", "b.bib_key", "b.title", F.array_join("b.authors", "; ").alias("authors"), "b.year", "b.doi", "b.arxiv_id", F.length("b.raw").alias("raw_chars"))


def tei_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Lines of structured documents that are left when breaks inside sentences are joined."""
    p = tei.parse_documents(_tei_documents(spark, d))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return p.select(F.col("id").alias("paper_id"), F.size(lines).alias("n_lines"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Entries as they would be cited by name: surname and year in three forms."""
    words = F.filter(F.split(F.regexp_replace(F.get("authors", F.lit(0)), ",", " "), " +"), lambda w: (w != "") & ~F.lower(F.rtrim(w, F.lit("."))).isin("jr", "sr", "ii", "iii", "iv"))
    name = F.rtrim(F.try_element_at(words, F.lit(-1)), F.lit(".,;:"))
    b = table(spark, d, "bib_entries").filter("bib_key is not null and pub_year is not null").select("paper_id", "entry_id", "bib_key", "authors", F.col("pub_year").alias("year"), name.alias("name"))
    return b.filter(F.col("name").rlike(r"^\p{L}{2,}$"))


def narrative_refs(spark: SparkSession, d: str) -> DataFrame:
    """Citations by surname and year, found in texts that cite every entry of a paper in three ways."""
    cite = F.concat(F.lit("See "), F.col("name"), F.lit(" et al., "), F.col("year"), F.lit(" or "), F.col("name"), F.lit(" and Other ("), F.col("year"), F.lit(") or "), F.col("name"), F.lit(" ("), F.col("year"), F.lit("). "))
    told = _told(spark, d).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "bib_key", "authors", "year", cite.alias("cite")))).alias("x"))  # one paper's list
    docs = told.select("paper_id", F.array_join(F.col("x.cite"), "").alias("text"), F.transform("x", lambda e: F.struct(e["bib_key"].alias("bib_key"), e["authors"].alias("authors"), e["year"].alias("year"))).alias("bib"), F.lit(None).cast("array<struct<start_pos: int, end_pos: int>>").alias("known"))
    return tei.narrative_spans(docs)


def plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """Papers as plain text with a numbered list of references, parted and read again."""
    bib = table(spark, d, "bib_entries").select("paper_id", "entry_id", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("raw")).filter("raw <> ''")
    lists = bib.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "raw"))).alias("x"))  # one paper's list
    listed = F.array_join(F.transform("x", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["raw"])), "\n")
    text = F.concat(F.lit("As shown [1, 3-5] and [2; 9000].\nReferences\n"), listed)
    p = tei.parse_plain_documents(lists.select(F.col("paper_id").alias("id"), text.alias("text")))
    return p.select(F.col("id").alias("paper_id"), F.length("text").alias("body_chars"), F.size("bib").alias("n_entries"), F.array_join(F.transform("refs", lambda r: r["bib_key"]), " ").alias("ref_keys"), F.element_at("bib", -1)["raw"].alias("last_raw"))


QUERIES = {f.__name__: f for f in (kw_sentence_hits, kw_count_per_doc, kw_char_window, kw_match_mode, window_refs, hit_ref_contexts, hit_summary, ref_to_bib, reverse_contexts, semantic_hits, semantic_topk, semantic_neighbours, math_noise, numbered_ref_expand, numbered_entries, surname_signatures, inverted_index_roundtrip, text_functions, session_hash, highlights, tei_parse, narrative_refs, kw_mentions, search_hits, tei_headers, tei_bibliography, tei_rejoined, plain_documents)}

# Patterns written out once more, in the checking engine's own notation, so that the check does not lean on the code it checks.
_BAR = [r"(?i)(?:^|[^\pL\pM\pN_])" + p + r"[\pL\pM\pN_]*" for p in ("recurre", r"tensor[\s-]?factorisati", "baseli")]
_K = ", ".join(f"({i}, '{k}', '{p}')" for i, (k, p) in enumerate(zip(("recurrent", "tensor factorisation", "baseline"), _BAR, strict=True)))
_TILE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
_MATH = "[\U0001d400-\U0001d7ffℂℍℕℙℚℝℤ∈∉∋∀∃∅⊂⊃⊆⊇⊕⊗]"
_SENT = rf"""
with kw(kw_no, keyword, pattern) as (values {_K}),
cutted as (select paper_id, regexp_extract_all(text, '{_TILE}') pieces from papers where text is not null),
sent as (select paper_id, pieces, unnest(pieces) piece, generate_subscripts(pieces, 1) i from cutted),
hits as (
  select paper_id, kw_no, keyword, i - 1 sent_no, coalesce(list_sum(list_transform(pieces[1:i - 1], lambda x: length(x))), 0)::int start_pos, length(piece) n, length(coalesce(pieces[i + 1], '')) m,
    trim(regexp_replace(piece || coalesce(pieces[i + 1], ''), '\s+', ' ', 'g')) passage
  from sent, kw where regexp_matches(piece, pattern))
"""
# Mentions: the text falls apart at them; what lies between gives the offsets. The letter before a mention is no part of it.
_MENTIONS = lambda src, key, kws: rf"""
with kw(kw_no, keyword, pattern) as (values {kws}),
src as ({src}),
m as (select {key}, text, kw_no, regexp_extract_all(text, pattern) ms, regexp_split_to_array(text, pattern) gaps from src, kw where regexp_matches(text, pattern)),
u as (select {key}, text, kw_no, unnest(ms) hit, generate_subscripts(ms, 1) i, ms, gaps from m),
spots as (select *, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int p from u),
found as (select {key}, text, kw_no, (p + case when regexp_matches(hit, '(?i)^[rtb]') then 0 else 1 end)::int start_pos, (p + length(hit))::int end_pos from spots)
"""  # noqa: E731
_COUNT = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in _BAR)
_SOME = " + ".join(f"(len(regexp_extract_all(text, '{p}')) > 0)::int" for p in _BAR)
_CLEAN = lambda c: rf"nullif(trim(regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(12288)), '')"
_ARXIV = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^arxiv:\s*', ''), '\s*\[[^\]]*\]\s*', '', 'g'), 'v[0-9]+$', '')), '')"
_SEED = "seed as (select * from embeddings order by vec_id limit 1), sims as (select e.vec_id, e.label, s.vec_id sid, s.label slabel, list_dot_product(e.embedding::double[], s.embedding::double[]) v from embeddings e, seed s)"
ORACLES = {
    "kw_sentence_hits": _SENT + "select paper_id, keyword, sent_no, start_pos, start_pos + n end_pos, passage from hits",
    "kw_count_per_doc": f"select doc_id, len(regexp_extract_all(text, '{_BAR[0]}')) n from documents where regexp_matches(text, '{_BAR[0]}')",
    "kw_char_window": _MENTIONS("select doc_id, text from documents where text is not null", "doc_id", f"(0, 'recurrent', '{_BAR[0]}')")
    + r"select doc_id, start_pos, end_pos, trim(regexp_replace(substr(text, greatest(start_pos - 40, 0) + 1, least(length(text), end_pos + 40) - greatest(start_pos - 40, 0)), '\s+', ' ', 'g')) snippet from found",
    "kw_mentions": _MENTIONS("select paper_id, text from papers where text is not null", "paper_id", _K)
    + rf""", s as (select *, regexp_extract_all(text, '{_TILE}') pieces from found),
        e as (select *, list_transform(generate_series(1, len(pieces)), lambda k: list_sum(list_transform(pieces[1:k], lambda x: length(x)))::int) ends from s),
        n as (select *, len(list_filter(ends, lambda x: x <= start_pos))::int sent_no from e),
        w as (select *, case when sent_no > 0 then ends[sent_no] else 0 end win_start, coalesce(ends[sent_no + 2], ends[sent_no + 1]) win_end from n)
        select paper_id, kw_no, start_pos, end_pos, sent_no, win_start, win_end, trim(regexp_replace(substr(text, win_start + 1, win_end - win_start), '\s+', ' ', 'g')) passage from w""",
    "search_hits": _MENTIONS("select doc_id, text from documents where text is not null", "doc_id", _K)
    + rf""", t as (select doc_id, regexp_extract_all(text, '{_TILE}') pieces from src),
        p as (select doc_id, unnest(pieces) piece, generate_subscripts(pieces, 1) - 1 sent_no, pieces from t),
        s as (select *, coalesce(list_sum(list_transform(pieces[1:sent_no], lambda x: length(x))), 0)::int a, coalesce(pieces[sent_no + 2], '') nxt from p),
        hit as (select distinct f.doc_id, f.kw_no, s.sent_no from found f join s on s.doc_id = f.doc_id and f.start_pos >= s.a and f.start_pos < s.a + length(s.piece)),
        sem as (select s.doc_id, kw.kw_no, s.sent_no, s.a, s.piece, s.nxt, list_dot_product(e.embedding::double[], q.embedding::double[]) score from s
          join embeddings e on e.vec_id = (s.doc_id * 7 + s.sent_no) % (select max(vec_id) + 1 from embeddings) join kw on true join embeddings q on q.vec_id = kw.kw_no where length(trim(s.piece)) >= 10)
        select f.doc_id, f.kw_no, 'regex' match_type, f.start_pos, f.end_pos, s.a + length(s.piece) + length(s.nxt) win_end, null::double score from found f join s on s.doc_id = f.doc_id and f.start_pos >= s.a and f.start_pos < s.a + length(s.piece)
        union all select doc_id, kw_no, 'semantic', a, a + length(piece), a + length(piece) + length(nxt), round(score, 4) from sem where score >= 0.4 and (doc_id, kw_no, sent_no) not in (select (doc_id, kw_no, sent_no) from hit)""",
    "highlights": _MENTIONS("select hit_id::varchar id, passage as text from keyword_hits where passage is not null", "id", _K) + "select id, start_pos, end_pos, kw_no from found",
    "kw_match_mode": f"select paper_id, ({_SOME})::int n_keywords, ({_COUNT})::int n_hits, true matches_any, ({_SOME}) = {len(KEYWORDS)} matches_all from papers where ({_SOME}) > 0",
    "window_refs": _SENT + """, j as (select h.paper_id, keyword, kw_no, sent_no, lower(trim(bib_key)) k, min(r.start_pos) p from hits h join inline_refs r on r.paper_id = h.paper_id and r.bib_key is not null
          and r.start_pos >= h.start_pos and r.end_pos <= h.start_pos + n + m group by all)
        select paper_id, keyword, sent_no, string_agg(k, ' ' order by p, k) ref_keys, count(*) n_refs from j group by paper_id, keyword, kw_no, sent_no""",
    "hit_ref_contexts": """with x as (select paper_id, hit_id, passage, unnest(ref_keys) bib_key, generate_subscripts(ref_keys, 1) pos from keyword_hits)
        select paper_id, bib_key, passage, hit_id first_hit_id from x qualify row_number() over (partition by paper_id, bib_key order by hit_id, pos) = 1""",
    "hit_summary": "select paper_id, count(*) filter (match_type = 'regex') n_regex, count(*) filter (match_type = 'semantic') n_semantic, max(semantic_score) best_score, array_to_string(list_sort(list(hit_id))[1:5], ' ') first_hits from keyword_hits group by 1",
    "ref_to_bib": """with b as (select *, regexp_replace(lower(trim(bib_key)), '^#', '') k from bib_entries qualify row_number() over (partition by paper_id, k order by entry_id desc) = 1)
        select ref_id, entry_id, title from inline_refs r join b on r.paper_id = b.paper_id and regexp_replace(lower(trim(r.bib_key)), '^#', '') = b.k""",
    "reverse_contexts": f"select edge_id, case when regexp_matches(context, '{_BAR[0]}') then 0 when regexp_matches(context, '{_BAR[1]}') then 1 when regexp_matches(context, '{_BAR[2]}') then 2 end::int kw_no from citation_edges where kw_no is not null",
    "semantic_hits": f"with {_SEED} select vec_id, round(v, 4) score from sims where label <> slabel and round(v, 4) >= {SEMANTIC_DEMO}",
    "semantic_topk": f"with {_SEED} select vec_id, round(v, 6) score from sims where vec_id <> sid order by score desc, vec_id limit 10",
    "semantic_neighbours": """with s as (select a.vec_id src, b.vec_id dst, list_dot_product(a.embedding::double[], b.embedding::double[]) v from embeddings a join embeddings b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id)
        select src, dst, round(v, 6) score from s qualify row_number() over (partition by src order by v desc, dst) <= 10""",
    "math_noise": rf"""with l as (select paper_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from papers),
        c as (select paper_id, line_no::int line_no, len(regexp_extract_all(line, '{_MATH}'))::int n_math, len(regexp_extract_all(line, '[()=<>%+*/]'))::int n_signs from l)
        select * from c where n_math >= 3 or n_signs >= 3""",
    "numbered_ref_expand": r"""with m as (select paper_id, regexp_extract_all(text, '\[([0-9]+(?:\s*[-,]\s*[0-9]+)*)\]', 1) ms from papers),
        u as (select paper_id, unnest(ms) mark, generate_subscripts(ms, 1) - 1 mark_no from m),
        p as (select paper_id, mark_no, trim(unnest(string_split(mark, ','))) p from u),
        e as (select paper_id, mark_no, try_cast(regexp_extract(p, '^\s*([0-9]+)', 1) as int) a, coalesce(try_cast(nullif(regexp_extract(p, '-\s*([0-9]+)$', 1), '') as int), try_cast(regexp_extract(p, '^\s*([0-9]+)', 1) as int)) b from p),
        n as (select paper_id, mark_no, unnest(generate_series(a, b)) n from e where a <= b)
        select paper_id, mark_no, 'b' || n bib_key from n where exists (select 1 from bib_entries b where b.paper_id = n.paper_id and lower(trim(b.bib_key)) = 'b' || n.n)""",
    "numbered_entries": r"""with b as (select paper_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) raw, row_number() over (partition by paper_id order by entry_id) i from bib_entries where raw <> '')
        select paper_id, 'b' || i bib_key, try_cast(nullif(regexp_extract(raw, '\b(?:19|20)[0-9]{2}\b'), '') as int) as year, substr(raw, 1, 200) title from b where raw <> ''""",
    "surname_signatures": r"""with w as (select paper_id, entry_id, pub_year, list_filter(regexp_split_to_array(replace(authors[1], ',', ' '), ' +'), lambda w: w <> '' and lower(rtrim(w, '.')) not in ('jr', 'sr', 'ii', 'iii', 'iv')) ws from bib_entries),
        b as (select paper_id, entry_id, lower(rtrim(ws[-1], '.,;:')) surname, pub_year from w where pub_year is not null)
        select paper_id, min(entry_id) entry_id, surname, pub_year as year from b where length(surname) > 1 group by paper_id, surname, pub_year having count(*) = 1""",
    "inverted_index_roundtrip": r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') ws from documents where text is not null)
        select doc_id, len(list_distinct(ws))::int n_words, md5(array_to_string(ws, ' ')) digest from w where len(ws) > 0""",
    "text_functions": rf"""with b as (select *, trim(title) t from bib_entries where title is not null),
        e as (select *, list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{4,}}'), lambda w: w not in ({', '.join(f"'{w}'" for w in T.STOPWORDS)}))[1:8] ws from b)
        select entry_id, (case when length(t) > 50 then substr(t, 1, 49) || '…' else t end) || coalesce(' (' || pub_year || ')', '') as label, array_to_string(ws, ' ') words,
          substr(trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), 1, 200) phrase, substr(regexp_replace(title, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 100) file,
          replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') xml,
          case when length(bib_key) <= 4 then repeat('*', length(bib_key)) else substr(bib_key, 1, 4) || repeat('*', length(bib_key) - 4) end masked,
          [{', '.join(f"'{c}'" for c in T.COLORS)}][(entry_id % 6 + 1)::int] color from e""",
    "session_hash": """with ids as (select paper_id, array_to_string(list_sort(list_distinct(list(lower(trim(bib_key))))), '|') s from inline_refs where bib_key is not null group by 1)
        select paper_id, lpad(lower(hex(list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(s, ''), lambda c: ord(c)::hugeint)), lambda h, c: (xor(h::ubigint, c::ubigint)::hugeint * 16777619) % 4294967296)::ubigint)), 8, '0') as hash from ids""",
    "tei_parse": r"""select paper_id, nullif(trim(title), '') title, len(regexp_extract_all(text, '\[[0-9]+\]'))::int n_refs,
        (length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) + 2)::int n_chars from papers where text is not null""",
    "tei_headers": rf"""select paper_id, coalesce(array_to_string(list_filter(list_transform(authors, lambda a: trim(a)), lambda a: a <> ''), '; '), '') authors, case when pub_year between 1900 and 2099 then pub_year end as year,
        nullif(regexp_replace(lower(trim(doi)), '^https?://(dx\.)?doi\.org/', ''), '') doi, {_ARXIV} arxiv_id from papers where text is not null""",
    "tei_bibliography": rf"""with b as (select * from bib_entries where bib_key is not null and bib_key <> '' and paper_id in (select paper_id from papers where text is not null) qualify row_number() over (partition by paper_id, bib_key order by entry_id desc) = 1)
        select paper_id, bib_key, {_CLEAN('title')} title, coalesce(array_to_string(list_filter(list_transform(authors, lambda a: {_CLEAN('a')}), lambda a: a <> ''), '; '), '') authors, case when pub_year between 1900 and 2099 then pub_year end as year,
        nullif(regexp_replace(lower(trim(doi)), '^https?://(dx\.)?doi\.org/', ''), '') doi, {_ARXIV} arxiv_id, coalesce(length({_CLEAN('raw')}), 0)::int raw_chars from b""",
    "tei_rejoined": r"""with t as (select paper_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') text from papers where text is not null),
        x as (select paper_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) line, generate_subscripts(string_split(replace(text, chr(13), chr(10)), chr(10)), 1) i from t),
        k as (select * from x where not regexp_matches(line, '^[\s\p{Z}]*$')), o as (select *, lag(line) over (partition by paper_id order by i) prev from k)
        select paper_id, count(*) filter (prev is null or not regexp_matches(line, '^[\s\p{Z}]*[a-z(]') or regexp_matches(prev, '[.!?"]$'))::int n_lines from o group by 1""",
    "narrative_refs": r"""with w as (select paper_id, entry_id, bib_key, pub_year, list_filter(regexp_split_to_array(replace(authors[1], ',', ' '), ' +'), lambda w: w <> '' and lower(rtrim(w, '.')) not in ('jr', 'sr', 'ii', 'iii', 'iv')) ws from bib_entries where bib_key is not null and pub_year is not null),
        b as (select paper_id, entry_id, bib_key, pub_year, rtrim(ws[-1], '.,;:') n from w where regexp_matches(rtrim(ws[-1], '.,;:'), '^\pL{2,}$')),
        p as (select *, coalesce(sum(3 * length(n) + 51) over (partition by paper_id order by entry_id rows between unbounded preceding and 1 preceding), 0)::int o, count(*) over (partition by paper_id, lower(n), pub_year) k from b)
        select paper_id, bib_key, o + 4 start_pos, o + 4 + length(n) + 13 end_pos, 0 form from p where k = 1
        union all select paper_id, bib_key, (o + 21 + length(n))::int, (o + 38 + 2 * length(n))::int, 1 from p where k = 1
        union all select paper_id, bib_key, (o + 42 + 2 * length(n))::int, (o + 49 + 3 * length(n))::int, 2 from p where k = 1""",
    "plain_documents": r"""with b as (select paper_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) raw, row_number() over (partition by paper_id order by entry_id) i from bib_entries where trim(regexp_replace(raw, '\s+', ' ', 'g')) <> ''),
        g as (select paper_id, count(*)::int n, arg_max(raw, i) last_raw from b group by 1)
        select paper_id, 32 body_chars, n n_entries, array_to_string(list_transform(list_filter([1, 3, 4, 5, 2], lambda x: x <= n), lambda x: 'b' || x), ' ') ref_keys, last_raw from g""",
}
