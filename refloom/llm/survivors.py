"""Best representative of each group of duplicate records, chosen field by field.

Every record is unfolded into one row per field: a canonical value (null where the record has none
that can be used) and a rank (completeness, trust, recency). Equal values are combined first, map
side, keeping their best rank and the smallest record that holds them; a window then orders the
values of each group and field and keeps the first. Spark applies that limit before its shuffle as
well, so a group with very many records sends one row per task and field.

Defined cases
- null group key: the record belongs to no group and is left out. Group of one: kept only on request.
- field without a usable value in any record: holder 0, value null.
- equal ranks: the value whose smallest record id is lower wins. Repeated deliveries change nothing.
- an abstract under several ids of one title stays; under three titles it is a notice.
- provider that the trust table lacks: trusted least. Null retrieved_at: older than any time.
- empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEAST_TRUST = 1_000_000
#: A text that groups of this many different titles carry word for word is a notice, not an abstract; one work under several ids has one title.
NOTICE_TITLES = 3
#: Placeholders and wording of notices; fixed values.
PLACEHOLDERS = r"(?i)^(n/?a|null|none|nil|nan|tbd|tba|-+|\.+|unknown|undefined|forthcoming|pending|\[object object\]|(no )?abstract( is)?( not)?( available| provided)?\.?|not available\.?)$"
NOTICE_WORDS = r"(?i)(does not accept cookies|accept all cookies|restricted to subscribers|institutional account|supplied by a third party|indexed automatically|browser settings|enable javascript|version of record.*supplementary)"


@dataclass(frozen=True)
class Field:
    """``value``: canonical string or null; ``rank``: bigint, higher is more complete."""

    name: str
    value: Column
    rank: Column
    by_trust: bool = True
    by_time: bool = True


def with_clean_columns(df: DataFrame) -> DataFrame:
    """Adds ``_abstract``, ``_doi``, ``_date``: usable values in one notation, else null.

    Each step is its own projection, so that no expression is written out twice in generated code.
    """
    c, outer = F.col, r"^[\s\u00a0]+|[\s\u00a0]+$"
    bare = F.regexp_replace("abstract", r"</?[A-Za-z][^<>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    df = df.withColumn("_bare", F.trim(F.regexp_replace(bare, r"[\s\u00a0\u200b\u00ad]+", " ")))
    df = df.withColumn("_core", F.regexp_replace("_bare", r"(?i)^(abstract|summary)( ?[:.\u2014\u2013-] ?| )", ""))
    usable = (F.length("_core") > 0) & ~c("_bare").rlike(PLACEHOLDERS) & ~c("_core").rlike(PLACEHOLDERS) & ~c("_core").rlike(NOTICE_WORDS)
    df = df.withColumn("_abstract", F.when(usable, c("_core")))
    doi = F.regexp_replace(F.lower(F.regexp_replace("doi", outer, "")), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    df = df.withColumn("_d", F.regexp_replace(doi, r"[.,;]+$", ""))
    df = df.withColumn("_doi", F.when(c("_d").rlike(r"^10\.[0-9]{4,9}/[^\s]+$"), c("_d")))
    s = F.regexp_replace(F.regexp_replace("publication_date", outer, ""), "[/.]", "-")
    df = df.withColumn("_s", F.regexp_replace(s, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[T ].*$", "$1"))
    df = df.withColumn("_parts", F.split(F.when(c("_s").rlike(r"^[0-9]{4}(-[0-9]{1,2}){0,2}$"), c("_s")), "-"))
    df = df.withColumn("_full", F.concat_ws("-", c("_parts")[0], F.lpad(F.coalesce(F.get("_parts", F.lit(1)), F.lit("1")), 2, "0"), F.lpad(F.coalesce(F.get("_parts", F.lit(2)), F.lit("1")), 2, "0")))
    fine = c("_parts").isNotNull() & F.try_to_date("_full", "yyyy-MM-dd").isNotNull() & c("_parts")[0].try_cast("int").between(1, 2030)
    df = df.withColumn("_date", F.when(fine, F.substring("_full", F.lit(1), F.size("_parts") * 3 + 1)))
    return df.drop("_bare", "_core", "_d", "_s", "_parts", "_full")


def _filled(name: str) -> Column:
    c = F.trim(F.regexp_replace(name, r"[\s\u00a0]+", " "))
    return F.when((F.length(c) > 0) & ~c.rlike(PLACEHOLDERS), c)


def record_fields(all_fields: bool = True) -> list[Field]:
    """Fields of a table given :func:`with_clean_columns`; ``all_fields=False``: the four disputed ones."""
    c, zero = F.col, F.lit(0).cast("bigint")
    # a cut copy is a prefix of the whole one, so the longest is the most complete
    whole = F.length(F.regexp_replace("_abstract", r"\s*(\.\.\.|\u2026)$", "")).cast("bigint")
    out = [
        Field("abstract", c("_abstract"), whole, by_trust=False, by_time=False),
        Field("count", F.when(c("citation_count") >= 0, c("citation_count").cast("string")), zero, by_trust=False),
        Field("date", c("_date"), F.length("_date").cast("bigint")),
        Field("doi", c("_doi"), zero),
    ]
    if all_fields:
        out += [Field(n, _filled(n), zero) for n in ("title", "arxiv_id", "openreview_id", "pdf_path", "url")]
        out.append(Field("pub_year", F.when(c("pub_year").between(1, 2030), c("pub_year").cast("string")), zero))
        out.append(Field("authors", F.when(F.size("authors") > 0, F.array_join("authors", "; ")), F.coalesce(F.size("authors"), F.lit(0)).cast("bigint")))
    return out


def survivors(records: DataFrame, trust: DataFrame, fields: list[Field], group: str = "paper_id", rec: str = "rec_id") -> DataFrame:
    """(group, field, holder, value): the surviving value of each field that has one.

    ``trust`` (provider, trust_rank) is a table of sources, a few rows per source, and is joined
    after it has been reduced to one row per provider.
    """
    trust = trust.groupBy("provider").agg(F.min("trust_rank").alias("__trust"))
    t, none = F.coalesce(F.col("__trust"), F.lit(LEAST_TRUST)).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    long = records.filter(F.col(group).isNotNull()).join(trust, "provider", "left").select(
        group,
        F.col(rec).alias("_rec"),
        F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"<[^<>]*>|[^\p{L}\p{N}]+", "").alias("_title") if "title" in records.columns else F.lit("").alias("_title"),
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(f.name).alias("field"),
                        f.value.alias("value"),
                        F.struct(f.rank.alias("complete"), (-t if f.by_trust else F.lit(0).cast("bigint")).alias("trust"), (F.col("retrieved_at") if f.by_time else none).alias("at")).alias("rank"),
                    )
                    for f in fields
                )
            )
        ).alias("x"),
    )
    values = long.select(group, "_rec", "_title", "x.*").filter("value is not null").groupBy(group, "field", "value").agg(F.max("rank").alias("rank"), F.min("_rec").alias("holder"), F.min(F.nullif("_title", F.lit(""))).alias("title"))
    if any(f.name == "abstract" for f in fields):
        # Values are now distinct per group; a group without title counts as one title of its own.
        df = values.filter("field = 'abstract'").groupBy(F.xxhash64("value").alias("_h")).agg(F.count_distinct(F.coalesce("title", F.col(group).cast("string"))).alias("_titles")).filter(F.col("_titles") >= NOTICE_TITLES)
        values = values.join(df.select(F.lit("abstract").alias("field"), "_h"), (F.xxhash64(values["value"]) == F.col("_h")) & (values["field"] == "abstract"), "left_anti")
    w = W.partitionBy(group, "field").orderBy(F.col("rank.complete").desc_nulls_last(), F.col("rank.trust").desc(), F.col("rank.at").desc_nulls_last(), "holder", "value")
    return values.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(group, "field", "holder", "value")


def several(records: DataFrame, group: str = "paper_id") -> DataFrame:
    """Groups of two or more records with their number."""
    return records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")
