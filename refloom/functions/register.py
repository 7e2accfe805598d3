"""Functions for SQL users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from refloom.functions.fuzzy import title_score


def register(spark: SparkSession) -> None:
    """Registers norm_doi, norm_arxiv, norm_title, title_hash as SQL functions and title_score as a pandas UDF."""
    for name, body in (
        ("norm_doi", r"nullif(regexp_replace(lower(trim(x)), r'^https?://(dx\.)?doi\.org/', ''), '')"),
        ("norm_arxiv", r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), r'^arxiv:\s*', ''), r'\s*\[[^\]]*\]\s*', ''), r'v[0-9]+$', '')), '')"),
        ("norm_title", r"trim(regexp_replace(regexp_replace(lower(coalesce(x, '')), r'[^a-z0-9\s]', ''), r'\s+', ' '))"),
        ("title_hash", "substr(sha2(norm_title(x), 256), 1, 16)"),
    ):
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {body}")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_score(x or "", y or "") for x, y in zip(a, b, strict=True)])

    spark.udf.register("title_score", score)
