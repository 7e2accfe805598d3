"""Problem 9: a mixture of documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm.bpe import vocabulary
from refloom.llm.mixing import mixture, shares
from refloom.sources.tables import table


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the greatest mixture that meets all shares, with the number of their uses."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), vocabulary(spark))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the mixture reaches."""
    return shares(*mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), vocabulary(spark)))


def p9_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by a mixture of as many tokens as the documents have: scarce sources stay short of theirs."""
    return shares(*mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), vocabulary(spark), as_corpus=True))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_corpus_size": p9_corpus_size}
ORACLES: dict[str, str] = {}
