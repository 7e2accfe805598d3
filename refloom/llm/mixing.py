"""Mixing sources to target shares of the total size in tokens.

Equal texts count as one document that belongs to every source it came from. Documents are summed up
by membership pattern (which sources hold them); a min-cost flow on the patterns, of which there are
at most 2^sources, routes their tokens to the sources' quotas, repetition costing more with every
use. Then documents are selected: those of a pattern lie side by side on a ring as long as their
tokens, in seeded order, and the sources take consecutive arcs of the ring, so that uses of two
documents of a pattern differ by at most one.

Defined cases
- null and empty texts have no tokens and are not used. Null source, source without target: not used.
- repeated deliveries within a source: one document, the one with the smallest id stands for it.
- target share null or not above 0, max_repeats null or below 1: the source is not used.
- a target source without documents: no total can give it its share, the mixture is empty unless
  ``total_tokens`` is given; then the other sources fill their quotas.
- documents are not cut: an arc ends at the document whose middle it passes.
- any number of sources; without target sources, or for empty tables, the mixture is empty.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from refloom.llm.bpe import encoded
from refloom.llm.flow import greatest_total, route
from refloom.plans.lineage import cut

#: Documents of a pattern are put in order within ranges of their hash: so many, or more for so many documents each.
RANGES, RANGE_ROWS = 4096, 100_000
SEPARATOR = "\x1f"


def mixture(docs: DataFrame, targets: DataFrame, vocab: Broadcast, total_tokens: int | None = None, seed: int = 1, as_corpus: bool = False) -> tuple[DataFrame, DataFrame]:
    """Uses (doc_id, source, n_tokens, n_uses) and plan (source, target_share, max_repeats, quota).

    ``total_tokens`` sets the size of the mixture, ``as_corpus`` makes it as large as the documents it is
    drawn from; without either it is the greatest that meets all shares.
    """
    spark = docs.sparkSession
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").collect()}  # a row per source
    names = sorted(goal)
    rows = docs.filter(F.col("source").isin(names) & F.col("text").isNotNull() & (F.col("text") != ""))
    tokens = encoded(rows.select(F.col("doc_id").alias("id"), "text"), vocab, counts_only=True)
    keyed = rows.select(F.col("doc_id").alias("id"), "source", F.md5(F.col("text").cast("binary")).alias("h"))
    keyed = cut(keyed.join(tokens, "id").filter("n_tokens > 0"))
    pattern = F.array_join(F.sort_array(F.collect_set("source")), SEPARATOR)  # at most all sources
    texts = cut(keyed.groupBy("h").agg(pattern.alias("pattern"), F.max("n_tokens").alias("n_tokens")))
    ranges = max(RANGES, texts.count() // RANGE_ROWS)
    order = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 40))
    texts = texts.withColumn("order", order).withColumn("range", F.floor(F.col("order") / ((1 << 40) // ranges + 1)).cast("int"))
    sums = cut(texts.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("tokens")))
    per = sums.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()  # at most 2^sources rows
    sets = {r["pattern"]: frozenset(r["pattern"].split(SEPARATOR)) for r in per}
    capacity = {sets[r["pattern"]]: r["tokens"] for r in per}
    share, repeats = {s: v[0] for s, v in goal.items()}, {s: v[1] for s, v in goal.items()}
    if as_corpus:
        total_tokens = sum(capacity.values())
    total = total_tokens if total_tokens is not None else greatest_total(capacity, share, repeats)
    quota = {s: int(share[s] * total) for s in names}
    flows, _ = route(capacity, quota, repeats) if capacity else ({}, 0)
    arcs = []
    for p, members in sets.items():
        at = 0
        for s in sorted(members):
            if f := flows.get((members, s), 0):
                arcs.append((p, s, at, at + f, capacity[members]))
                at += f
    arcs_df = spark.createDataFrame(arcs, "pattern string, source string, a bigint, z bigint, ring bigint")
    w = W.partitionBy("pattern").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = sums.select("pattern", "range", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("offset"))
    inner = W.partitionBy("pattern", "range").orderBy("order", "h").rowsBetween(W.unboundedPreceding, -1)
    placed = texts.join(offsets, ["pattern", "range"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    middle = F.col("at") + F.floor(F.col("n_tokens") / 2)
    # middle + k * ring within [a, z)
    uses = F.floor((F.col("z") - middle + F.col("ring") - 1) / F.col("ring")) - F.floor((F.col("a") - middle + F.col("ring") - 1) / F.col("ring"))
    chosen = placed.join(F.broadcast(arcs_df), "pattern").select("h", "source", uses.cast("bigint").alias("n_uses")).filter("n_uses > 0")
    first = keyed.groupBy("h", "source").agg(F.min("id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    out = chosen.join(first, ["h", "source"]).select("doc_id", "source", "n_tokens", "n_uses")
    plan = spark.createDataFrame([(s, share[s], repeats[s], quota[s]) for s in names], "source string, target_share double, max_repeats int, quota bigint")
    return out, plan


def shares(uses: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached share of the tokens used, documents, uses."""
    per = uses.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("most_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))  # one row
    z = lambda c: F.coalesce(c, F.lit(0))
    j = plan.join(per, "source", "left").join(F.broadcast(total))
    return j.select("source", "target_share", "max_repeats", "quota", z("n_docs").alias("n_docs"), z("n_uses").alias("n_uses"), z("most_uses").alias("most_uses"), z("tokens").alias("tokens"), F.round(F.try_divide(z("tokens"), "total"), 6).alias("share"))
