"""Linking the spellings of one person or group.

1. Tokens: all long tokens of all names are compared by MinHash banding over padded 3-grams. Band
   size follows from the collision curve 1-(1-s^r)^b: with rows r fixed, the number of bands is the
   least that reaches the wanted recall at the similarity that one slip leaves in a token of eight
   letters. Slips that leave less meet on the tokens with letters left out, so every pair that may be
   accepted shares a bucket. Pairs in one bucket are verified by edit distance; each token then joins
   the most frequent centre it is near to (stars of tokens; a token with satellites keeps them).
2. Family token: the token of a name whose star stands beside the fewest other tokens. Given names
   and words like consortium stand beside many.
3. Names: the distinct readings (family, given name, initials) are banded by MinHash over the padded
   3-grams of family and given name. A reading without a given name has one band, its family with the
   initial, in which it meets all others that may carry that initial; a family name alone meets its
   family. Pairs are verified by the Monge-Elkan similarity of their tokens, given names, initials
   and nicknames permitting.
4. Stars: readings are ranked, fuller and more frequent ones first. In rounds, every reading that is
   linked to no open reading of higher rank becomes a centre, and those linked to it are closed; this
   ends with the centres that going through all readings in order of rank would choose. Every other
   reading joins the centre it is most like, then the more frequent one.

Defined cases
- null and empty names, et al.: no spelling of anyone. One spelling: no pair.
- family name alone: joins the most frequent centre of its family.
- an initial that fits several centres joins the most frequent one.
- repeated rows only raise a spelling's frequency; empty tables give an empty result.
- a name that a third of all rows bear is one reading; buckets of very many readings are salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from refloom.llm.names import KNOWN_GIVEN, NICKNAMES, TWO_SLIPS, edit, monge_elkan, near, near_given, read_name, trigrams
from refloom.plans.lineage import cut
from refloom.plans.skew import HOT_ROWS, lookup_join, salted_join

ROWS = 3
RECALL = 0.99
#: 3-gram similarity of two tokens of eight letters that a swap of neighbours sets apart.
LEAST_SIMILARITY = 0.42
SAME = 0.88
#: From this many letters on, two slips leave so much in common that the bands alone find them.
BANDS_SUFFICE = 24


def bands(recall: float = RECALL, s: float = LEAST_SIMILARITY, r: int = ROWS) -> int:
    """Least number of bands with collision probability ``recall`` at similarity ``s``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - s**r))


def shortened(token: str) -> set[str]:
    """The token with up to as many letters left out as it may have slips: an edit or swap takes one from each side."""
    out = {token}
    if len(token) >= BANDS_SUFFICE:
        return out
    for _ in range(2 if len(token) >= TWO_SLIPS else 1):
        out |= {d[:i] + d[i + 1 :] for d in out for i in range(len(d))}
    return out


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, c, *r) for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := read_name(n))]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "n", "tokens", "initials", "short", "grp"])


class MinHash:
    """Band keys of a set of padded 3-grams."""

    def __init__(self) -> None:
        n = bands() * ROWS
        self.a = np.array([xxhash.xxh64_intdigest(f"a{k}") | 1 for k in range(n)], dtype=np.uint64)[:, None]
        self.b = np.array([xxhash.xxh64_intdigest(f"b{k}") for k in range(n)], dtype=np.uint64)[:, None]
        self.mix = np.array([[xxhash.xxh64_intdigest(f"m{k}{i}") | 1 for i in range(ROWS)] for k in range(bands())], dtype=np.uint64)

    def keys(self, text: str) -> list[int]:
        grams = np.array([xxhash.xxh64_intdigest(g) for g in trigrams(text)], dtype=np.uint64)[None, :]
        mins = (self.a * grams + self.b).min(axis=1).reshape(-1, ROWS)  # modulo 2^64
        mixed = (mins ^ (mins >> np.uint64(29))) * self.mix
        return (mixed.sum(axis=1, dtype=np.uint64) + self.mix[:, 0]).view(np.int64).tolist()


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) -> (token, n, key): bands, and the token with letters left out."""
    hashes = MinHash()
    for batch in batches:
        rows = []
        for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(t, n, k) for k in hashes.keys(t)]
            rows += [(t, n, xxhash.xxh64_intdigest("d" + d) - (1 << 63)) for d in shortened(t)]
        yield _table(rows, (pa.string(), pa.int64(), pa.int64()), ("token", "n", "key"))


def _view_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(view) -> (view, key): bands of family and given name."""
    hashes = MinHash()
    for batch in batches:
        rows = [(v, k) for v in batch.column(0).to_pylist() for k in hashes.keys(v.replace("\x1f", " "))]
        yield _table(rows, (pa.string(), pa.int64()), ("view", "key"))


def _table(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out over as many tasks as the session has shuffle partitions, few as they may be: what follows is dear."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def token_stars(tokens: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(token, n, beside) -> (token, star): the centre among its near tokens, or the token itself."""
    weights = tokens.select("token", "beside")
    keyed = cut(_dealt(tokens.select("token", "n"), "token").mapInArrow(_band_keys, "token string, n bigint, key bigint"))
    a = keyed.select("key", F.col("token").alias("a"), F.col("n").alias("na"))
    b = keyed.select("key", F.col("token").alias("b"), F.col("n").alias("nb"))
    # From the rarer to the more frequent token of a bucket; equal frequency: to the smaller one.
    may = 2 * tokens.count() > hot_rows  # a token has a key twice at most
    pairs = salted_join(a, b, "key", hot_rows, hot_sides=(may, may)).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))).select("a", "b", "nb")
    # A slip is two edits at most where swaps count as two; two slips are four.
    pairs = pairs.filter(F.levenshtein("a", "b", 4) >= 0).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(p, q, n, edit(p, q, 1) <= 1) for p, q, n, i, j in zip(*(x.column(c).to_pylist() for c in range(5)), strict=True) if near(p, q) or near_given(p, q, i, j)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "nb", "close"])

    pairs = pairs.join(weights.select(F.col("token").alias("a"), F.col("beside").alias("ia")), "a").join(weights.select(F.col("token").alias("b"), F.col("beside").alias("ib")), "b")
    linked = pairs.select("a", "b", "nb", "ia", "ib").mapInArrow(verify, "a string, b string, nb bigint, close boolean")
    return _stars(tokens, linked)


def _stars(tokens: DataFrame, linked: DataFrame) -> DataFrame:
    """(token), (a, b, nb, close) -> (token, star).

    A token hangs on its most frequent near token that is near no more frequent one itself, else on its
    most frequent near token. A token that others hang on keeps them: it lets go of its own link if that
    is of two slips (two names that are alike), and takes them along if it is of one. What is two slips
    from its centre and one from a token that let go joins the latter.
    """
    linked = cut(linked)
    hanging = linked.select(F.col("a").alias("b"), F.lit(0).alias("top")).distinct()
    ranked = linked.join(hanging, "b", "left").select("a", "b", "close", F.struct(F.coalesce("top", F.lit(1)), "nb", "b").alias("rank"))
    best = cut(ranked.groupBy("a").agg(F.max_by(F.struct("b", "close"), "rank").alias("up")).select("a", "up.b", "up.close"))
    held = cut(best.filter("not close").join(best.select(F.col("b").alias("a")), "a", "left_semi").select("a"))
    nearer = linked.filter("close").join(held.withColumnRenamed("a", "b"), "b", "left_semi").groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("nearer"))
    star = F.when(F.col("close"), F.col("b")).otherwise(F.coalesce("nearer", "b")).alias("star")
    up = cut(best.join(held, "a", "left_anti").join(nearer, "a", "left").select("a", star))
    while True:  # each round halves the way to the centre
        step = up.select(F.col("a").alias("star"), F.col("star").alias("next"))
        longer = cut(up.join(step, "star", "left").select("a", F.coalesce("next", "star").alias("star"), F.col("next").isNotNull().alias("moved")))
        up = longer.select("a", "star")
        if longer.filter("moved").isEmpty():
            break
    return tokens.select("token").join(up.withColumnRenamed("a", "token"), "token", "left").select("token", F.coalesce("star", "token").alias("star"))


def _formal(token: str) -> list[str]:
    return NICKNAMES.get(token, token).split()


def _tokens(r: tuple) -> list[str]:
    _, family, given, initials, short, group = r
    return [family, *([given] if given else []), *([short] if short else []), *(initials if not given and not short else initials[:0]), *([group] if group else [])]


def _fits(r: tuple, c: tuple) -> bool:
    """May reading ``r`` be the one of centre ``c``?"""
    _, _, given, initials, short, group = r
    _, _, cgiven, cinitials, cshort, cgroup = c
    if bool(group) != bool(cgroup) or (group and group != cgroup and not {group, cgroup} <= {"group", "working group"}):
        return False
    if group:
        return monge_elkan(_tokens(r), _tokens(c)) >= SAME
    if given and cgiven:
        same = given == cgiven or set(_formal(given)) & set(_formal(cgiven)) or (min(len(given), len(cgiven)) > 3 and not {given, cgiven} & NICKNAMES.keys() and edit(given, cgiven, 1) <= 1)
        if not same or (initials and cinitials and initials[0] != cinitials[0]):
            return False
    elif given or cgiven:
        full, head = (given, short or "".join(initials[:1])) if given else (cgiven, short or "".join(initials[:1]))
        if given:
            head = cshort or "".join(cinitials[:1])
        if head and not any(f.startswith(head) for f in {full, *_formal(full)}):
            return False
        bare, cbare = (initials, cinitials[1:] if not cshort else cinitials) if given else (initials[1:] if not short else initials, cinitials)
        if bare and cbare and bare[0] != cbare[0]:
            return False
    else:
        if short and cshort and not (short.startswith(cshort) or cshort.startswith(short)):
            return False
        mine, theirs = ([short[0]] if short else []) + list(initials), ([cshort[0]] if cshort else []) + list(cinitials)
        if any(x != y for x, y in zip(mine, theirs, strict=False)):
            return False
    return monge_elkan(_tokens(r), _tokens(c)) >= SAME


def _likeness(r: tuple, c: tuple) -> tuple:
    """How well a reading suits a centre it fits: middle initials that agree, then similarity."""
    _, _, given, initials, short, _ = r
    _, _, cgiven, cinitials, _, _ = c
    middle = initials if given or short else initials[1:]
    return (bool(middle and cinitials and middle[0] == cinitials[0]), round(monge_elkan(_tokens(r), _tokens(c)), 6))


_KEY = ("family", "given", "initials", "short", "grp")


def _views(r: DataFrame) -> DataFrame:
    """Readings with ``kind`` and ``view``: the strings under which they may meet, and ``asks`` where they look for others."""
    nick = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() for x in (k, v)])
    given = F.when(F.col("given") != "", F.col("given"))
    formal = F.when(given.isNotNull(), F.split(F.coalesce(nick[given], given), " "))
    first = lambda w: F.substring(w, 1, 1)
    heads = F.array_union(F.coalesce(F.transform(formal, first), F.array()), F.array_compact(F.array(first(given), F.when(given.isNull(), F.coalesce(first(F.nullif("short", F.lit(""))), F.get("initials", F.lit(0)))))))
    group, alone = F.col("grp") != "", F.size(heads) == 0
    pair = lambda x: F.concat(F.col("family"), F.lit("\x1f"), x)
    item = lambda kind, view, asks: F.struct(F.lit(kind).alias("kind"), view.alias("view"), asks.alias("asks"))
    full = F.transform(F.when(group, F.array(F.lit("@"))).otherwise(F.coalesce(F.array_union(formal, F.array(given)), F.array())), lambda g: item("full", pair(g), F.lit(True)))
    head = F.transform(F.when(group, F.array()).otherwise(heads), lambda h: item("head", pair(h), given.isNull()))
    family = F.when(group, F.array()).otherwise(F.array(item("family", F.col("family"), alone)))
    return r.withColumn("_v", F.explode(F.concat(full, head, family))).select(*r.columns, "_v.kind", "_v.view", "_v.asks")


def candidates(readings: DataFrame, hot_rows: int = HOT_ROWS, n_readings: int = 1 << 62) -> DataFrame:
    """(late, early): pairs of readings of one family that may be one person; ``early`` ranks higher.

    ``n_readings``: how many there are at most; so many rows, thrice for formal names, can a key have.
    """
    may = (3 * n_readings > hot_rows,) * 2
    rows = cut(_views(readings).select("reading", "rank", "kind", "view", "asks"))
    strings = rows.filter("kind = 'full'").select("view").distinct()
    keyed = cut(_dealt(strings, "view").mapInArrow(_view_keys, "view string, key bigint"))
    near = salted_join(keyed, keyed.withColumnRenamed("view", "other"), "key", hot_rows, hot_sides=may)
    same_family = F.substring_index("view", "\x1f", 1) == F.substring_index("other", "\x1f", 1)
    near = cut(near.filter(same_family).select("view", "other").distinct())
    full = rows.filter("kind = 'full'").select("reading", "rank", "view")
    there = lambda df: df.select(F.col("reading").alias("o_reading"), F.col("rank").alias("o_rank"), "view")
    by_band = salted_join(salted_join(full, near, "view", hot_rows, hot_sides=may).select("reading", "rank", F.col("other").alias("view")), there(full), "view", hot_rows, hot_sides=may)
    rest = rows.filter("kind <> 'full'")
    by_head = salted_join(rest.filter("asks").select("reading", "rank", F.concat("kind", "view").alias("view")), there(rest.withColumn("view", F.concat("kind", "view"))), "view", hot_rows, hot_sides=may)
    pairs = by_band.unionByName(by_head).filter("rank <> o_rank")
    later = F.col("rank") > F.col("o_rank")
    return pairs.select(F.when(later, F.col("reading")).otherwise(F.col("o_reading")).alias("late"), F.when(later, F.col("o_reading")).otherwise(F.col("reading")).alias("early")).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for late, early, r, c in zip(*(b.column(x).to_pylist() for x in ("late", "early", "r", "c")), strict=True):
            r, c = ((x["n"], x["family"], x["given"] or "", tuple(x["initials"] or ()), x["short"] or "", x["grp"] or "") for x in (r, c))
            if _fits(r, c):
                middle, likeness = _likeness(r, c)
                rows.append((late, early, middle + likeness))
        yield _table(rows, (pa.int64(), pa.int64(), pa.float64()), ("late", "early", "likeness"))


def star_centres(edges: DataFrame) -> DataFrame:
    """(centre) among the ends of ``edges`` (late, early): in order of rank, all that are not linked to a centre before them."""
    e = cut(edges.select("late", "early"))
    open_ = cut(e.select(F.col("late").alias("id")).union(e.select("early")).distinct())
    centres = open_.limit(0)
    while not open_.isEmpty():
        new = cut(open_.join(e.select(F.col("late").alias("id")), "id", "left_anti"))
        closed = e.join(new.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id"))
        centres = centres.unionByName(new)
        open_ = cut(open_.join(new, "id", "left_anti").join(closed, "id", "left_anti"))
        e = cut(e.join(open_.withColumnRenamed("id", "late"), "late", "left_semi").join(open_.withColumnRenamed("id", "early"), "early", "left_semi"))
    return centres.withColumnRenamed("id", "centre")


def stars(readings: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(reading, centre) of distinct readings (reading, n, family, given, initials, short, grp)."""
    ranked = readings.withColumn("rank", F.struct((F.col("grp") == "").cast("int").alias("a"), (F.col("given") == "").cast("int").alias("b"), (-F.size("initials")).alias("c"), (-F.col("n")).alias("d"), F.col("reading").alias("e")))
    ranked = cut(ranked)
    side = ranked.select("reading", F.struct("n", *_KEY).alias("x"))
    n = ranked.count()
    pairs = cut(candidates(ranked, hot_rows, n))
    hot = None if n > hot_rows else []  # no reading has more pairs than there are readings
    both = lookup_join(pairs, side.withColumnsRenamed({"reading": "late", "x": "r"}), "late", "inner", hot_rows, hot)
    both = lookup_join(both, side.withColumnsRenamed({"reading": "early", "x": "c"}), "early", "inner", hot_rows, hot)
    edges = cut(_dealt(both).mapInArrow(_verify, "late bigint, early bigint, likeness double"))
    centres = cut(star_centres(edges))
    hang = edges.join(centres.withColumnRenamed("centre", "early"), "early", "left_semi").join(centres.withColumnRenamed("centre", "late"), "late", "left_anti")
    facts = ranked.select("reading", "n", ((F.col("grp") == "") & (F.col("given") == "")).alias("bare"))
    hang = cut(hang.join(facts.withColumnRenamed("reading", "late"), "late").join(facts.select(F.col("reading").alias("early"), F.col("n").alias("weight")), "early"))
    best = lambda df: df.groupBy("late").agg(F.max_by("early", F.struct("likeness", "weight", "early")).alias("centre"), F.first("n").alias("n"))
    # Readings without a given name join last, when it is known how often each centre occurs.
    full = cut(best(hang.filter("not bare")))
    more = full.groupBy(F.col("centre").alias("early")).agg(F.sum("n").alias("more"))
    bare = best(hang.filter("bare").join(more, "early", "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0))))
    joined = full.unionByName(bare).select(F.col("late").alias("reading"), "centre")
    return ranked.select("reading").join(joined, "reading", "left").select("reading", F.coalesce("centre", "reading").alias("centre"))


def name_classes(names: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(name) with repeats -> (name, n, class): one row per spelling; ``class`` is a hash of its centre."""
    counted = names.filter("name is not null and name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    read = cut(counted.mapInArrow(_readings, "name string, n bigint, tokens array<string>, initials array<string>, short array<string>, grp string"))
    tokens = read.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    each = read.select("name", F.explode(F.array_distinct("tokens")).alias("token"))
    raw = each.join(each.select("name", F.col("token").alias("other")), "name").filter("token <> other").select("token", "other").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("beside"))
    tokens = cut(tokens.join(raw, "token", "left").select("token", "n", F.coalesce("beside", F.lit(0)).alias("beside")))
    star_of = cut(token_stars(tokens, hot_rows))
    # Tokens of a name by star, with the number of other stars each stands beside.
    placed = read.select("name", F.posexplode("tokens").alias("pos", "token")).join(star_of, "token")
    beside = placed.select("name", "star").join(placed.select("name", F.col("star").alias("other")), "name").filter("star <> other")
    beside = beside.select("star", "other").distinct().groupBy("star").agg(F.count(F.lit(1)).alias("beside"))
    # A rare nickname stands beside few names, and is no family name for that.
    known = F.when(F.col("star").isin(sorted(KNOWN_GIVEN)), F.lit(1 << 40)).otherwise(0)
    placed = cut(placed.join(beside, "star", "left").select("name", "pos", "token", "star", (F.coalesce("beside", F.lit(0)) + known).alias("beside")))
    w = W.partitionBy("name").orderBy("beside", F.length("star").desc(), "pos")
    family = placed.withColumn("_k", F.row_number().over(w))
    parts = family.groupBy("name").agg(F.max(F.when(F.col("_k") == 1, F.col("star"))).alias("family"), F.max(F.when(F.col("_k") == 2, F.col("star"))).alias("given"))
    short = F.when(F.col("given").isNull() & (F.size("short") > 0), F.col("short")[0])
    forms = read.join(parts, "name", "left").select(
        "name", "n", F.coalesce("family", F.col("short")[0]).alias("family"), F.when(F.col("family").isNotNull(), F.coalesce("given", F.lit(""))).otherwise("").alias("given"), "initials", F.coalesce(short, F.lit("")).alias("short"), "grp"
    )
    forms = cut(forms.withColumn("reading", F.xxhash64(*_KEY)))
    distinct = forms.groupBy("reading", *_KEY).agg(F.sum("n").alias("n"))
    centre = cut(stars(distinct, hot_rows))
    return forms.join(centre, "reading").select("name", "n", F.col("centre").alias("class"))


def name_pairs(classes: DataFrame) -> DataFrame:
    """(name_a, name_b) of each two spellings of a class, in code-point order."""
    a, b = classes.select("class", F.col("name").alias("name_a")), classes.select("class", F.col("name").alias("name_b"))
    return a.join(b, "class").filter("name_a < name_b").select("name_a", "name_b")
