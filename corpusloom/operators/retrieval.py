"""Set similarity: nearest cached plan, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.shared import held, offer, settle, store


#: What a product of rates may be off by.
_OFF = 1e-9


def _known(sets: DataFrame, frequency: DataFrame) -> DataFrame:
    """sets (id, tokens), frequency (t, f) -> (id, n, known): the number of a set's tokens, and those that the index knows,
    rarest first; sets without one are left out. Tokens are made once and only known ones are moved."""
    numbered = F.transform(F.array("tokens"), lambda ts: F.transform(ts, lambda t: F.struct(F.size(ts).alias("n"), t.alias("t"))))[0]
    each = sets.select("id", F.explode(numbered).alias("x")).select("id", "x.n", "x.t").join(frequency, "t")
    return each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("known"))


def _prefixes(known: DataFrame, least: float) -> DataFrame:
    """(id, n, t, at): the known tokens of the prefixes of ``_known`` sets, with their place from 0.

    Tokens that the index lacks are the rarest of all: they take places in the prefix and can meet nothing. A set of n
    tokens shares one of its first ``n - ceil(least * n) + 1`` with every set that is so like it.
    """
    lacking = F.col("n") - F.size("known")
    kept = F.greatest(F.col("n") - F.ceil(F.col("n") * least - _OFF).cast("int") + 1 - lacking, F.lit(0))
    return known.select("id", "n", lacking.alias("lacking"), F.posexplode(F.slice("known", F.lit(1), kept)).alias("k", "x")).select("id", "n", F.col("x.t").alias("t"), (F.col("k") + F.col("lacking")).alias("at"))


def overlaps(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, jaccard) of the pairs with a likeness of at least ``least``, which is over 0; sides are
    (id, tokens), tokens distinct, ids distinct and not null. Sets without tokens are like nothing.

    ``right`` is indexed: tokens are ordered by how many of its sets hold them, so a token that all hold comes last and
    lies in the prefix of small sets only. Prefixes meet by token; pairs whose sizes, or whose places of the shared
    token, rule the likeness out go before they are counted once and verified on all tokens that both can share. No pair
    is lost.
    """
    if not 0 < least <= 1:
        raise ValueError("a likeness of 0 pairs all with all")
    since = held()
    frequency = offer(store(right.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f")), "token_frequency"))
    left, right = (store(_known(x, frequency), "known_tokens") for x in (left, right))
    side = lambda df, x: _prefixes(df, least).select(F.col("id").alias(f"{x}_id"), F.col("n").alias(f"n_{x}"), "t", F.col("at").alias(f"at_{x}"))
    met = side(left, "left").join(side(right, "right"), "t")
    shared = F.ceil((F.col("n_left") + F.col("n_right")) * (least / (1 + least)) - _OFF)
    sizes = (F.col("n_left") * least <= F.col("n_right") + _OFF) & (F.col("n_right") * least <= F.col("n_left") + _OFF)
    places = F.least(F.col("n_left") - F.col("at_left"), F.col("n_right") - F.col("at_right")) >= shared
    pairs = met.where(sizes & places).select("left_id", "right_id").distinct()
    whole = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), F.col("n").alias(f"n_{x}"), F.col("known.t").alias(f"t_{x}"))
    both = pairs.join(whole(right, "right"), "right_id").join(whole(left, "left"), "left_id").select("left_id", "right_id", F.size(F.array_intersect("t_left", "t_right")).alias("s"), (F.col("n_left") + F.col("n_right")).alias("n"))
    out = both.select("left_id", "right_id", (F.col("s") / (F.col("n") - F.col("s"))).alias("jaccard")).where(F.col("jaccard") >= least - _OFF)
    return settle(out, "overlaps", since)


def nearest(queries: DataFrame, cache: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, entry_id, score): the entry with the greatest Jaccard likeness, ties to the earliest, inclusive."""
    best = overlaps(queries, cache, threshold).groupBy(F.col("left_id").alias("query_id")).agg(F.max(F.struct("jaccard", (-F.col("right_id")).alias("r"))).alias("m"))
    return best.select("query_id", (-F.col("m.r")).alias("entry_id"), F.col("m.jaccard").alias("score")).where(F.col("score") >= threshold)


def recommend(problems: DataFrame, entries: DataFrame, most: int = 5, above: float = 0.1) -> DataFrame:
    """problems (id, tokens) x entries (id, tokens, kind, weight) -> the ``most`` best by likeness times weight.

    Likeness must exceed ``above``. The weight of a pattern is min(1, 0.2 * frequency), of a convention its confidence.
    """
    scored = overlaps(problems, entries, above).where(F.col("jaccard") > above).join(entries.select(F.col("id").alias("right_id"), "kind", "weight"), "right_id")
    scored = scored.select(F.col("left_id").alias("problem_id"), F.col("right_id").alias("entry_id"), "kind", F.round(F.col("jaccard") * F.col("weight"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.col("score").desc(), "entry_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def pattern_weight(frequency: Column) -> Column:
    return F.least(F.lit(1.0), frequency * 0.2)
