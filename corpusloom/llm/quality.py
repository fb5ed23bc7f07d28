"""Quality rules: repetition and symbol signals, then a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CHARS, let, offer, store, words
from corpusloom.operators.metrics import exact_quantiles

WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def repeated_words(w: Column) -> Column:
    """Words that stand in a five-word window found twice or more in the array ``w``, first finds included.

    Window hashes are packed with their positions and sorted, so equal windows become neighbours; neighbours are
    compared word by word. n log n in the text, without a shuffle.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(p: Column, bits: Column, mask: Column) -> Column:
        at = lambda i: (F.get(p, i)).bitwiseAND(mask)
        window = lambda i: F.slice(w, at(i).cast("int") + 1, WINDOW)
        same = lambda i, j: F.coalesce((_shift(F.get(p, i), bits) == _shift(F.get(p, j), bits)) & (window(i) == window(j)), F.lit(False))
        last = F.size(p) - 1
        hits = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        return let(F.sort_array(F.transform(hits, at)), covered)

    def pack(bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(keys), lambda p: found(p, bits, mask))

    bits = F.when(F.size(w) < 1 << 25, 25).otherwise(31)
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(pack(bits))


def signals(text: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(w),
    }


def buckets_of(w: Column, buckets: int) -> Column:
    """Hash buckets of the words and the pairs of neighbouring words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(buckets)).cast("int"))
    return F.when(F.size(w) > 1, F.concat(one, pairs)).otherwise(one)


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratio a bucket of hashed n-grams, and the threshold of the length-normalised sum."""

    weights: tuple[float, ...]
    threshold: float
    shrink: float

    def score(self, w: Column) -> Column:
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x)) / (F.size(g) + self.shrink)
        return F.round(let(let(w, lambda x: buckets_of(x, len(self.weights))), total), 9)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 13, prior: float = 20_000.0, shrink: float = 50.0, keep: float = 0.999, slack: float = 0.05) -> Ratio:
    """Fit the ratio between the trusted target and the raw corpus.

    Raw counts cover every row of ``docs``; the target is all documents that ``labels`` calls good. Their ids are
    broadcast while they are few, else the texts meet them by a shuffled join. Both counts come from one pass that
    counts before the shuffle; what reaches the driver is one row a bucket. The target is smoothed by ``prior`` n-grams
    of the raw corpus. The threshold lies ``slack`` under the score that the share ``keep`` of all trusted documents
    reaches, an exact quantile of their stored scores. Without trusted documents all weights and the threshold are 0.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = offer(good.select("doc_id", F.lit(1).alias("trusted")), 500_000)
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("trusted", words(F.col("text")).alias("w"))
    grams = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(let(F.col("w"), lambda w: buckets_of(w, buckets))).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r.b], target[r.b] = r.raw, r.target
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return Ratio((0.0,) * buckets, 0.0, shrink)
    q = [(x + 0.5) / (n_raw + 0.5 * buckets) for x in raw]
    weights = tuple(round(math.log((t + prior * p) / (n_target + prior)) - math.log(p), 9) for t, p in zip(target, q, strict=True))
    ratio = Ratio(weights, 0.0, shrink)
    scores = store(docs.join(good, "doc_id", "left_semi").select(ratio.score(words(F.col("text"))).alias("score")), "trusted_scores")
    low = exact_quantiles(scores, "score", [1 - keep])[0]
    return Ratio(weights, round(low - slack, 6), shrink)


def keep(docs: DataFrame, ratio: Ratio, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns stay as they are. One narrow pass."""
    fine = lambda w: (F.size(w) >= min_words) & (100 * repeated_words(w) <= repeat_percent * F.size(w)) & (ratio.score(w) >= ratio.threshold)
    return docs.where(let(words(docs["text"]), fine))


def judge(docs: DataFrame, ratio: Ratio, min_words: int = 10, repeat_percent: int = 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the signals, base_failed, score and kept for every document, from one pass without a shuffle.

    A document fails the base rules with under ``min_words`` words or more than ``repeat_percent`` % repeated words;
    otherwise it is kept if its score reaches the threshold. Null and empty texts have no words and fail. Repeated
    rows are judged alike, each on its own. ``extra`` names columns of ``docs`` to carry.
    """
    w = F.col("__w")
    rows = docs.select("doc_id", *extra, F.col("text").alias("__text"), words(F.col("text")).alias("__w"))
    s = signals(F.col("__text"), w)
    rows = rows.select("doc_id", *extra, *[c.alias(n) for n, c in s.items()], ratio.score(w).alias("llr"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= ratio.threshold))
