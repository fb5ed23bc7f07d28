"""How filters interact: counts of every filter order, from mask cells, by adjacent transpositions; Shapley on the way."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import let, words

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Orders grow with the factorial of the filters.
MOST_FILTERS = 7


def text_mask(text: Column) -> Column:
    """Which filters a text alone fails, as bits: A (1) under 100 words, B (2) under 80 distinct words in 100, C (4) over 10
    capitals A-Z in 100 code points, D (8) any of #$%&*|. Null counts as empty; the words of a text are made once."""
    t = F.coalesce(text, F.lit(""))
    counts = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))

    def bits(c: Column) -> Column:
        capitals = 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 10 * F.length(t)
        fails = (c["n"] < 100, 100 * c["d"] < 80 * c["n"], capitals, t.rlike("[#$%&*|]"))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return let(counts, bits).cast("int")


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail exactly the filters of a mask; bits 0 to 3 are
    those of ``text_mask``, bit 4 (E) is a text that a row with a smaller doc_id has, in any part.

    A null part and a null text are the empty string. A row with a null doc_id has no smaller one and is smaller than
    none, so it passes E, and it has no label; rows that repeat a doc_id and its text pass or fail E alike. A doc_id with
    several labels is good or toxic if one of them says so.

    Texts meet by their SHA-256, so only digests are moved. Rows are counted by (digest, part, doc_id) first: copies of
    one text lie in as many groups as they have ids, and each later step is a sum that combines before the shuffle.
    """
    row = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("h"), text_mask(F.col("text")).alias("mask"))
    each = row.groupBy("h", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    # null ids meet no label, and lie apart
    each = each.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.hex("h"))).join(says, "id", "left")
    each = each.select("h", "part", "mask", "doc_id", "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")])
    # the rows of the smallest doc_id of a text pass E; the first of a part is kept whole, as others may lie in other parts
    count = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0)).alias(c)
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    parts = each.groupBy("h", "part", "mask").agg(first, F.struct(*[count(c, known) for c in ("n", "good", "toxic")]).alias("some"), F.struct(*[count(c, ~known) for c in ("n", "good", "toxic")]).alias("none"))
    leads = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("h"))
    parts = parts.select("part", "mask", "first", "some", "none", F.coalesce(leads, F.lit(False)).alias("leads"))
    led = lambda c: F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)
    of = lambda c, passes: F.col(f"none.{c}") + led(c) if passes else F.col(f"some.{c}") - led(c)
    two = F.array(*[F.struct((F.col("mask") + (0 if passes else 16)).alias("mask"), of("n", passes).alias("docs"), of("good", passes).alias("good"), of("toxic", passes).alias("toxic")) for passes in (True, False)])
    out = parts.select("part", F.explode(two).alias("c")).select("part", "c.*")
    return out.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after the other, visits every permutation of n items once (Johnson
    and Trotter: the largest item that can move moves on; larger ones then turn round)."""
    items, ways = list(range(n)), [-1] * n
    while True:
        free = [x for x in range(n) if 0 <= items.index(x) + ways[x] < n and items[items.index(x) + ways[x]] < x]
        if not free:
            return
        x = max(free)
        at = items.index(x)
        to = at + ways[x]
        items[at], items[to] = items[to], items[at]
        for y in range(x + 1, n):
            ways[y] = -ways[y]
        yield min(at, to)


def walk(cell: dict[int, tuple[int, int, int]], n: int) -> tuple[list[tuple[tuple[int, ...], list[tuple[int, ...]]]], list[int]]:
    """(order, counts of its steps) for every order of ``n`` filters, and the removals of each filter over all of them.

    ``cell`` maps a mask to documents, good and toxic ones among them. A swap of two neighbours changes only their two
    steps: what went in before them and what is left after them stays, so only these are counted again, from the cells.
    """
    alone = [cell.get(1 << f, (0, 0, 0))[0] for f in range(n)]

    def step(gone: int, f: int) -> tuple[int, ...]:
        """kept, removed, redundant, good_lost, toxic_lost of filter ``f`` after the filters of ``gone``."""
        kept = removed = redundant = good = toxic = 0
        for mask, (docs, g, t) in cell.items():
            if mask & gone:
                redundant += docs if mask >> f & 1 else 0
            elif mask >> f & 1:
                removed, good, toxic = removed + docs, good + g, toxic + t
            else:
                kept += docs
        return kept, removed, redundant, good, toxic

    order, gone, steps, shapley = list(range(n)), 0, [], [0] * n
    for f in order:
        steps.append(step(gone, f))
        gone |= 1 << f
    visited = []

    def visit() -> None:
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]
        visited.append((tuple(order), [(s[0], s[1], s[2], alone[f], s[3], s[4]) for f, s in zip(order, steps, strict=True)]))

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        steps[i], steps[i + 1] = step(before, order[i]), step(before | 1 << order[i], order[i + 1])
        visit()
    return visited, shapley


def audit(cells: DataFrame, names: str) -> DataFrame:
    """cells (part, mask, docs, good, toxic) -> part, filter_order, step and COUNTS: every order of the filters, whose
    names are single letters and whose bits are their places in ``names``; at most MOST_FILTERS.

    A part has at most ``2 ** len(names)`` cells and is one row, so parts are walked apart from each other, and a task
    holds one of them. Missing cells count as zero, repeated ones are added; no part, no row.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS or len(set(names)) != n:
        raise ValueError(f"name 1 to {MOST_FILTERS} different filters")
    summed = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    rows = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                visited, shapley = walk({c["mask"]: (c["docs"], c["good"], c["toxic"]) for c in held}, n)
                out = [(part, "".join(names[f] for f in order), k + 1, *s, shapley[order[k]]) for order, steps in visited for k, s in enumerate(steps)]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters A to E over ``docs`` (doc_id, text, lang), a part for each language."""
    return audit(cells(docs, labels, F.col("lang")), "ABCDE")
