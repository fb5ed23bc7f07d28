"""Order MinHash: fingerprints that follow edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import let, words

K, BIN_BITS, HASH_BITS, LONG_WORD, PIECE = 3, 6, 34, 32, 8


def tokens(text: Column) -> Column:
    """The words of a text; words over 32 code points are cut into pieces of 8, so unspaced text has order too."""
    cut = lambda w: F.when(F.length(w) <= LONG_WORD, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{PIECE}}}"), 0))
    has = F.coalesce(text, F.lit("")).rlike(f"[^\\x20\\x09-\\x0D]{{{LONG_WORD + 1}}}")
    return F.when(has, F.flatten(F.transform(words(text), cut))).otherwise(words(text))


def signature(text: Column, k: int = K, bin_bits: int = BIN_BITS) -> Column:
    """The order MinHash of a text: up to ``2**bin_bits`` components, ascending by bin.

    Every k-mer of words gets the number of its earlier occurrences in the text; (k-mer, occurrence) is hashed once
    and the top bits of the hash deal it to a bin (one hash pass dealt into bins stands for one pass a component). In
    each bin the two smallest are kept, put back in text order and hashed as a tuple. Hash and position share 64 bits,
    so sorting longs does the selection. A text with fewer than k words is one k-mer; one without words has no
    component. Equal texts have equal signatures.
    """
    shift = lambda x, n: F.call_function("shiftright", x, n if isinstance(n, Column) else F.lit(n))
    long = lambda x: F.lit(x).cast("long")

    def tuples(top: Column, bits: Column, mask: Column) -> Column:
        bin_of = lambda x: F.shiftrightunsigned(x, 64 - bin_bits)
        heads = F.filter(F.sequence(F.lit(0), F.size(top) - 1), lambda i: (i == 0) | (bin_of(F.get(top, i)) != bin_of(F.get(top, i - 1))))

        def pair(i: Column) -> Column:
            a = F.get(top, i)
            b = F.coalesce(F.when(bin_of(F.get(top, i + 1)) == bin_of(a), F.get(top, i + 1)), a)
            ordered = F.when(a.bitwiseAND(mask) <= b.bitwiseAND(mask), F.xxhash64(shift(a, bits), shift(b, bits))).otherwise(F.xxhash64(shift(b, bits), shift(a, bits)))
            return F.shiftleft(bin_of(a), HASH_BITS).bitwiseOR(ordered.bitwiseAND(long((1 << HASH_BITS) - 1)))

        return F.sort_array(F.transform(heads, pair))

    def select(every: Column, bits: Column, mask: Column) -> Column:
        bin_of = lambda x: F.shiftrightunsigned(x, 64 - bin_bits)
        top = F.filter(every, lambda x, i: (i < 2) | (bin_of(F.get(every, i - 2)) != bin_of(x)))
        return let(top, lambda t: tuples(t, bits, mask))

    def number(p: Column, bits: Column, mask: Column) -> Column:
        """p: sorted (k-mer hash, position). Later occurrences get a hash of their own."""
        again = lambda i: shift(F.get(p, i), bits) == shift(F.get(p, i - 1), bits)
        repeats = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i > 0) & again(i))

        def renumber(r: Column) -> Column:
            starts = F.filter(r, lambda x, j: (j == 0) | (F.get(r, j - 1) != x - 1))
            ends = F.filter(r, lambda x, j: (j == F.size(r) - 1) | (F.get(r, j + 1) != x + 1))
            new = lambda i, s: F.xxhash64(shift(F.get(p, i), bits), i - s + 1).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(F.get(p, i).bitwiseAND(mask))
            later = F.flatten(F.zip_with(starts, ends, lambda s, e: F.transform(F.sequence(s, e), lambda i: new(i, s))))
            first = F.filter(p, lambda x, i: (i == 0) | (shift(x, bits) != shift(F.get(p, i - 1), bits)))
            return F.when(F.size(r) == 0, p).otherwise(F.sort_array(F.concat(first, later)))

        return let(let(repeats, renumber), lambda every: select(every, bits, mask))

    def kmers(w: Column) -> Column:
        bits = F.when(F.size(w) < 1 << 25, 25).otherwise(31)
        mask = F.call_function("shiftleft", long(1), bits) - 1
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(F.bitwise_not(mask)))
        packed = F.when(F.size(w) < k, whole).otherwise(F.sort_array(hashed))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(let(packed, lambda p: number(p, bits, mask)))

    return let(tokens(text), kmers)


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either signature whose components agree; 1 where both are empty."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, HASH_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def text_of(sig: Column) -> Column:
    """A signature as text: ten hexadecimal digits a component."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), (BIN_BITS + HASH_BITS + 3) // 4, "0")), "")


def _bucket(col: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``col``: by two short scans."""
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs, kind: F.from_json(F.lit(str(xs)), kind)
    coarse = F.size(F.filter(array([p[0] for p in parts], "array<bigint>"), lambda b: b <= col))
    fine = F.get(array(parts, "array<array<bigint>>"), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= col))).cast("int")


def with_next(docs: DataFrame, carry: list[str], max_buckets: int = 1 << 16) -> DataFrame:
    """``docs`` (doc_id and ``carry``) with ``next_<c>`` of the row next in descending doc_id; after the last, the first.

    Rows are dealt by ranges of doc_id, found from its quantiles, and each range gets a copy of the first row of the
    range below, so no range needs another and text is shuffled once. What reaches the driver, and is broadcast, is one
    row a range: at most ``max_buckets``. Rows with equal doc_id follow a hash of the text; null ids come last.
    """
    spark = docs.sparkSession
    n = min(max_buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(cuts or [0]))
    bucket = F.coalesce(_bucket(F.col("doc_id"), bounds), F.lit(0))
    heads = sorted(docs.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("head")).collect())
    ghosts = [(heads[i].head, heads[(i + 1) % len(heads)].b) for i in range(len(heads))]
    ghosts = F.broadcast(spark.createDataFrame(ghosts, "__head long, __into int"))
    rows = docs.join(ghosts, F.col("doc_id").eqNullSafe(F.col("__head")), "left")
    at = lambda b, ghost: F.struct(b.alias("b"), F.lit(ghost).alias("ghost"))
    own = at(bucket, False)
    rows = rows.select("doc_id", *carry, F.explode(F.when(F.col("__into").isNull(), F.array(own)).otherwise(F.array(own, at(F.col("__into"), True)))).alias("__at"))
    order = Window.partitionBy("__at.b").orderBy("__at.ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.select("doc_id", *carry, "__at", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return rows.where("not __at.ghost").drop("__at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last third replaced by the beginning of the next document. Null texts count as empty; two
    texts without words are alike (1). A table of one row is its own next; an empty table gives no row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", signature(F.col("text")))
    rows = with_next(rows, ["text", "sig"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", "sig", "next_sig", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    rows = rows.withColumn("edited_sig", signature(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sig")).alias("fingerprint"), text_of(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
