"""Vectors as arrays of double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME, DIMENSIONS = 2166136261, 16777619, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), n), F.lit(0.0)))


def normalise(a: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    units = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.ascii(F.substring(text, i + 1, F.lit(1))).cast("long"))
    step = lambda h, c: h.bitwiseXOR(c) * FNV_PRIME % (1 << 32)
    # a code point beyond the basic plane is two units
    pair = lambda c: F.when(c < 65536, F.array(c)).otherwise(F.array(F.lit(0xD800) + F.shiftright(c - 65536, 10), F.lit(0xDC00) + (c - 65536) % 1024))
    return F.when(F.length(text) == 0, F.lit(FNV_OFFSET).cast("long")).otherwise(F.aggregate(F.flatten(F.transform(units, pair)), F.lit(FNV_OFFSET).cast("long"), step))


def trigram_buckets(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> (id, bucket, value): the sparse hashed trigram embedding, of length 1; none for an empty text.

    Lower case, blanks collapsed and trimmed, two blanks of padding on either side; each distinct trigram is hashed once
    in the corpus, not once a place.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), "\\s+", " "))
    padded = texts.select("id", F.concat(F.lit("  "), plain, F.lit("  ")).alias("p")).where(F.length("p") > 4)
    grams = padded.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring("p", i, F.lit(3)))).alias("g"))
    counts = grams.groupBy("id", "g").agg(F.count("*").alias("n"))
    table = counts.select("g").distinct().select("g", (fnv1a(F.col("g")) % DIMENSIONS).cast("int").alias("bucket"))
    buckets = counts.join(table, "g").groupBy("id", "bucket").agg(F.sum("n").alias("n"))
    length = buckets.groupBy("id").agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("l"))
    return buckets.join(length, "id").select("id", "bucket", (F.col("n") / F.col("l")).alias("value"))
