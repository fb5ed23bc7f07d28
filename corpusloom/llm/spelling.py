"""Spelling variants: a symmetric-delete join of distinct words, exact distance one, and roots by pointer jumping."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held, settle, store, tidy

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Odd, so it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def noisy(doc_id: int | None, run: str, every: int) -> str:
    """The run, or without one code point where ``every`` divides the checksum of ``<doc_id>:<run>``; null ids are empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31, most: int = 150_000) -> DataFrame:
    """(word, n): the distinct words of whole texts with ``least_chars`` code points and ``least_n`` occurrences.

    A word is a run of letters as ``noisy`` leaves it, A-Z lower-cased. Null texts have none; repeated rows count each.
    Runs of one text are counted before they are changed, and a task hands its counts on whenever it holds ``most``
    distinct words, so its memory is bounded by that and by one text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                for run, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    word = noisy(doc_id, run, every)
                    if len(word) >= least_chars:
                        seen[word] += n
                if len(seen) >= most:
                    yield out()
                    seen.clear()
        yield out()

    counts = docs.select("doc_id", "text").mapInArrow(tidy(count), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _mix(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point (the finaliser of splitmix64)."""
    x = codes.astype(np.uint64) + np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASE, np.uint64)])


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, 64-bit key) of every word itself and of its distinct single deletions.

    A key is the polynomial hash of the string modulo 2 ** 64. That of a deletion follows from prefix sums, so a word of
    L code points costs L steps, not L copies of itself; deleting any letter of a run of one letter gives one string,
    which is emitted once. Different strings may share a key, so pairs are verified afterwards.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.arange(len(words)), np.zeros(len(words), np.uint64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - start[of]
    with np.errstate(over="ignore"):
        terms = _mix(codes) * _powers(int(sizes.max()))[at]
        sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        before, whole = sums[:-1] - sums[start[of]], sums[np.cumsum(sizes)] - sums[start]
        without = before + (whole[of] - before - terms) * np.uint64(UNBASE)
    first = np.r_[True, codes[1:] != codes[:-1]] | (at == 0)
    return np.r_[np.arange(len(words)), of[first]], np.r_[whole, without[first]]


def _keys(words: DataFrame, most: int = 1 << 20) -> DataFrame:
    """words (id, word) -> (key, id), in parts of about ``most`` code points."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // most
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                index, key = delete_keys([texts[i] for i in part])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[part][index])], ["key", "id"])

    return words.select("id", "word").mapInArrow(tidy(emit), "key long, id long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n), words distinct -> (word, n, near, near_n), both ways: words that differ by exactly one
    inserted, deleted or replaced code point.

    Words at that distance share a key, their own or a deletion, whatever the letters; those that share one are met by an
    equi-join of (key, id), met once, and verified by their exact distance. Words that share a deletion differ in one
    letter put in at one place, so a key's group is bounded by the alphabet and the word's length, not by the corpus.
    """
    words = store(vocabulary.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling_words")
    keys = store(_keys(words), "spelling_keys")
    met = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"w{x}"), F.col("n").alias(f"n{x}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("wa", "wb", 1) == 1)
    way = F.array(*[F.struct(F.col(f"w{x}").alias("word"), F.col(f"n{x}").alias("n"), F.col(f"w{y}").alias("near"), F.col(f"n{y}").alias("near_n")) for x, y in ("ab", "ba")])
    return pairs.select(F.explode(way).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): the last form, following forms from each word.

    Forms are met with forms, so what is followed doubles each round; a form has many times the occurrences of its word,
    so no chain has a ring, and its length is bounded by the logarithm of the corpus. Each round is written to the shared
    folder and brings one number to the driver.
    """
    now = store(forms.select("word", F.col("form").alias("root")), "spelling_root")
    for _ in range(16):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = store(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_root")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now
    raise ValueError("forms follow each other in a ring")


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """vocabulary (word, n) -> word, form, root, n, n_near, form_n, one row for each word.

    The form is the near word of largest n (of equal ones the smallest by code points), if it has ``ratio`` times the
    word's n; else null. The root is the last form that forms lead to, the word itself if it has none. Other columns are
    left out; a word that comes twice must be summed before; an empty table gives an empty one.
    """
    since = held()
    vocabulary = store(vocabulary.select("word", "n"), "spelling_vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = store(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("f"), (-F.col("best.less")).alias("f_n")), "spelling_near")
    formed = F.col("f_n") >= F.col("n") * ratio
    rows = rows.select("word", F.when(formed, F.col("f")).alias("form"), "n", "n_near", F.when(formed, F.col("f_n")).alias("form_n"))
    last = roots(rows.where("form is not null").select("word", "form"))
    return settle(rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling", since)


def groups(docs: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text); ``options`` are those of ``vocabulary``."""
    return variants(vocabulary(docs, **options), ratio)
