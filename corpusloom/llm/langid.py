"""Language identification in two steps: the family first, then one-versus-one linear machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import tidy

UNKNOWN = "und"
#: Families of close languages by code; a language that none lists is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "turkic": ("tr", "az", "kk", "uz"), "celtic": ("ga", "gd", "cy", "br"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "gu", "pa"), "semitic": ("ar", "he", "mt"), "malayic": ("id", "ms"),
}
BITS = 12
DIM = 1 << BITS
ORDERS = (1, 2, 3, 4)


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"={language}")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as an empty text, which doesn't."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of every n-gram of bytes: n bytes as one number, multiplied and shifted."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = data[:n].astype(np.uint64)
    for k in range(1, order):
        x = x << np.uint64(8) | data[k : k + n]
    x = (x + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array, block: int = 1 << 20) -> np.ndarray:
    """One row of DIM shares a text: the square root of each bucket's share of the byte n-grams of ORDERS, so a row has
    length one. Letters are lower-cased and all else is a space; whole texts are read, ``block`` bytes at a time."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    out = np.zeros((len(plain), DIM), np.float32)
    for row, text in zip(out, plain, strict=True):
        data = np.frombuffer(b" " + bytes(text.as_buffer()) + b" ", np.uint8)
        for at in range(0, len(data), block):
            for order in ORDERS:
                part = data[at : at + block + order - 1]
                row += np.bincount(_buckets(part, order), minlength=DIM)
    np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1), out=out)
    return out


@dataclass(frozen=True)
class Model:
    """Weights as one row a machine: ``families`` first, one-versus-rest; then the pairs of languages of each family."""

    families: tuple[str, ...]
    languages: tuple[str, ...]
    of: tuple[int, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray
    bias: np.ndarray


def linear_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised linear machine with squared hinge loss, by dual coordinate descent.

    ``y`` is 1 or -1; a side counts as much as the other, whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    slack = 1 / (2 * cost * share)
    norm = (x * x).sum(1) + slack
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            grad = y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - grad / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, a_language: int) -> DataFrame:
    """(lang, h, text): at least ``a_language`` different learnable texts of each language, or all of them; about a fifth
    more at most. They are those of the smallest hashes.

    Learnable rows aren't held out, and have a language and a letter. The share that is taken follows from a sketch of
    how many texts a language has, so nothing is sorted; equal texts are one, however many copies there are.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return rows.limit(0)
    bound = lambda n: int(-(2**63) + min(1.0, 1.2 * a_language / max(n, 1)) * (2**64 - 1))
    most = F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*[F.lit(min(bound(n), 2**63 - 1)) for n in sizes.values()]))
    return rows.where(F.col("h") <= F.element_at(most, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))


def pieces(texts: list[str]) -> list[str]:
    """Each text, and a few short runs of its words, so machines also learn from as little as a text may hold."""
    out = []
    for t in texts:
        w = t.split()
        out += [t, *(" ".join(w[at : at + n]) for n in (3, 12) for at in (len(w) // 3,) if len(w) > at)]
    return [t for t in out if any(map(str.isalpha, t))]


def fit(docs: DataFrame, a_language: int = 300) -> Model:
    """Machines learnt from at most ``a_language`` texts of each language: a bounded sample, which is all that comes to the
    driver, and of each text a row of DIM shares and two of short runs of its words.

    Learns only from ``text`` and ``lang`` of rows that aren't held out. Without one, the model knows no language. Whole
    texts are featurised where they lie.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = features(pa.array(pieces([text]), pa.string())).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array([h] * len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "h", "x"])

    rows = sample(docs, a_language).mapInArrow(tidy(rows_of), "lang string, h long, x binary").collect()
    languages = sorted({r.lang for r in rows})
    kept = {c: set(sorted({r.h for r in rows if r.lang == c})[:a_language]) for c in languages}
    rows = sorted((r for r in rows if r.h in kept[r.lang]), key=lambda r: (r.lang, r.h, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32)
    y = np.array([languages.index(r.lang) for r in rows])
    families = sorted({family_of(c) for c in languages})
    of = [families.index(family_of(c)) for c in languages]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if of[a] == of[b]]
    machines = []
    if len(families) > 1:
        inside = np.array(of)[y]
        machines += [linear_machine(x, np.where(inside == k, 1, -1)) for k in range(len(families))]
    else:
        machines += [(np.zeros(DIM), 0.0) for _ in families]
    for a, b in pairs:
        some = (y == a) | (y == b)
        machines.append(linear_machine(x[some], np.where(y[some] == a, 1, -1)))
    weights = np.stack([w for w, _ in machines]).astype(np.float32) if machines else np.zeros((0, DIM), np.float32)
    return Model(tuple(families), tuple(languages), tuple(of), tuple(pairs), weights, np.array([b for _, b in machines], np.float32))


def decide(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row: the family of the largest margin, then the language that wins most of the pairs
    of that family; equal wins go to the larger sum of margins, then to the first by name.

    The score is the family's share of the exponentials of the family margins, times the logistic of the winner's least
    margin against a language of its family; margins count fourfold.
    """
    m = x @ model.weights.T + model.bias
    n, of = len(model.families), np.array(model.of)
    top = m[:, :n]
    family = top.argmax(1)
    share = np.exp(4 * (top - top.max(1, keepdims=True)))
    score = share[np.arange(len(x)), family] / share.sum(1)
    wins, sums = np.zeros((len(x), len(of))), np.zeros((len(x), len(of)))
    least = np.full((len(x), len(of)), np.inf)
    for k, (a, b) in enumerate(model.pairs):
        margin = m[:, n + k]
        for lang, way in ((a, margin), (b, -margin)):
            wins[:, lang] += (way > 0) | ((way == 0) & (lang == a))
            sums[:, lang] += way
            least[:, lang] = np.minimum(least[:, lang], way)
    rank = np.where(of == family[:, None], wins * 1e6 + np.clip(sums, -1e3, 1e3), -np.inf)
    best = rank.argmax(1)
    with np.errstate(over="ignore"):
        return best, score / (1 + np.exp(-4 * least[np.arange(len(x)), best]))


def identify(docs: DataFrame, model: Model, rows: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only its text decides.

    A null text, one without a letter, and any text where the model knows no language are UNKNOWN with score 0. Whole
    texts are read, ``rows`` at a time; equal texts have equal results; null ids aren't held out. The model is bounded
    by the languages, not by the corpus, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, UNKNOWN])
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                known = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)) if m.languages else np.zeros(0, np.int64)
                best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
                if len(known):
                    best[known], score[known] = decide(m, features(batch.column(3).take(pa.array(known))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")), has_letter(F.col("text")), "text").mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
