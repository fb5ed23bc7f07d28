"""N-gram Jaccard join: prefixes of rare tokens, combinations of frequent ones, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held, offer, settle, small, store, tidy
from corpusloom.operators.components import connected

GRAM, PERCENT = 5, 80
BLOCK = 1 << 16
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Hashes(dict):
    """word -> 64-bit hash, kept for at most ``most`` words."""

    def __init__(self, seed: int, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


def shingles(text: bytes, hashes: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; of the whole sequence where it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < GRAM:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), hashes.seed + 1)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    x = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        x = (x ^ h[k : k + len(x)]) * ODD[k]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _ids(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set: the second tells whether the first ever stands for two sets."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    low, high = d & (2**64 - 1), d >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def describe_sets(docs: DataFrame, seed: int, sketch_bits: int) -> DataFrame:
    """A row for each document (doc_id, n, sid, twin) and, for each task, its counts of tokens in hashed counters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, size = Hashes(seed), np.zeros(1 << sketch_bits, np.uint32), [], 0
        mask = np.uint64((1 << sketch_bits) - 1)

        def flush() -> None:
            nonlocal held, size
            if held:
                np.add.at(counts, (np.concatenate(held) & mask).astype(np.int64), np.uint32(1))
            held, size = [], 0

        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                tokens = shingles(text, hashes)
                rows.append((len(tokens), *_ids(tokens)))
                held.append(tokens)
                size += len(tokens)
                if size > 1_000_000:
                    flush()
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "sid", "twin", "block", "counts"])
        flush()
        pack = zstandard.ZstdCompressor(level=1)
        used = [b for b in range(max(1, len(counts) // BLOCK)) if counts[b * BLOCK : (b + 1) * BLOCK].any()]
        data = [pack.compress(counts[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "n", "sid", "twin", "block", "counts"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), "doc_id long, n long, sid long, twin long, block int, counts binary")


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts of any size as one byte each, in steps of an eighth of a doubling: the order of counts, in bounded space."""
    return np.minimum(255, np.floor(8 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


def sketch(described: DataFrame, sketch_bits: int) -> tuple[np.ndarray, int]:
    """The levels of the counts of all tokens of all documents, in ``2**sketch_bits`` hashed counters, and the level
    over which a token is frequent: twice the mean counter, so it grows with the corpus and only tokens that stand out
    from a full table are frequent."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, total = zstandard.ZstdDecompressor(), None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([levels(total).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["block", "levels", "total"])
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if total is not None:
                        yield out()
                    now, total = block, np.zeros(min(BLOCK, 1 << sketch_bits), np.uint64)
                total += np.frombuffer(unpack.decompress(data, max_output_size=4 * BLOCK), np.uint32)
        if total is not None:
            yield out()

    blocks = described.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    table, every = np.zeros(1 << sketch_bits, np.uint8), 0
    for r in blocks.mapInArrow(tidy(add), "block int, levels binary, total long").collect():
        table[r.block * BLOCK : r.block * BLOCK + min(BLOCK, len(table))] = np.frombuffer(r.levels, np.uint8)
        every += r.total
    return table, int(levels(np.array([2 * every / len(table) + 64]))[0])


def bits_for(docs: DataFrame, least: int = 22, most: int = 24) -> int:
    """Counters for a corpus of the planner's size, one for each 256 bytes: from 4 million, at most 16 million."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(most, (size // 256).bit_length()))


def keys_of(tokens: np.ndarray, counts: np.ndarray, frequent: int, most_combined: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The keys a set is indexed under, their kinds (0 rare token, 1 combination, 2 frequent token), and whether it is wide.

    Tokens are ordered by their count, rarest first, then by hash: one order for all sets. Two sets that link share at
    least two tokens among the first n - ceil(0.8 n) + 2 of each (or all their tokens, where a set has one). If one of
    those is rare, its own key meets; else two frequent tokens do, and the key of that combination meets. A set with
    over ``most_combined`` frequent tokens there is wide: it isn't combined, and meets others under single tokens.
    """
    n = len(tokens)
    est = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]
    length = min(n, n - -(-PERCENT * n // 100) + 2)
    pre = tokens[np.argsort(est, kind="stable")[:length]] if length < n else tokens
    common = counts[(pre & np.uint64(len(counts) - 1)).astype(np.int64)] > frequent
    rare, often = pre[~common], pre[common]
    if n == 1:
        return pre, np.zeros(1, np.int8), False
    wide = len(often) > most_combined
    parts, kinds = [rare, often], [np.zeros(len(rare), np.int8), np.full(len(often), 2, np.int8)]
    if len(often) > 1 and not wide:
        i, j = np.triu_indices(len(often), 1)
        a, b = np.minimum(often[i], often[j]), np.maximum(often[i], often[j])
        parts.append((a * ODD[0]) ^ ((b * ODD[1]) >> np.uint64(7)) ^ b)
        kinds.append(np.ones(len(i), np.int8))
    return np.concatenate(parts), np.concatenate(kinds), wide


def index(docs: DataFrame, counts: np.ndarray, seed: int, frequent: int, most_combined: int) -> DataFrame:
    """(key, kind, narrow, pure, n, sid) of every document under each of its keys; a task skips sets it has just indexed.
    A set is pure if no token of its prefix is frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = Hashes(seed), set()
        table = shared.value
        for batch in batches:
            rows: list[tuple[np.ndarray, np.ndarray, bool, int, int]] = []
            size = 0

            def out(rows=rows) -> pa.RecordBatch:
                lens = [len(r[0]) for r in rows]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.repeat([not r[2] for r in rows], lens)), pa.array(np.repeat([not r[1].any() for r in rows], lens)), pa.array(np.repeat(np.array([r[3] for r in rows], np.int32), lens)), pa.array(np.repeat(np.array([r[4] for r in rows], np.int64), lens))], ["key", "kind", "narrow", "pure", "n", "sid"])

            for text in _texts(batch.column(0)):
                tokens = shingles(text, hashes)
                sid = _ids(tokens)[0]
                if not len(tokens) or sid in done:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(sid)
                keys, kinds, wide = keys_of(tokens, table, frequent, most_combined)
                rows.append((keys, kinds, wide, len(tokens), sid))
                size += len(keys)
                if size > 500_000:
                    yield out()
                    rows.clear()
                    size = 0
            if rows:
                yield out()

    return docs.select("text").mapInArrow(tidy(work), "key long, kind byte, narrow boolean, pure boolean, n int, sid long")


def lists(entries: DataFrame, longest: int) -> DataFrame:
    """Candidates of keys that two or more sets share: pairs (a, b) of short lists, members (a, list) of long ones.

    With a pair come ``met``, the keys at which it has met, and ``need``, how many it takes: two linked sets share two
    tokens of their prefixes, so where one of them is pure they meet at two keys, or once in a list that is long.
    Entries arrive sorted, wide sets first, then by size, and are read as a stream: a list of any length takes the
    memory of ``longest`` entries. Under single frequent tokens only pairs with a wide set count, as combinations find
    the others. Pairs whose sizes rule out a link are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int8, bool, bool, np.int64, np.int64)]
        long_key = None  # a list over the limit whose members are being passed on

        def out(a: list, b: list, need: list, members: list, keys: list) -> pa.RecordBatch:
            whole = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)])
            a, b, need, m, k = map(whole, (a, b, need, members, keys))
            met = need
            if len(a):
                both, met = np.unique(np.stack([a, b, need], 1), axis=0, return_counts=True)  # a < b
                a, b, need = both[:, 0], both[:, 1], both[:, 2]
            none = lambda kind: pa.nulls(len(m), kind)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, m])), pa.concat_arrays([pa.array(b), none(pa.int64())]), pa.concat_arrays([pa.array(met.astype(np.int32)), none(pa.int32())]), pa.concat_arrays([pa.array(need.astype(np.int32)), none(pa.int32())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(k)])], ["a", "b", "met", "need", "list"])

        def process(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            nonlocal long_key
            key, kind, narrow, pure, n, sid = cols
            fresh = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])] if len(key) else np.empty(0, bool)
            starts = np.flatnonzero(fresh)
            ends = np.r_[starts[1:], len(key)]
            a, b, need, members, keys = [], [], [], [], []
            keep = len(key)
            some = ((ends - starts) > 1) | (ends == len(key))  # a single entry counts where its list goes on, or may go on
            if len(key):
                some[0] |= (int(key[0]), int(kind[0])) == long_key
            for s, e in zip(starts[some], ends[some], strict=True):
                this = (int(key[s]), int(kind[s]))
                if e == len(key) and not last and e - s <= longest and this != long_key:
                    keep = s
                    break
                if kind[s] == 2 and narrow[s] and this != long_key:
                    continue  # no wide set among them
                if this == long_key or e - s > longest:
                    long_key = this
                    u = np.unique(sid[s:e])
                    members.append(u)
                    keys.append(np.full(len(u), this[0] ^ this[1]))
                    continue
                u, first = np.unique(sid[s:e], return_index=True)
                if len(u) < 2:
                    continue
                size, wide, alone = n[s:e][first], ~narrow[s:e][first], pure[s:e][first]
                i, j = np.triu_indices(len(u), 1)
                ok = 100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j])
                if kind[s] == 2:
                    ok &= wide[i] | wide[j]
                a.append(u[i[ok]])
                b.append(u[j[ok]])
                need.append(1 + (alone[i[ok]] | alone[j[ok]]))
            return [c[keep:] for c in cols], out(a, b, need, members, keys)

        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(h.dtype)]) for i, h in enumerate(held)]
            held, made = process(cols, False)
            yield made
        yield process(held, True)[1]

    ordered = entries.repartition("key").sortWithinPartitions("key", "kind", "narrow", "n", "sid")
    return ordered.select("key", "kind", "narrow", "pure", "n", "sid").mapInArrow(tidy(work), "a long, b long, met int, need int, list long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int32())) for i in (0, 1)], ["a", "b"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the tokens that both sides hold."""
    if left is right:
        shared, times = np.unique(np.concatenate(left), return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [np.searchsorted(shared, s) for s in sets]
        hit = [p[(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == s)] for p, s in zip(at, sets, strict=True)]
        return np.repeat(np.arange(len(sets)), [len(h) for h in hit]), np.concatenate(hit)

    if len(shared):
        (lr, lc), (rr, rc) = incidence(left), incidence(right)
        for c in range(0, len(shared), columns):
            width = min(columns, len(shared) - c)
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            for m, r, k in ((a, lr, lc), (b, rr, rc)):
                inside = (k >= c) & (k < c + width)
                m[r[inside], k[inside] - c] = 1
            out += a @ b.T
    if left is right:  # a set's own tokens count even where no other set holds them
        np.fill_diagonal(out, [len(x) for x in left])
    return out


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node it reaches) that connect what the links (a, b) connect: fewer rows than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _meet(sids: list[list[int]], sets: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The links within one chunk of sets or between two, thinned to stars: fewer rows than sets."""
    left, right = sets[0], sets[1] or sets[0]
    both = _overlaps(left, right).astype(np.int64)
    nl, nr = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    i, j = np.nonzero(100 * both >= PERCENT * (nl + nr - both))
    off = i != j if left is right else np.ones(len(i), bool)
    return _stars(np.array(sids[0], np.int64)[i[off]], np.array(sids[1] or sids[0], np.int64)[j[off]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, sid, tokens) sorted by block -> the links of each block; one block is held at a time."""
    now, sids, sets = None, [[], []], [[], []]

    def out() -> pa.RecordBatch:
        a, b = _meet(sids, sets)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for block, side, sid, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if block != now:
                if sids[0]:
                    yield out()
                now, sids, sets = block, [[], []], [[], []]
            sids[side].append(sid)
            sets[side].append(np.frombuffer(tokens.as_buffer().to_pybytes(), np.uint64))
    if sids[0]:
        yield out()


def _fetch(docs: DataFrame, wanted: DataFrame, seed: int, filter_bits: int = 1 << 23) -> DataFrame:
    """(sid, n, tokens) of the wanted sets (sid, doc_id): texts are hashed anew, and only of documents that a bitmap of
    bounded size names; an exact join follows. Rows that repeat one doc_id and text give their set as often."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(filter_bits))
    bits = wanted.select(hashed.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    named = {r.bucket: bytes(r.bits) for r in bits.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(named)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = Hashes(seed), shared.value
        for batch in batches:
            h = batch.column(1).to_pylist()
            rows = []
            for i, x in enumerate(h):
                at = x % 32768 - 1 if x % 32768 else 32767
                bits_ = table.get((x - 1) // 32768 + 1 if x else 0)
                if x == 0:
                    bits_, at = table.get(0), 0
                if bits_ and bits_[at // 8] >> (at % 8) & 1:
                    rows.append(i)
            texts = batch.column(0).take(pa.array(rows, pa.int32()))
            sets = [shingles(t, hashes) for t in _texts(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([_ids(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(2).take(pa.array(rows, pa.int32()))], ["sid", "n", "tokens", "doc_id"])

    found = docs.select("text", hashed.alias("h"), "doc_id").mapInArrow(tidy(work), "sid long, n int, tokens binary, doc_id long")
    named_by = wanted.select("sid", F.col("doc_id").alias("named"))
    on = (found["sid"] == named_by["sid"]) & found["doc_id"].eqNullSafe(F.col("named"))
    return found.join(offer(named_by, 1_000_000), on, "left_semi").select("sid", "n", "tokens")


def links(docs: DataFrame, described: DataFrame, counts: np.ndarray, frequent: int, seed: int, longest: int, most_combined: int, chunk_sets: int, chunk_tokens: int) -> DataFrame:
    """Links (a, b) between set names that connect exactly what all links connect."""
    since = held()
    found = store(lists(index(docs, counts, seed, frequent, most_combined), longest), "jaccard_lists")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need")).where("met >= need").select("a", "b")
    members = found.where("b is null").select(F.col("a").alias("sid"), "list").distinct()
    pairs = store(pairs, "jaccard_pairs")
    first = members.groupBy("list").agg(F.min("sid").alias("first"))
    meeting = pairs.union(members.join(first, "list").selectExpr("sid", "first"))
    clusters = store(connected(meeting), "jaccard_clusters").selectExpr("node as sid", "root as cluster")
    ids = described.where("block is null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    wanted = store(clusters.join(ids, "sid").select("sid", "cluster", "doc_id", "n"), "jaccard_wanted")
    sets = store(_fetch(docs, wanted.select("sid", "doc_id"), seed), "jaccard_sets")

    # sets that may link at all are in one cluster; a small one is compared as a whole, its sets sent once
    size = wanted.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    large = store(size.where((F.col("sets") > chunk_sets) | (F.col("tokens") > 4 * chunk_tokens)).select("cluster"), "jaccard_large")
    blocked = lambda rows: rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_blocks), "a long, b long")
    if small(large, 0):  # no cluster needs more
        whole = sets.join(offer(wanted.select("sid", F.col("cluster").alias("block")), 1_000_000), "sid")
        return settle(blocked(whole.select("block", F.lit(0).alias("side"), "sid", "tokens")), "jaccard_links", since)
    large = offer(large)
    hot_ids = members.select("sid").distinct().withColumn("hot", F.lit(True))
    placed = clusters.join(large.withColumn("large", F.lit(True)), "cluster", "left").join(hot_ids, "sid", "left")
    placed = store(placed.select("sid", "cluster", F.coalesce("large", F.lit(False)).alias("large"), F.coalesce("hot", F.lit(False)).alias("hot")), "jaccard_placed")
    here = sets.join(offer(placed, 1_000_000), "sid")
    whole = here.where("not large").select(F.col("cluster").alias("block"), F.lit(0).alias("side"), "sid", "tokens")

    # of a large one, sets of long lists are cut into chunks of like size, and chunks are compared
    hot = here.where("large and hot").select("sid", "n", "cluster", "tokens", F.floor(F.ln("n") / 0.05).cast("int").alias("step"))
    parts = hot.groupBy("cluster", "step").agg(F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum("n") / chunk_tokens)).cast("int").alias("parts"), F.min("n").alias("low"), F.max("n").alias("high"))
    parts = store(parts, "jaccard_parts")
    chunks = parts.select("cluster", "step", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x, y = chunks.alias("x"), chunks.alias("y")
    near = (F.col("x.cluster") == F.col("y.cluster")) & ((F.col("x.step") < F.col("y.step")) | ((F.col("x.step") == F.col("y.step")) & (F.col("x.part") <= F.col("y.part")))) & (100 * F.col("x.high") >= PERCENT * F.col("y.low"))
    meet = x.join(y, near).select(F.col("x.cluster").alias("cluster"), F.struct("x.step", "x.part").alias("p"), F.struct("y.step", "y.part").alias("q"))
    at = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("at"))
    each = meet.select("cluster", "p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array(at(0, "p"))).otherwise(F.array(at(0, "p"), at(1, "q")))).alias("s"))
    each = each.select("cluster", F.xxhash64("cluster", "p.step", "p.part", "q.step", "q.part").alias("block"), "s.side", F.col("s.at.step").alias("step"), F.col("s.at.part").alias("part"))
    dealt = hot.join(offer(parts.select("cluster", "step", "parts")), ["cluster", "step"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.join(offer(store(each, "jaccard_chunks")), ["cluster", "step", "part"]).select("block", "side", "sid", "tokens")
    blocks = blocked(whole.union(dealt))

    # and its pairs of short lists are verified one by one, but those that chunks compare anyhow
    of = placed.where("large").select("sid", "hot")
    rest = pairs.join(offer(of.selectExpr("sid as a", "hot as hot_a"), 1_000_000), "a").join(offer(of.selectExpr("sid as b", "hot as hot_b"), 1_000_000), "b").where("not (hot_a and hot_b)").select("a", "b")
    rest = store(rest, "jaccard_rest")

    def side(s: str) -> DataFrame:
        """The sets on one side of the pairs; those of the other side alone stay out of its shuffle."""
        named = offer(rest.select(F.col(s).alias("sid")).distinct(), 1_000_000)
        return sets.join(named, "sid", "left_semi").select(F.col("sid").alias(s), F.col("tokens").alias(f"{s}_tokens"))

    single = rest.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(tidy(_verify), "a long, b long")
    return settle(blocks.union(single), "jaccard_links", since)


def group(docs: DataFrame, sketch_bits: int | None = None, longest: int = 32, most_combined: int = 24, chunk_sets: int = 1024, chunk_tokens: int = 1 << 20, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id for every document.

    A document's set is its distinct five-word shingles (A-Z lower-cased); with fewer words the whole sequence is its
    one shingle; null and empty texts have none and are alone. Documents link when 100 |x and y| >= 80 |x or y|;
    component_id is the smallest doc_id that links reach. Equal sets are one set from the start, so copies are never
    paired. ``sketch_bits`` bounds the table of counts that orders tokens, by default as large as ``bits_for`` says: any
    order gives the same links, a better one fewer candidates. Lists of up to ``longest`` sets give pairs; longer ones are compared in chunks of ``chunk_sets``
    sets. Rows with a null doc_id take part, but name no component unless alone, where component_id is null.
    """
    sketch_bits = sketch_bits or bits_for(docs)
    while True:
        described = store(describe_sets(docs, seed, sketch_bits), "jaccard_described")
        sets = described.where("block is null")
        if not sets.groupBy("sid").agg(F.min("twin").alias("x"), F.max("twin").alias("y")).where("x <> y").limit(1).count():
            break
        seed += 2  # two sets share a name: name them anew
    found = links(docs, described, *sketch(described, sketch_bits), seed, longest, most_combined, chunk_sets, chunk_tokens)
    roots = connected(found)
    smallest = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = smallest.join(roots, smallest.sid == roots.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    named = store(named, "jaccard_named")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(best, "root").select("sid", "component_id")
    rows = sets.join(by_set, "sid", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("sid").alias("set_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest doc_id; same columns.

    Documents without words aren't duplicates of each other and stay; so do rows without doc_id. Of rows that repeat
    one doc_id with linked texts, all stay that carry the kept id.
    """
    since = held()
    found = group(docs, **options).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    found = settle(found, "jaccard_gone", since)
    return docs.join(F.broadcast(found) if small(found, 1_000_000) else found, docs["doc_id"] == found["__gone"], "left_anti")
