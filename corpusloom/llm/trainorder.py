"""Training order: a keyed permutation of all sequences, written as fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import posixpath
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, filesystem, scratch, store, tidy

#: One index record for each slot of a shard: where its tokens begin, how many there are, whose they are.
INDEX = np.dtype([("begin", "<u8"), ("tokens", "<u8"), ("doc_id", "<i8"), ("has_id", "<u8")])
#: The split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser keyed by addition."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(ordinals: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(n): a balanced Feistel network, walked until it lands below n.

    The network permutes the least even power of two that holds n, so a walk takes under four steps on average, and
    walking a cycle from a point below n always comes back below n, to a point of its own.
    """
    if n <= 1:
        return ordinals.astype(np.uint64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, key * 64 + r) & low)
        return (left << half) | right

    out = network(ordinals.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = network(out[outside])
    return out


def _splits(docs: DataFrame, most: int = 4_000_000) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """``docs`` with the input split of each row, the splits and the ordinal at which each begins, and the number of rows.

    Rows keep their order within a split, so (split, position) numbers all rows without moving or sorting a text. A
    table that isn't read straight from files is written to the shared folder first. Splits are named by 64-bit hashes:
    16 bytes a split reach the driver and the workers, and over ``most`` splits raise an error.
    """
    file, start = F.input_file_name(), F.input_file_block_start()
    name = F.when(file != "", F.xxhash64(file, start)).alias("split")
    while True:
        rows = docs.select(name, "doc_id", "text")
        counts = docs.select(name, file.alias("file"), start.alias("start")).groupBy("split", "file", "start").agg(F.count("*").alias("n"))
        counts = counts.orderBy("file", "start").select("split", "n").limit(most + 1).toPandas()
        if not counts["split"].isna().any():
            break
        docs = store(docs.select("doc_id", "text"), "order_docs")
    if len(counts) > most:
        raise ValueError(f"over {most} input splits: raise spark.sql.files.maxPartitionBytes")
    n, splits = counts["n"].to_numpy(np.int64), counts["split"].to_numpy(np.int64)
    order = np.argsort(splits)
    return rows, splits[order], (np.cumsum(n) - n)[order], int(n.sum())


def sequences(docs: DataFrame, vocabulary: str, key: int) -> tuple[DataFrame, int]:
    """(slot, doc_id, n_tokens, tokens): every document tokenised, with its global slot; and how many there are."""
    rows, splits, begins, total = _splits(docs)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((Path(vocabulary).read_bytes(), splits, begins))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, names, starts = shared.value
        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
        width = np.uint16 if bpe.n_vocab <= 1 << 16 else np.uint32
        pack = zstandard.ZstdCompressor(level=1)
        at: dict[int, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                split, ids, texts = batch.slice(begin, 200).to_pydict().values()
                ordinals = []
                for s in split:
                    if s not in at:
                        i = int(np.searchsorted(names, s))
                        if i == len(names) or names[i] != s:
                            raise RuntimeError(f"the input was split differently between two scans: {s}")
                        at[s] = int(starts[i]) - 1
                    at[s] += 1
                    ordinals.append(at[s])
                slots = permute(np.array(ordinals, np.uint64), total, key)
                tokens = [np.array(bpe.encode_ordinary(t or ""), width) for t in texts]
                columns = [pa.array(slots.astype(np.int64)), pa.array(ids, pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([pack.compress(t.tobytes()) for t in tokens], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "n_tokens", "tokens"])

    return rows.mapInArrow(tidy(tokenise), "slot long, doc_id long, n_tokens long, tokens binary"), total


def write(docs: DataFrame, root: str, vocabulary: str, key: int = 20_260_101, stride: int = 4096, waves: int = 16) -> DataFrame:
    """Materialise ``docs`` in training order under ``root``; returns the shards (shard, path, sequences, tokens, width).

    Shard k holds the slots from k * stride to (k + 1) * stride, its tokens one after another in ``shard-k.bin``
    (little-endian, 2 bytes a token where the vocabulary allows, else 4) and a record of fixed size for each slot in
    ``shard-k.idx``: a reader finds any slot by arithmetic and resumes there. Tokens cross one shuffle, compressed,
    dealt by ranges of slots; a task streams its shards and never holds one in memory. Files get their names by
    renaming, so a retried task replaces its own. Null and empty texts are sequences of no tokens; repeated rows are
    sequences of their own; an empty table gives no shard. Shards are dealt to at most ``waves`` times as many tasks as
    the session shuffles to, neighbours to one task.
    """
    width = 2 if sum(1 for _ in Path(vocabulary).open("rb")) <= 1 << 16 else 4
    rows, total = sequences(docs, vocabulary, key)
    shards = -(-total // stride)
    a_task = max(1, -(-shards // (waves * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    partitions = max(1, -(-shards // a_task))
    rows = rows.withColumn("part", F.expr(f"cast(slot div {stride * a_task} as int)"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = filesystem(root)
        disk.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        unpack = zstandard.ZstdDecompressor()
        done, now, out, index, at = [], None, None, [], 0

        def close() -> None:
            out.close()
            path = posixpath.join(base, f"shard-{now:08d}")
            with disk.open_output_stream(f"{path}.idx.{attempt}", compression=None) as f:
                f.write(np.array(index, INDEX).tobytes())
            disk.move(f"{path}.idx.{attempt}", f"{path}.idx")
            disk.move(f"{path}.bin.{attempt}", f"{path}.bin")
            done.append((now, posixpath.join(root, f"shard-{now:08d}"), len(index), at))

        for batch in batches:
            for slot, doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if slot // stride != now:
                    if out is not None:
                        close()
                    now, index, at = slot // stride, [], 0
                    out = disk.open_output_stream(posixpath.join(base, f"shard-{now:08d}.bin.{attempt}"), compression=None)
                if slot != now * stride + len(index):
                    raise RuntimeError(f"slot {slot} where {now * stride + len(index)} should follow")
                out.write(unpack.decompress(data, max_output_size=n * width) if n else b"")
                index.append((at, n, -1 if doc is None else doc, doc is not None))
                at += n
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64()), pa.array([width] * len(done), pa.int32())], ["shard", "path", "sequences", "tokens", "width"])

    ordered = rows.repartitionById(partitions, "part").sortWithinPartitions("slot").select("slot", "doc_id", "n_tokens", "tokens")
    made = store(ordered.mapInArrow(tidy(put), "shard long, path string, sequences long, tokens long, width int"), "order_shards")
    written = made.agg(F.coalesce(F.sum("sequences"), F.lit(0)).alias("n")).first().n
    if written != total:
        raise RuntimeError(f"{written} of {total} sequences were written")
    return made


def read_shard(path: str, width: int, first: int = 0) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(position, doc_id, tokens) of a shard in order, from position ``first`` on: one seek, then sequential reads."""
    disk, at = filesystem(path)
    with disk.open_input_file(f"{at}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    if first >= len(index):
        return
    with disk.open_input_file(f"{at}.bin") as f:
        f.seek(int(index[first]["begin"]) * width)
        for i in range(first, len(index)):
            n = int(index[i]["tokens"])
            yield i, int(index[i]["doc_id"]) if index[i]["has_id"] else None, np.frombuffer(f.read(n * width), "<u2" if width == 2 else "<u4")


def read_back(shards: DataFrame, stride: int = 4096) -> DataFrame:
    """doc_id, slot, shard, n_tokens, tokens_sha256 (of decimal ids joined by a space), read from the shards."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("slot", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("tokens_sha256", pa.string())])
        for batch in batches:
            for shard, path, width in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for i, doc, tokens in read_shard(path, width):
                    rows.append((doc, shard * stride + i, shard, len(tokens), hashlib.sha256(b" ".join(b"%d" % t for t in tokens.tolist())).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt(shards.select("shard", "path", "width"), "shard").mapInArrow(tidy(get), "doc_id long, slot long, shard long, n_tokens long, tokens_sha256 string")


def materialise(docs: DataFrame, vocabulary: str, key: int = 20_260_101, stride: int = 4096) -> DataFrame:
    """Write ``docs`` in training order to the shared folder and read every sequence back from its shard."""
    return read_back(write(docs, scratch(docs.sparkSession, "order"), vocabulary, key, stride), stride)
