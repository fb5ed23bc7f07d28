"""BPE encoding through a distinct-word table, and decoding through an id-to-piece join."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import held, settle, store, tidy, words


def load(path: str) -> str:
    """The tokenizer file's text, read on the driver; executors get it by broadcast and need no copy of the file."""
    return Path(path).read_text(encoding="utf-8")


def _tokenizer(text: str) -> Tokenizer:
    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(text: str) -> list[str | None]:
    """Piece by id; None where an id is not in use."""
    t = _tokenizer(text)
    vocab = t.get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


class Words(dict):
    """word -> ids as 32-bit integers: the shared table, and beside it the words of this task, each encoded when first
    seen. Once the task holds ``most`` of its own, it forgets those."""

    def __init__(self, tokenizer: str, table: dict[bytes, bytes], most: int):
        super().__init__()
        self.tokenizer, self.table, self.most = _tokenizer(tokenizer), table, most

    def __missing__(self, word: bytes) -> bytes:
        ids = self.table.get(word)
        if ids is None:
            if len(self) >= self.most:
                self.clear()
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.int32).tobytes()
        self[word] = ids
        return ids


def word_counts(docs: DataFrame, most: int = 150_000) -> DataFrame:
    """(word, n) over the whole texts: words lie between spaces and ASCII controls; counted before the shuffle.

    A task hands its counts on whenever it holds ``most`` distinct words, so its memory is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(text.as_buffer().to_pybytes().split())
                    if len(seen) >= most:
                        yield out()
                        seen.clear()
        yield out()

    return docs.select("text").mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words at or above the lowest count that at most ``most`` words reach; no sort of all words."""
    steps = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(most).collect()
    total, least = 0, None
    for r in steps:
        total += r.words
        if total > most:
            break
        least = r.n
    return counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= least)


def word_table(docs: DataFrame, tokenizer: str, most: int = 131_072, longest: int = 64) -> dict[bytes, bytes]:
    """word -> ids of the ``most`` most frequent words of up to ``longest`` bytes, each encoded once, in Spark.

    The bounds on words and bytes bound what is brought to the driver and broadcast, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    since = held()
    counts = store(word_counts(docs).where((F.octet_length("word") <= longest) & (F.col("n") > 1)), "bpe_counts")
    rows = settle(_encode_words(frequent(counts, most).select("word"), shared), "bpe_table", since)
    return {bytes(r.word): np.array(r.ids, np.int32).tobytes() for r in rows.collect()}


def _encode_words(rows: DataFrame, tokenizer) -> DataFrame:
    """(word, ids) of distinct words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [e.ids for e in t.encode_batch([w.decode() for w in words], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return rows.mapInArrow(tidy(encode), "word binary, ids array<int>")


def encode(docs: DataFrame, path: str, most: int = 131_072, local: int = 150_000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ids: the whole text of every row as the tokenizer at ``path`` encodes it, without special tokens.

    Words lie between spaces and ASCII controls, which these tokenizers drop, so the ids of a text are those of its
    words in order of position. The ``most`` most frequent words of the corpus are encoded once and broadcast (a bounded
    table); rarer ones are encoded once a task, which keeps at most ``local`` of them. Null and empty texts give no ids.
    """
    return _encoded(docs, path, most, local, carry, "ids array<int>", lambda batch: [batch])


def _encoded(docs: DataFrame, path: str, most: int, local: int, carry: tuple[str, ...], schema: str, after) -> DataFrame:
    """``encode`` with each batch of ids passed through ``after`` in the same worker."""
    tokenizer = load(path)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((tokenizer, word_table(docs, tokenizer, most)))
    cols = list(carry)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*shared.value, local)
        look = words.__getitem__
        for batch in batches:
            for part in _slices(batch, len(cols)):
                rows = [b"".join(map(look, t.as_buffer().to_pybytes().split())) if t.is_valid else b"" for t in part.column(len(cols))]
                ends = np.cumsum([0, *map(len, rows)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield from after(pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols))), ids], [*cols, "ids"]))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select(*cols, "text").mapInArrow(tidy(ids_of), f"{kinds}, {schema}")


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        gone = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, gone + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _id_slices(batch: pa.RecordBatch, column: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` ids each."""
    counts = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        gone = counts[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(counts, gone + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _table(rows: list[str | None]) -> pa.Array:
    return pa.array(rows, pa.string())


def _joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """The names of the ids of each row, joined by a space; ids without a name are left out."""
    if names.null_count:
        out = [[n for n in pc.take(names, row.values).to_pylist() if n is not None] for row in ids]
        return pa.array([" ".join(x) for x in out], pa.string())
    flat, offsets = ids.values, ids.offsets
    first, last = offsets[0].as_py(), offsets[-1].as_py()
    lists = pa.ListArray.from_arrays(pc.subtract(offsets, first), pc.take(names, flat.slice(first, last - first)))
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` but ``ids``, and decoded: each id joined to its piece, pieces joined by a space.

    The table of pieces is as large as the vocabulary, whatever the corpus. Ids without a piece are left out, as the
    tokenizers library does; null ids decode to an empty text.
    """
    return _from_ids(encoded, path, "decoded string", lambda ids, pieces_, _: [_joined(ids, pieces_)])


def _packed(docs: DataFrame, cols: list[str], buckets: int, most: int) -> DataFrame:
    """Texts in chunks of about ``most`` bytes, or one longer text. A chunk has a row a text (bucket -1): ``cols`` and, as
    codes, the words in order of position; and a row for each bucket that one of its distinct words falls into: those words
    and their codes. Both are compressed.

    A chunk's name and codes follow from its input split and the order of rows in it, so rows that are made again, or
    twice, are the same; a table that isn't read straight from files is written to the shared folder first.
    """
    if not docs.where(F.input_file_name() == "").select(F.lit(1)).isEmpty():
        docs = store(docs.select(*cols, "text"), "bpe_docs")
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        name = lambda of, k: int.from_bytes(hashlib.blake2b(f"{of}:{k}".encode(), digest_size=8).digest(), "little", signed=True)
        now, k, chunk, codes, size = None, 0, 0, {}, 0
        kinds = [pa.string()] * len(cols)

        def rows(bucket: list[int], at: list[int], words: list[bytes | None], ids: list[bytes], carried: list[pa.Array]) -> pa.RecordBatch:
            own = [pa.array([chunk] * len(at), pa.int64()), pa.array(bucket, pa.int32()), pa.array(at, pa.int64()), pa.array(words, pa.binary()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays([*own, *carried], ["__chunk", "__bucket", "__at", "__words", "__codes", *cols])

        def table() -> pa.RecordBatch:
            words = list(codes)
            of = np.array([zlib.crc32(w) % buckets for w in words])
            order = np.argsort(of, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
            joined = [press(b"\n".join([words[i] for i in part])) for part in parts]
            return rows([int(of[x[0]]) for x in parts], [0] * len(parts), joined, [press(x.astype("<u4").tobytes()) for x in parts], [pa.nulls(len(parts), k) for k in kinds])

        at = 0
        for batch in batches:
            kinds = batch.schema.types[1 : len(cols) + 1]
            splits = batch.column(0).to_numpy()
            runs = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), batch.num_rows]
            for part in (x for i, j in zip(runs, runs[1:], strict=False) if j > i for x in _slices(batch.slice(i, j - i), len(cols) + 1)):
                of = part.column(0)[0].as_py()
                if of != now or size >= most:
                    if codes:
                        yield table()
                    now, k = of, k + 1 if of == now else 0
                    chunk, codes, size = name(now, k), {}, 0
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(len(cols) + 1)]
                ids = [press(np.array([codes.setdefault(w, len(codes)) for w in t.split()], "<u4").view("u1").reshape(-1, 4).T.tobytes()) for t in texts]
                yield rows([-1] * len(texts), list(range(at, at + len(texts))), [None] * len(texts), ids, [part.column(i + 1) for i in range(len(cols))])
                at, size = at + len(texts), size + sum(map(len, texts))
        if codes:
            yield table()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select(split.alias("__split"), *cols, "text").mapInArrow(tidy(pack), f"__chunk long, __bucket int, __at long, __words binary, __codes binary, {kept}")


def _bucket_ids(words: DataFrame, shared) -> DataFrame:
    """The packed words of the chunks, dealt by bucket: each distinct word is encoded once in the corpus, and every chunk
    gets the ids of its own. A task holds the words of one bucket."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, press, open_ = _tokenizer(shared.value), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        now, seen = None, {}
        for batch in batches:
            for chunk, bucket, packed, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, seen = bucket, {}
                words = open_(packed).split(b"\n")
                new = [w for w in words if w not in seen]
                for w, e in zip(new, t.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                    seen[w] = np.array(e.ids, "<i4").tobytes()
                ids = [seen[w] for w in words]
                lengths = (np.array([len(x) for x in ids]) // 4).astype("<u4").tobytes()
                columns = [pa.array([chunk]), pa.array([codes], pa.binary()), pa.array([press(lengths)], pa.binary()), pa.array([press(b"".join(ids))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["__chunk", "__codes", "__lengths", "__ids"])

    dealt = words.select("__chunk", "__bucket", "__words", "__codes").repartition("__bucket").sortWithinPartitions("__bucket")
    return dealt.mapInArrow(tidy(encode), "__chunk long, __codes binary, __lengths binary, __ids binary")


def _met(docs: DataFrame, path: str, cols: list[str], schema: str, after, buckets: int | None = None, most: int = 16 << 20) -> DataFrame:
    """``after`` over batches of ``cols`` and ids of every text: the words' ids come back to the positions of their chunk.

    Words of a chunk meet the table of distinct words by bucket, and their ids meet the chunk's texts by chunk: two
    equi-joins, whose groups are bounded by the chunk's size and by the words of a bucket. Only distinct words of a chunk
    and packed positions are moved, so less than the texts; texts are read twice and written never.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    since = held()
    packed = _packed(docs, cols, buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions")), most)
    ids = _bucket_ids(packed.where("__bucket >= 0"), shared).withColumn("__bucket", F.lit(0)).withColumn("__at", F.lit(0).cast("long"))
    texts = packed.where("__bucket < 0").withColumn("__bucket", F.lit(1)).drop("__words")
    both = texts.unionByName(ids, allowMissingColumns=True).select("__chunk", "__bucket", "__at", "__codes", "__lengths", "__ids", *cols)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        now, parts, table = None, [], None
        for batch in batches:
            chunks, kinds, codes, lengths, ids = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            i = 0
            while i < batch.num_rows:
                if chunks[i] != now:
                    now, parts, table = chunks[i], [], None
                if kinds[i] == 0:
                    parts.append((np.frombuffer(open_(codes[i]), "<u4"), np.frombuffer(open_(lengths[i]), "<u4"), np.frombuffer(open_(ids[i]), "<i4")))
                    i += 1
                    continue
                if table is None:
                    table = _by_code(parts)
                    parts = []
                rows, n, begin = [], 0, i
                while i < batch.num_rows and chunks[i] == now and kinds[i] == 1 and n < 200_000:
                    rows.append(np.ascontiguousarray(np.frombuffer(open_(codes[i]), "u1").reshape(4, -1).T).view("<u4").ravel())
                    n, i = n + len(rows[-1]), i + 1
                yield from after(pa.RecordBatch.from_arrays([*(batch.column(6 + k).slice(begin, i - begin) for k in range(len(cols))), _gathered(rows, *table)], [*cols, "ids"]))

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return settle(both.repartition("__chunk").sortWithinPartitions("__chunk", "__bucket", "__at").mapInArrow(tidy(meet), f"{kept}, {schema}"), "bpe_met", since)


def _by_code(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, begin) of the ids of each code, and all ids of a chunk's words."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    codes, lengths, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    length, begin = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    length[codes] = lengths
    begin[codes] = np.cumsum(lengths, dtype=np.int64) - lengths
    return length, begin, ids


def _gathered(rows: list[np.ndarray], length: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """The ids of each row of codes, in order of position."""
    codes = np.concatenate(rows).astype(np.int64)
    n = length[codes]
    ends = np.cumsum(n)
    flat = ids[np.repeat(begin[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    of_row = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]
    return pa.ListArray.from_arrays(pa.array(of_row.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_joined(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``encode`` through the table of distinct words: see ``_met``."""
    return _met(docs, path, list(carry), "ids array<int>", lambda batch: [batch], **options)


def digests(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded through the table of distinct words, its ids
    joined back by position, then decoded by joining ids to pieces.

    Null and empty texts have no ids and decode to an empty text; repeated rows have equal results; an empty table
    gives no row. ``options`` are those of ``_met``: the number of buckets and the bytes of a chunk.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces(load(path)))
    tables: list[pa.Array] = []
    sha = lambda texts: pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())

    def digest(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.extend([_table(shared.value), pa.array(map(str, range(len(shared.value))), pa.string())])
        for batch in _id_slices(whole, 1):
            ids = batch.column(1)
            columns = [batch.column(0), pc.cast(pc.list_value_length(ids), pa.int64()), sha(_joined(ids, tables[1])), sha(_joined(ids, tables[0]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _met(docs, path, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, **options)


def encode_by_join(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` by joins of Spark alone: (row, position, word) of every place meets the table of distinct words, each
    encoded once in the corpus, and ids come back by position. Same ids; see the README for what it moves.

    Frequent words are a skewed side of the join, which AQE splits; a text's ids are collected in one row, as in a text.
    """
    rows = store(docs.select(F.monotonically_increasing_id().alias("__row"), *carry, "text"), "bpe_rows")
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    table = store(_encode_words(word_counts(docs).select("word"), shared), "bpe_distinct")
    places = rows.select("__row", F.posexplode(words(F.col("text"))).alias("at", "w")).select("__row", "at", F.col("w").cast("binary").alias("word"))
    met = places.join(table, "word").groupBy("__row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    none = F.array().cast("array<int>")
    return rows.join(met, "__row", "left").select(*carry, F.coalesce("ids", none).alias("ids"))


def decode_by_join(encoded: DataFrame, path: str) -> DataFrame:
    """``decode`` by a join of ids to the table of pieces, which is as large as the vocabulary and is broadcast."""
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, p) for i, p in enumerate(pieces(load(path))) if p is not None], "id int, piece string")
    cols = [c for c in encoded.columns if c != "ids"]
    rows = store(encoded.withColumn("__row", F.monotonically_increasing_id()), "bpe_ids")
    met = rows.select("__row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id").groupBy("__row")
    met = met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return rows.join(met, "__row", "left").select(*cols, F.coalesce("decoded", F.lit("")).alias("decoded"))


def round_trip(docs: DataFrame, path: str, most: int = 131_072, local: int = 150_000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` with decoded_sha256, the digest of what ``decode`` makes of the ids; the encoding worker decodes them."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces(load(path)))
    tables: list[pa.Array] = []

    def digest(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(_table(shared.value))
        for batch in _id_slices(whole, len(carry)):
            texts = _joined(batch.column(len(carry)), tables[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())], [*carry, "ids", "decoded_sha256"])

    return _encoded(docs, path, most, local, carry, "ids array<int>, decoded_sha256 string", digest)


def _from_ids(encoded: DataFrame, path: str, schema: str, make) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(load(path)))
    cols = [c for c in encoded.columns if c != "ids"]
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        numbers = pa.array(map(str, range(len(table))), pa.string())
        for batch in (part for b in batches for part in _id_slices(b, len(cols))):
            ids = batch.column(len(cols))
            ids = pa.ListArray.from_arrays(ids.offsets, ids.values) if not ids.null_count else pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), *make(ids, table, numbers)], [*cols, *names])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in cols)
    return encoded.select(*cols, "ids").mapInArrow(tidy(work), f"{kinds + ', ' if kinds else ''}{schema}")


