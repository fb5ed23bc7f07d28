"""Vector similarity: pairs above a cosine, bands, top neighbours, clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.model import CLUSTER_STOP
from corpusloom.operators.components import connected
from corpusloom.shared import store


#: Bytes of vectors that a block may hold, blocks that are enough for a cluster, rows under which none is cut.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS = 32 << 20, 12, 2048


def cosine_pairs(vectors: DataFrame, least: float, within: str | None = None, rows_a_block: int | None = None) -> DataFrame:
    """vectors (id, vector[, group]) -> (a, b, cosine) of all pairs a < b at or above ``least``; exact, at any size.

    Vectors are dealt by hash of id into blocks; every pair of blocks is a cell, which one task multiplies as matrices, in
    strips, so a task holds two blocks and a strip of products whatever the table. Products in single precision say which
    pairs may reach ``least``, by a bound of their error; those are multiplied in double precision. There are no more blocks than keep a cluster busy until a block would outgrow ``BLOCK_BYTES``, so what is moved grows as the
    table does. With ``within``, only pairs of one group are compared, and the group is part of the cell, as is the
    length of the vectors. Null ids and vectors pair with nothing, nor do equal ids.
    """
    return _multiplied(vectors, least, within, rows_a_block, _pairs, "a {id}, b {id}, cosine double")


def nearest(vectors: DataFrame, least: float, k: int = 5, within: str | None = None, rows_a_block: int | None = None) -> DataFrame:
    """``top_neighbours`` of ``cosine_pairs``, of which a cell gives only what may be among them: the ``k`` best of each
    vector in that cell, so what is moved grows with the vectors, not with their pairs."""
    best = _multiplied(vectors, least, within, rows_a_block, lambda ids, chunks: _best(ids, chunks, k), "n {id}, o {id}, cosine double")
    return _top(best, k)


def linked(vectors: DataFrame, least: float, within: str | None = None, rows_a_block: int | None = None) -> DataFrame:
    """(a, b) that join what ``cosine_pairs`` join, and nothing else: of each cell every vector with the first of those that
    the cell's pairs connect it with, so there are fewer rows than vectors in a cell however many pairs."""
    return _multiplied(vectors, least, within, rows_a_block, _forest, "a {id}, b {id}")


def _multiplied(vectors: DataFrame, least: float, within: str | None, rows_a_block: int | None, reduce: Callable, schema: str) -> DataFrame:
    """The cells of ``cosine_pairs``, each reduced to rows of ``schema``."""
    spark = vectors.sparkSession
    group = F.col(within).cast("string") if within else F.lit(None).cast("string")
    plain = F.col("vector") if vectors.schema["vector"].dataType.elementType.typeName() in ("float", "double") else F.col("vector").cast("array<double>")
    v = vectors.where("id is not null and vector is not null").select("id", F.concat_ws(":", F.size("vector"), group).alias("g"), plain.alias("v"))
    v = v.where(~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0))
    rows, width = vectors.where("id is not null").agg(F.count("vector"), F.max(F.size("vector"))).first()
    most = rows_a_block or max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
    blocks = max(1, math.ceil(rows / most), 0 if rows_a_block else min(BLOCKS, math.ceil(rows / BLOCK_ROWS)))
    v = v.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # block i meets block j <= i; a vector goes to the cells of its row and of its column
    cell = lambda o: F.struct(F.greatest("k", o).alias("i"), F.least("k", o).alias("j"))
    dealt = v.select("g", "k", "id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), cell)).alias("c")).select("g", "c.i", "c.j", "k", "id", "v")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 10_000))
    dealt = dealt.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j", "k")
    kind = vectors.schema["id"].dataType
    return dealt.mapInArrow(_cells(least, to_arrow_type(kind), reduce), schema.format(id=kind.simpleString()))


def _pairs(ids: np.ndarray, chunks: Callable) -> Iterator[tuple]:
    """Every pair of a cell, the lesser id first."""
    for a, b, cos in chunks():
        yield ids[np.minimum(a, b)], ids[np.maximum(a, b)], cos


def _best(ids: np.ndarray, chunks: Callable, k: int, most: int = 1 << 18) -> Iterator[tuple]:
    """Of each id its ``k`` best pairs, ties to the lesser neighbour, as (id, neighbour, cosine)."""
    kept, waiting, bar = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], np.full(len(ids), -np.inf)

    def settled() -> tuple:
        n, o, cos = (np.concatenate(c) for c in zip(kept, *waiting, strict=True))
        order = np.lexsort((o, -cos, n))
        n, o, cos = n[order], o[order], cos[order]
        at = np.arange(len(n)) - np.searchsorted(n, n)
        bar[n[at == k - 1]] = cos[at == k - 1]
        return n[at < k], o[at < k], cos[at < k]

    for a, b, cos in chunks(lambda a, b, most: most >= np.minimum(bar[a], bar[b])):
        for n, o in ((a, b), (b, a)):
            may = cos >= bar[n]
            waiting.append((n[may], o[may], cos[may]))
        if sum(len(w[0]) for w in waiting) > max(most, 2 * len(kept[0])):
            kept, waiting = settled(), []
    n, o, cos = settled()
    yield ids[n], ids[o], cos


def _forest(ids: np.ndarray, chunks: Callable) -> Iterator[tuple]:
    """Of each id that a pair holds, but the least of those connected, the least of them."""
    root = np.arange(len(ids))
    for a, b, _ in chunks():
        while (apart := root[a] != root[b]).any():
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while ((up := root[root]) != root).any():
                root = up
    hung = np.flatnonzero(root != np.arange(len(ids)))
    yield ids[root[hung]], ids[hung]


def _cells(least: float, kind: pa.DataType, reduce: Callable, strip: int = 128, width: int = 2048, held: int = 1 << 16):
    """Rows (g, i, j, k, id, v) sorted by cell -> what ``reduce`` makes of the pairs of each cell at or above ``least``: it
    takes the sorted ids of the cell, and a call for chunks of places in them and cosines, of the pairs that it may want by
    the most that their cosine can be."""

    def chunks(at: np.ndarray, v: np.ndarray, right: int, wanted: Callable | None = None) -> Iterator[tuple]:
        """The first ``right`` rows against the rest, or against each other where there is no rest."""
        one, rough, off = right == len(v), v.astype(np.float32), (v.shape[1] + 8) * 1.2e-7
        bound, found, n = np.float32(least - off), [], 0
        for s in range(0, right, strip):
            rows = rough[s : min(s + strip, right)]
            for c in range(s if one else right, len(v), width):
                flat = np.flatnonzero((product := rows @ rough[c : c + width].T) >= bound)
                x, y = flat // product.shape[1] + s, flat % product.shape[1] + c
                fine = (at[x] != at[y]) & (y > x)
                if wanted:
                    fine &= wanted(at[x], at[y], product.ravel()[flat] + off)
                x, y = x[fine], y[fine]
                cos = np.einsum("ij,ij->i", v[x], v[y])
                fine = cos >= least
                found.append((at[x[fine]], at[y[fine]], cos[fine]))
                if (n := n + len(found[-1][0])) > held:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))

    def out(ids: list[pa.Array], vs: list[np.ndarray], ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = np.concatenate(ks)
        named, at = np.unique(np.concatenate(ids), return_inverse=True)
        v = np.concatenate(vs).astype(float)
        with np.errstate(all="ignore"):
            length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            v = np.where(length == 0, v, v / length)
        for columns in reduce(named, functools.partial(chunks, at, v, int((k == k[0]).sum()))):
            for s in range(0, len(columns[0]), 1 << 16):
                arrays = [pa.array(c[s : s + (1 << 16)], None if c.dtype == float and n == 2 else kind) for n, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, [str(n) for n in range(len(arrays))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs, ks = None, [], [], []
        for batch in batches:
            g, i, j = (batch.column(n).to_pylist() for n in range(3))
            cells = list(zip(g, i, j, strict=True))
            starts = [n for n in range(len(cells)) if n == 0 or cells[n] != cells[n - 1]] + [len(cells)]
            for s, e in zip(starts, starts[1:]):
                if cells[s] != now:
                    if own_cell(now, ks):
                        yield from out(ids, vs, ks)
                    now, ids, vs, ks = cells[s], [], [], []
                part = batch.slice(s, e - s)
                flat = part.column(5).flatten().to_numpy(zero_copy_only=False)
                ids.append(part.column(4).to_numpy(zero_copy_only=False))
                vs.append(flat.reshape(e - s, -1))
                ks.append(part.column(3).to_numpy(zero_copy_only=False))
        if own_cell(now, ks):
            yield from out(ids, vs, ks)

    def own_cell(now: tuple | None, ks: list[np.ndarray]) -> bool:
        """A cell off the diagonal needs both its blocks."""
        return now is not None and (now[1] == now[2] or ks[0][0] != ks[-1][-1])

    return work


def band(cos: Column, similar: float = 0.85, related: float = 0.70) -> Column:
    return F.when(cos >= similar, "similar_to").when(cos >= related, "related")


def top_neighbours(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The pairs that are among the ``k`` best of either end; ties go to the lesser neighbour."""
    return _top(pairs.select(F.col("a").alias("n"), F.col("b").alias("o"), "cosine").union(pairs.select("b", "a", "cosine")), k)


def _top(both: DataFrame, k: int) -> DataFrame:
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("cosine").desc(), "o"))).where(F.col("r") <= k)
    return best.select(F.least("n", "o").alias("a"), F.greatest("n", "o").alias("b"), "cosine").distinct()


def clusters(pairs: DataFrame, least: float = 0.80, smallest: int = 2) -> DataFrame:
    """(cluster, member): components of the pairs at or above ``least``; named by a hash of their sorted members."""
    return grouped(pairs.where(F.col("cosine") >= least), smallest)


def grouped(links: DataFrame, smallest: int = 2) -> DataFrame:
    """``clusters`` of links (a, b). The members of a component come together once, for its name, in a row of their ids;
    the name goes back to each by a join."""
    found = store(connected(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))), "clusters")
    name = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "|"), 256), 1, 8)
    named = found.groupBy("root").agg(name.alias("cluster"), F.count("*").alias("n")).where(F.col("n") >= smallest)
    return found.join(named, "root").select("cluster", F.col("node").alias("member"))


def cluster_names(members: DataFrame) -> DataFrame:
    """members (cluster, text) -> (cluster, name): the token that most texts share (two at least); longer, then earlier
    in the alphabet where they tie; else the beginning of the cluster's id."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9]{2,}"), 0), lambda w: ~w.isin(*CLUSTER_STOP)))
    df = members.select("cluster", F.explode(words).alias("w")).groupBy("cluster", "w").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    best = df.groupBy("cluster").agg(F.min_by("w", F.struct(-F.col("n"), -F.length("w"), "w")).alias("name"))
    every = members.select("cluster").distinct().join(best, "cluster", "left")
    return every.select("cluster", F.coalesce("name", F.concat(F.lit("cluster-"), F.substring("cluster", 1, 6))).alias("name"))


def common_tokens(names: DataFrame) -> DataFrame:
    """names (cluster, position, name) -> (cluster, token): the word over two letters that stands most often in a
    cluster's names, each place counted and two at least; the first to appear where they tie, null where there is none."""
    words = names.select("cluster", "position", F.posexplode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("at", "w")).where(F.length("w") > 2)
    counted = words.groupBy("cluster", "w").agg(F.count("*").alias("n"), F.min(F.struct("position", "at")).alias("first")).where("n > 1")
    best = counted.groupBy("cluster").agg(F.min_by("w", F.struct(-F.col("n"), "first")).alias("token"))
    return names.select("cluster").distinct().join(best, "cluster", "left")
