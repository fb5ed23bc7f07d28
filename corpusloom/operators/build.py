"""References to edges: imports, calls, inheritance, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.model import IMPORT_EXTENSIONS


def file_keys(files: DataFrame) -> DataFrame:
    """files (path) -> (key, rank, candidate): what an import may call a file, and how soon it is tried: its path, then for
    each extension in order the path without it, and the folder if it is the folder's index file."""
    p = F.col("path")
    cut = lambda tail: F.substring(p, F.lit(1), F.length(p) - len(tail))
    named = lambda tail, rank: F.when(p.endswith(tail) & (F.length(p) > len(tail)), F.struct(cut(tail).alias("key"), F.lit(rank).alias("rank")))
    keys = [F.struct(p.alias("key"), F.lit(0).alias("rank"))] + [named(t, r) for i, x in enumerate(IMPORT_EXTENSIONS) for t, r in ((x, 2 * i + 1), ("/index" + x, 2 * i + 2))]
    return files.select(p.alias("candidate"), F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.key", "k.rank", "candidate")


def import_keys(imports: DataFrame) -> DataFrame:
    """imports (path, source, ...) -> the same with (base, key): the target of each relative import, and the target without
    its own extension, which is tried after it."""
    target = P.joined(F.col("path"), F.col("source"))
    keys = imports.where(F.col("source").startswith(".")).withColumn("target", target)
    return keys.select(*imports.columns, F.posexplode(F.array_distinct(F.array("target", P.strip_extension(F.col("target"))))).alias("base", "key"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, source) x files (path) -> imports with resolved: the first candidate that exists; null if none does.

    A relative source names the target, then the target with each extension, or as a folder with an index file; the same
    again without its own extension. Files say what they may be called and imports what they ask for, so both meet in one
    equi-join on that name, and the soonest tried is kept.
    """
    met = import_keys(imports.select("path", "source").distinct()).join(file_keys(files), "key")
    found = met.groupBy("path", "source").agg(F.min_by("candidate", F.col("base") * 100 + F.col("rank")).alias("resolved"))
    return imports.join(found, ["path", "source"], "left")


def _symbol(kind: str, path, name):
    return F.concat(F.lit(kind + ":"), path, F.lit(":"), name)


def import_edges(items: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """items (path, source, item) -> imports edges: to the function, else the class of that name, else the file; to a
    module where the source is no file."""
    i = items.join(resolved.select("path", "source", "resolved").distinct(), ["path", "source"], "left")
    kinds = symbols.groupBy(F.col("path").alias("resolved"), F.col("name").alias("item")).agg(F.max(F.when(F.col("kind") == "function", 1).otherwise(0)).alias("fn"), F.max(F.when(F.col("kind") == "class", 1).otherwise(0)).alias("cl"))
    i = i.join(kinds, ["resolved", "item"], "left")
    target = F.when(F.col("resolved").isNull(), F.concat(F.lit("module:"), "source")).when(F.col("fn") == 1, _symbol("function", F.col("resolved"), F.col("item"))).when(F.col("cl") == 1, _symbol("class", F.col("resolved"), F.col("item"))).otherwise(F.concat(F.lit("file:"), "resolved"))
    return i.select(F.concat(F.lit("file:"), "path").alias("source"), target.alias("target"), F.lit("imports").alias("type"), F.lit(0.7).alias("weight")).distinct()


def imported_symbols(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, item, origin): the file each imported name comes from; the last import of a name wins."""
    i = items.where("item is not null").join(resolved.where("resolved is not null").select("path", "source", "line", "resolved"), ["path", "source"])
    return i.groupBy("path", "item").agg(F.max_by("resolved", F.struct("line", "resolved")).alias("origin"))


def resolve_names(refs: DataFrame, kind: str, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """refs (path, to, ...) with ``at``: the file that holds the symbol of ``kind`` a name means; null where none does.

    The scope of a file is its own symbols, then what it imports. Both are looked up by (path, name), so a name that
    stands in many files means none but these.
    """
    own = symbols.where(F.col("kind") == kind).select("path", F.col("name").alias("to"), F.lit(True).alias("here")).distinct()
    there = own.select(F.col("path").alias("origin"), "to", F.col("here").alias("there"))
    r = refs.join(own, ["path", "to"], "left").join(imported.select("path", F.col("item").alias("to"), "origin"), ["path", "to"], "left").join(there, ["origin", "to"], "left")
    return r.withColumn("at", F.when(F.col("here"), F.col("path")).when(F.col("there"), F.col("origin"))).drop("here", "there", "origin")


def reference_edges(refs: DataFrame, kind: str, symbols: DataFrame, imported: DataFrame, edge: str, weight: float) -> DataFrame:
    """refs (path, from, to) -> edges between symbols of ``kind``: the name in the same file first, else where it is
    imported from; references to itself and to nothing are dropped."""
    r = resolve_names(refs.where(F.col("from") != F.col("to")), kind, symbols, imported).where("at is not null")
    return r.select(_symbol(kind, F.col("path"), F.col("from")).alias("source"), _symbol(kind, F.col("at"), F.col("to")).alias("target"), F.lit(edge).alias("type"), F.lit(weight).alias("weight")).distinct()


def export_edges(exports: DataFrame) -> DataFrame:
    """exports (path, name, kind) -> exports edges; of a variable or default the file's own."""
    target = F.when(F.col("kind").isin("function", "class"), F.concat_ws(":", "kind", "path", "name")).otherwise(F.concat(F.lit("file:"), "path"))
    return exports.select(F.concat(F.lit("file:"), "path").alias("source"), target.alias("target"), F.lit("exports").alias("type"), F.lit(0.8).alias("weight")).distinct()


def contains_edges(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "class")).select(F.concat(F.lit("file:"), "path").alias("source"), F.concat_ws(":", "kind", "path", "name").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight")).distinct()


def tested_by(resolved: DataFrame) -> DataFrame:
    """Edges from a source to the tests that import it; a test that imports a test gives none."""
    hit = resolved.where(F.col("resolved").isNotNull() & P.is_test(F.col("path")) & ~P.is_test(F.col("resolved")))
    return hit.select(F.concat(F.lit("file:"), "resolved").alias("source"), F.concat(F.lit("file:"), "path").alias("target"), F.lit("tested_by").alias("type"), F.lit(0.6).alias("weight")).distinct()


def depends_on(resolved: DataFrame) -> DataFrame:
    """Edges from a file to the other files it imports, and to the modules that are no file."""
    hit = resolved.where(F.col("resolved").isNull() | (F.col("resolved") != F.col("path")))
    target = F.when(F.col("resolved").isNull(), F.concat(F.lit("module:"), "source")).otherwise(F.concat(F.lit("file:"), "resolved"))
    return hit.select(F.concat(F.lit("file:"), "path").alias("source"), target.alias("target"), F.lit("depends_on").alias("type"), F.lit(0.5).alias("weight")).distinct()


def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that aren't exported, aren't in a test and that no calls edge reaches."""
    fn = symbols.where((F.col("kind") == "function") & ~F.col("exported") & ~F.col("path").contains(".test.")).select(F.concat_ws(":", F.lit("function"), "path", "name").alias("id"))
    return fn.join(calls.where(F.col("type") == "calls").select(F.col("target").alias("id")), "id", "left_anti").distinct()
