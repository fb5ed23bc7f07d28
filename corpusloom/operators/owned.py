"""The edges that a file owns, said of one row: its facts, what its imports name, and which of the names asked for are there.

Files meet in three equi-joins on narrow rows: what imports ask for, the names they ask for there, and both back by path.
Edges are made in the row, each once, so they are neither shuffled nor compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import build, extract
from corpusloom.shared import store

EDGES = "array<struct<source:string,target:string,type:string,weight:double>>"
#: What follows from the structure alone, and all that files own; a tested_by edge belongs to the test.
CORE = ("contains", "imports", "exports", "calls", "inherits")
ALL = (*CORE, "implements", "tested_by", "depends_on", "routes", "events", "middleware", "data_access")


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _or_none(items: Column) -> Column:
    return F.coalesce(items, _none())


def links(some: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, links): the imports of the files ``some`` (path, imports; one row a path), which may name any of ``facts``
    (path), each with source, items, resolved and the last line on which the file names that source."""
    named = some.select("path", F.explode("imports").alias("i")).select("path", "i.source", "i.line")
    met = build.import_keys(named).join(build.file_keys(facts), "key")
    hit = F.struct("source", (F.col("base") * 100 + F.col("rank")).alias("order"), (-F.col("line")).alias("line"), "candidate")
    met = met.select("path", hit.alias("hit")).repartition("path").groupBy("path").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    found = met.select("path", F.filter("hits", lambda x, i: (i == 0) | (F.get("hits", i - 1)["source"] != x["source"])).alias("found"))
    at = lambda i: F.get("found", (F.array_position(F.col("found.source"), i["source"]) - 1).cast("int"))
    item = lambda n: F.regexp_replace(n, r"^\*\s+as\s+", "")
    each = F.transform("imports", lambda i: F.struct(i["source"].alias("source"), F.transform(_or_none(i["items"]), item).alias("items"), at(i).alias("at")))
    each = F.transform(each, lambda x: F.struct(x["source"].alias("source"), x["items"].alias("items"), x["at"]["candidate"].alias("resolved"), (-x["at"]["line"]).alias("line")))
    return some.select("path", "imports").join(found, "path", "left").select("path", F.coalesce(each, F.array()).cast("array<struct<source:string,items:array<string>,resolved:string,line:int>>").alias("links"))


def linked(facts: DataFrame, some: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each of the files ``some`` (path; all where None) of ``facts`` (one row a path): names, calls, parents,
    exports and marks, the links of its imports, and as path:name what functions and classes stand where it imports
    their names from. The links come as a table too."""
    zipped = lambda of, *fields: F.arrays_zip(*[f"{of}.{f}" for f in fields])
    mine = facts.select(
        "path", zipped("imports", "source", "items", "line").alias("imports"), zipped("functions", "name", "calls").alias("fn"), zipped("classes", "name", "super_class", "implements").alias("cl"),
        zipped("exports", "kind", "name").alias("out"), (F.col("marks") if "marks" in facts.columns else F.lit(None)).cast(extract.MARKS).alias("marks"),
    )
    if some is not None:
        mine = store(mine.join(some, "path", "left_semi"), "links_of")
    to = store(links(mine, facts), "links")
    asked = F.flatten(F.transform(F.filter("links", lambda x: x["resolved"].isNotNull()), lambda x: F.transform(x["items"], lambda n: F.concat(x["resolved"], F.lit(":"), n))))
    has = lambda names, kind: F.transform(F.array_distinct(F.col(names)), lambda n: F.struct(F.concat("path", F.lit(":"), n).alias("id"), F.lit(kind).alias("kind")))
    symbols = facts.select("path", F.explode(F.concat(has("functions.name", "function"), has("classes.name", "class"))).alias("s")).select("s.id", "s.kind")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("id")))
    there = to.select("path", F.explode(F.array_distinct(asked)).alias("id")).join(symbols, "id").repartition("path").groupBy("path").agg(of("function").alias("functions_there"), of("class").alias("classes_there"))
    return mine.drop("imports").join(to, "path", "left").join(there, "path", "left"), to


def modules(links: DataFrame) -> DataFrame:
    """(source): what imports name that is no file."""
    return links.select(F.explode(F.filter("links", lambda x: x["resolved"].isNull())).alias("x")).select("x.source").distinct()


def edges(rows: DataFrame, types: Sequence[str] = ALL) -> DataFrame:
    """rows as of ``linked`` -> (path, edges): the EDGES of the named types that each file owns, each once.

    A name means a symbol of the file itself, else of the file from which the import of it that comes last takes it;
    references to itself and to nothing give none. Names hold no blank and no colon.
    """
    # columns of their own, which are used more than once and so made once
    known = F.filter("links", lambda x: x["resolved"].isNotNull())
    taken = F.sort_array(F.flatten(F.transform(known, lambda x: F.transform(x["items"], lambda n: F.struct(x["line"].alias("line"), x["resolved"].alias("origin"), n.alias("name"))))), asc=False)
    rows = rows.withColumn("known", F.coalesce(known, F.array().cast(rows.schema["links"].dataType))).withColumn("taken", taken)
    rows = rows.withColumn("taken_names", _or_none(F.col("taken.name"))).withColumn("taken_ids", F.transform("taken", lambda x: F.concat(x["origin"], F.lit(":"), x["name"])))
    rows = rows.withColumns({c: _or_none(F.col(c)) for c in ("functions_there", "classes_there")}).withColumns({"own_functions": _or_none(F.col("fn.name")), "own_classes": _or_none(F.col("cl.name"))})
    rows = rows.withColumn("pairs", F.array_distinct(F.flatten(F.transform("known", lambda x: F.transform(x["items"], lambda n: F.concat(x["resolved"], F.lit(":"), n))))))

    path, file = F.col("path"), F.concat(F.lit("file:"), "path")
    edge = lambda source, target, kind, weight: F.struct(source.alias("source"), target.alias("target"), kind.alias("type"), F.lit(weight).alias("weight"))
    before, after = (lambda x: F.substring_index(x, " ", 1)), (lambda x: F.substr(x, F.instr(x, " ") + 1))
    of_file = lambda kind, weight, targets: F.transform(F.array_distinct(targets), lambda t: edge(file, t, F.lit(kind), weight))
    of_place = lambda kind, weight, each: F.transform(F.array_distinct(F.transform(F.filter("marks", lambda m: m["kind"] == kind), lambda m: F.concat(m["type"], F.lit(" "), each(m)))), lambda x: edge(file, after(x), before(x), weight))
    symbol = lambda kind, name: F.concat(F.lit(kind + ":"), path, F.lit(":"), name)
    prefixed = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), x))

    def meant(names: Column, kind: str) -> Column:
        """path:name of what names mean."""
        own, there = (F.col("own_functions"), F.col("functions_there")) if kind == "function" else (F.col("own_classes"), F.col("classes_there"))
        here = F.transform(F.array_intersect(names, own), lambda n: F.concat(path, F.lit(":"), n))
        others = F.array_intersect(F.array_except(names, own), F.col("taken_names"))
        return F.concat(here, F.array_intersect(F.transform(others, lambda n: F.get("taken_ids", (F.array_position("taken_names", n) - 1).cast("int"))), there))

    def references(each: str, of: str, kind: str, type_: str, weight: float) -> Column:
        """Edges from symbols to what their names mean; equal ones, of symbols that a file has twice, are one."""
        names = lambda x: F.filter(F.array(x[of]), lambda n: n.isNotNull()) if of == "super_class" else _or_none(x[of])
        found = F.transform(each, lambda x: F.transform(meant(F.array_except(names(x), F.array(x["name"])), kind), lambda i: F.concat(x["name"], F.lit(" "), i)))
        return F.transform(F.array_distinct(F.flatten(found)), lambda x: edge(symbol(kind, before(x)), F.concat(F.lit(kind + ":"), after(x)), F.lit(type_), weight))

    pairs, fn, cl = (F.col(c) for c in ("pairs", "functions_there", "classes_there"))
    no_file = prefixed("module:", F.transform(F.filter("links", lambda x: x["resolved"].isNull()), lambda x: x["source"]))
    unknown = F.transform(F.array_except(F.array_except(pairs, fn), cl), lambda x: F.regexp_replace(x, "(?s):[^:]*$", ""))
    whole = F.transform(F.filter("known", lambda x: F.size(x["items"]) == 0), lambda x: x["resolved"])
    imports = F.concat(no_file, prefixed("function:", F.array_intersect(pairs, fn)), prefixed("class:", F.array_except(F.array_intersect(pairs, cl), fn)), prefixed("file:", F.concat(unknown, whole)))
    resolved = F.transform("known", lambda x: x["resolved"])
    named = F.col("out")
    exports = F.transform(named, lambda x: F.when(x["kind"].isin("function", "class"), F.concat_ws(":", x["kind"], path, x["name"])).otherwise(file))
    tested = F.transform(F.array_distinct(F.filter(resolved, lambda x: ~P.is_test(x))), lambda x: edge(F.concat(F.lit("file:"), x), file, F.lit("tested_by"), 0.6))
    made = {
        "contains": of_file("contains", 1.0, F.concat(F.transform("own_functions", lambda n: symbol("function", n)), F.transform("own_classes", lambda n: symbol("class", n)))),
        "imports": of_file("imports", 0.7, imports),
        "exports": of_file("exports", 0.8, exports),
        "calls": references("fn", "calls", "function", "calls", 0.9),
        "inherits": references("cl", "super_class", "class", "inherits", 0.9),
        "implements": references("cl", "implements", "class", "implements", 0.9),
        "tested_by": F.when(P.is_test(path), tested),
        "depends_on": of_file("depends_on", 0.5, F.concat(no_file, prefixed("file:", F.filter(resolved, lambda x: x != path)))),
        "routes": of_file("routes", 0.8, F.transform(F.filter("marks", lambda m: m["kind"] == "route"), lambda m: F.concat(F.lit("endpoint:"), path, F.lit(":"), m["type"], F.lit(" "), m["name"]))),
        "events": of_place("event", 0.6, lambda m: F.concat(F.lit("concept:event:"), m["name"])),
        "middleware": of_file("middleware", 0.6, prefixed("function:", meant(F.transform(F.filter("marks", lambda m: m["kind"] == "use"), lambda m: m["name"]), "function"))),
        "data_access": of_place("data", 0.5, lambda m: F.concat(F.lit("resource:"), m["name"])),
    }
    every = [F.coalesce(made[t], F.array()).cast(EDGES) for t in types]
    return rows.select("path", F.flatten(F.array(*every)).alias("edges"))


def listed(files: DataFrame) -> DataFrame:
    """source, target, type, weight of the edges of files (edges). As the outer form: of the inner one Spark infers a filter
    on the size of the array, for which the edges are made two times more."""
    return files.select(F.inline_outer("edges")).where("type is not null")
