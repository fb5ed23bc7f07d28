"""Patches: line pairs, kinds, application, limits, summaries of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_diff(pairs: DataFrame) -> DataFrame:
    """pairs (id, old, new) -> (id, line, op, text): lines compared by position; - before + on a line that differs."""
    a = pairs.select("id", F.posexplode(F.split("old", "\n", -1)).alias("line", "old"))
    b = pairs.select("id", F.posexplode(F.split("new", "\n", -1)).alias("line", "new"))
    both = a.join(b, ["id", "line"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    ops = F.array(F.struct(F.lit("-").alias("op"), F.col("old").alias("text")), F.struct(F.lit("+").alias("op"), F.col("new").alias("text")))
    return both.select("id", F.col("line").alias("line"), F.explode(ops).alias("x")).where("x.text is not null").select("id", (F.col("line") + 1).alias("line"), "x.op", "x.text")


def change_type(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "deleted").otherwise("modified")


def apply(current: Column, old: Column, new: Column) -> Column:
    """(status, result): exact where the file is the original, replaced at the first place that holds it, else conflict."""
    at = F.instr(current, old)
    made = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("result"))
    first = F.concat(F.substring(current, F.lit(1), at - 1), new, F.substring(current, at + F.length(old), F.length(current)))
    return (
        F.when(old.isNull(), made("created", new)).when(new.isNull(), made("deleted", F.lit(None).cast("string"))).when(current == old, made("exact", new))
        .when(at > 0, made("replaced", first)).otherwise(made("conflict", current))
    )


def summary(patches: DataFrame) -> DataFrame:
    k = change_type(F.col("old"), F.col("new"))
    return patches.agg(*[F.count_if(k == t).alias(t) for t in ("added", "modified", "deleted")])


def limits(changes: DataFrame, files: int = 20, lines: int = 500) -> DataFrame:
    """changes (branch, path, lines) -> (branch, violation): too many files, too many changed lines, a protected branch."""
    g = changes.groupBy("branch").agg(F.count_distinct("path").alias("f"), F.sum("lines").alias("l"))
    v = F.array(F.when(F.col("f") > files, F.lit("too many files")), F.when(F.col("l") > lines, F.lit("diff too large")), F.when(F.col("branch").isin("main", "master", "production", "release"), F.lit("protected branch")))
    return g.select("branch", F.explode(v).alias("violation")).where("violation is not null")


def structural_summary(files: DataFrame, threshold: int = 30) -> DataFrame:
    """files (path, content, total_lines, imports, functions, classes, exports) -> (path, summary, savings_pct).

    A short file stays as it is; of a long one its imports, signatures and exports stay.
    """
    imp = lambda i: F.when(i["is_default"] & (F.size(i["items"]) > 0), F.concat(F.lit("import "), i["items"][0], F.lit(" from '"), i["source"], F.lit("';"))).when(F.size(i["items"]) > 0, F.concat(F.lit("import { "), F.array_join(i["items"], ", "), F.lit(" } from '"), i["source"], F.lit("';"))).otherwise(F.concat(F.lit("import '"), i["source"], F.lit("';")))
    out = lambda x: F.when(x["is_exported"], F.lit("export ")).otherwise("")
    fn = lambda f: F.concat(out(f), F.lit("function "), f["name"], F.lit("("), F.array_join(f["params"], ", "), F.lit(");"))
    cls = lambda c: F.concat(out(c), F.lit("class "), c["name"], F.lit(" {\n}"))
    part = lambda c, f: F.when(F.size(c) > 0, F.concat(F.transform(c, f), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    named = F.when(F.size("exports") > 0, F.array(F.concat(F.lit("export { "), F.array_join("exports", ", "), F.lit(" };")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("// Structural summary of "), "path"), F.lit("")), part(F.col("imports"), imp), part(F.col("functions"), fn), part(F.col("classes"), cls), named)
    s = F.when(F.col("total_lines") <= threshold, F.col("content")).otherwise(F.array_join(lines, "\n"))
    return files.select("path", s.alias("summary")).join(files.select("path", F.length("content").alias("n")), "path").select("path", "summary", F.round((1 - F.length("summary") / F.col("n")) * 100).alias("savings_pct"))
