"""Fingerprints of files, and the texts that stand for their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions.text import leading_comment
from corpusloom.operators.extract import lines, signatures

#: Words before a parenthesis that aren't calls.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "new", "await", "typeof")
#: Line forms of other languages: (kind, form, group of the name, group of the detail).
FORMS = {
    ".go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)", 1, 2), ("class", r"^type\s+(\w+)\s+(struct|interface)\b", 1, 2), ("import", r"""^(?:import\s+|\s+)(?:\w+\s+)?"([^"]+)"()""", 1, 2)),
    ".java": (("function", r"^\s+(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\], ]+\s+(\w+)\s*\(([^)]*)\)", 1, 2), ("class", r"\bclass\s+(\w+)(?:\s+extends\s+(\w+))?", 1, 2), ("import", r"^import\s+(?:static\s+)?([\w.*]+)\s*;()", 1, 2)),
}


def callees(text: Column) -> Column:
    """Distinct trailing identifiers that are called, in order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1), lambda w: ~w.isin(*KEYWORDS)))


def other_signatures(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, detail) of Go and Java files by line forms."""
    t, ext = F.col("text"), P.extension(F.col("path"))
    rows = [F.when((ext == e) & t.rlike(form), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, form, n).alias("name"), F.regexp_extract(t, form, d).alias("detail"))) for e, forms in FORMS.items() for kind, form, n, d in forms]
    return lines(files.where(ext.isin(*FORMS))).select("path", "line", F.explode(F.array(*rows)).alias("x")).where("x is not null").select("path", "line", "x.*")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, content_hash, total_lines, functions, classes, imports, exports, has_structure): names in order of lines.

    Signatures of a file are gathered by one aggregate of its own lines; a file without any keeps its hash and is marked
    as without structure.
    """
    named = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", "name", "detail", "exported")))), lambda x: F.concat(x["name"], F.lit("("), x["detail"], F.lit(")")))
    s = signatures(files).groupBy("path").agg(*[named(k).alias(c) for k, c in (("function", "functions"), ("class", "classes"), ("import", "imports"), ("export", "exports"))])
    f = files.select("path", F.sha2("content", 256).alias("content_hash"), F.size(F.split("content", "\n", -1)).alias("total_lines"))
    none = F.array().cast("array<string>")
    out = f.join(s, "path", "left")
    return out.select("path", "content_hash", "total_lines", *[F.coalesce(c, none).alias(c) for c in ("functions", "classes", "imports", "exports")], F.col("functions").isNotNull().alias("has_structure"))


def function_text(name: Column, params: Column, returns: Column, calls: Column) -> Column:
    """What is embedded for a function: its signature and what it calls."""
    ret = F.coalesce(F.concat(F.lit(" -> "), returns), F.lit(""))
    called = F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, F.concat(F.lit(" calls "), F.array_join(calls, " "))).otherwise("")
    return F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"), ret, called)


def class_text(name: Column, parent: Column, interfaces: Column, methods: Column, properties: Column) -> Column:
    part = lambda label, xs: F.when(F.coalesce(F.size(xs), F.lit(0)) > 0, F.concat(F.lit(label + " "), F.array_join(xs, " ")))
    return F.concat_ws(" ", name, F.concat(F.lit("extends "), parent), part("implements", interfaces), part("methods", methods), part("props", properties))


def file_text(path: Column, exports: Column, content: Column) -> Column:
    return F.trim(F.concat_ws(" ", P.basename(path), F.array_join(exports, " "), leading_comment(content)))


def signature(name: Column, params: Column, returns: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"), F.coalesce(F.concat(F.lit(": "), returns), F.lit("")))


def infer_patch(code: Column, description: Column) -> Column:
    """Code with the edits that a description asks for: optional calls, structured logging, unknown for any."""
    low = F.lower(description)
    has = lambda *ws: low.rlike("|".join(ws))
    safe = F.when(has("null", "undefined"), F.regexp_replace(code, r"\b(?!(?:console|process|Math|JSON)\.)(\w+)\.(\w+)\(", "$1?.$2(")).otherwise(code)
    logged = F.when(has("console", "log"), F.regexp_replace(safe, r"console\.(log|error|warn)\(", "logger.info(")).otherwise(safe)
    return F.when(has("any", "type"), F.regexp_replace(F.regexp_replace(logged, r":\s*any\b", ": unknown"), r"\bas any\b", "as unknown")).otherwise(logged)


def render(path: Column, kind: Column, diff: Column) -> Column:
    """A patch as text: what happened to which file, a rule, the diff, a rule."""
    action = F.when(kind == "added", "Added").when(kind == "deleted", "Deleted").otherwise("Modified")
    return F.concat(action, F.lit(": "), path, F.lit("\n" + "─" * 60 + "\n"), diff, F.lit("\n" + "─" * 60))
