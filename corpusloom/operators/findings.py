"""Findings: rule scan, write-back to the graph, patterns, conventions, solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.operators.extract import lines

#: Receivers that need no null check.
EXEMPT = ("console", "process", "Math", "JSON")


def rule_scan(files: DataFrame) -> DataFrame:
    """(path, type, description, confidence, line) of six rules over files (path, content); line null for whole-file rules.

    Rules on lines share one explode of the lines. A dereference counts as checked by a check of its variable on its own
    or an earlier line: the first checking line of each (file, variable) comes from one aggregate, not from a scan of
    earlier lines for each place. Both joins are by sort and merge: a side is exploded from texts, so the planner's size of
    it, that of the table below, says nothing, and a broadcast by it would bring the words of all files to the driver.
    """
    # fixed values: the descriptions and confidences of the six rules, and the words that a comment is outstanding by
    row = lambda kind, text, confidence, line: [F.lit(kind).alias("type"), text.alias("description"), F.lit(confidence).alias("confidence"), line.alias("line")]
    each = lines(files)
    none = F.lit(None).cast("int")

    calls = F.arrays_zip(F.regexp_extract_all("text", F.lit(r"(\w+)\.(\w+)\("), 1).alias("v"), F.regexp_extract_all("text", F.lit(r"(\w+)\.(\w+)\("), 2).alias("m"))
    deref = each.select("path", "line", F.explode(calls).alias("c")).select("path", "line", F.col("c.v").alias("v"), F.col("c.m").alias("m")).where(~F.col("v").isin(*EXEMPT))
    forms = [(r"(\w+) === (?:null|undefined)", 1), (r"(\w+)\?\.", 1), (r"if \((\w+)\)", 1)]
    checks = F.concat(*[F.regexp_extract_all("text", F.lit(f), g) for f, g in forms])
    checked = each.select("path", F.col("line").alias("at"), F.explode(checks).alias("v")).groupBy("path", "v").agg(F.min("at").alias("at"))
    open_ = deref.join(checked.hint("merge"), ["path", "v"], "left").where("at is null or at > line")
    out = open_.select("path", *row("bug", F.concat(F.lit("Potential null/undefined dereference: "), "v", F.lit(" may be null before accessing "), "m", F.lit("()")), 0.6, F.col("line")))

    declared = each.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?:const|let|var)\s+(\w+)\s*="), 1)).alias("v"))
    used = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\b\w+\b"), 0)).alias("v")).groupBy("path", "v").agg(F.count("*").alias("uses")).where("uses <= 1")
    unused = declared.join(used.hint("merge"), ["path", "v"], "left_semi")
    out = out.union(unused.select("path", *row("style", F.concat(F.lit("Unused variable: "), "v"), 0.8, F.col("line"))))

    todo = each.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)//\s*(TODO|FIXME|HACK|XXX)"), 1)).alias("w"))
    out = out.union(todo.select("path", *row("bug", F.concat(F.lit("Outstanding "), "w", F.lit(" comment indicates incomplete implementation")), 0.7, F.col("line"))))

    c = F.col("content")
    for kind, text, confidence, hit in (
        ("style", "Console logging detected — should use structured logger", 0.5, c.contains("console.log(") | c.contains("console.error(")),
        ("style", 'Unsafe "any" type usage detected', 0.6, c.contains(": any") | c.contains("as any")),
        ("bug", "Empty catch block swallows errors silently", 0.85, c.rlike(r"catch\s*\([^)]*\)\s*\{\s*(//\s*noop\s*)?\}")),
    ):
        out = out.union(files.where(hit).select("path", *row(kind, F.lit(text), confidence, none)))
    return out


def severity(kind: Column) -> Column:
    return F.when(kind == "fault", "high").when(kind == "insight", "medium").when(kind == "style", "low").otherwise("info")


def faults(findings: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings (id, type, description, confidence, node_ids) -> fault nodes and relates_to_fault edges to existing nodes.

    References are made node ids first, so a bare path finds its file.
    """
    f = findings.where(F.col("type").isin("fault", "style", "insight"))
    made = f.select(F.concat(F.lit("fault:"), "id").alias("id"), F.lit("fault").alias("type"), T.truncate(F.col("description")).alias("name"), severity(F.col("type")).alias("severity"))
    refs = f.select(F.concat(F.lit("fault:"), "id").alias("target"), "confidence", F.explode("node_ids").alias("r")).select("target", "confidence", P.node_id(F.col("r")).alias("source"))
    edges = refs.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", F.lit("relates_to_fault").alias("type"), F.col("confidence").alias("weight"))
    return made, edges.distinct()


def fix_type(path: Column, description: Column) -> Column:
    """dependency, config, refactor or code, in this order."""
    return (
        F.when(P.basename(path).isin("package.json", "requirements.txt", "go.mod", "pom.xml"), "dependency").when(P.extension(path).isin(".yaml", ".yml", ".toml", ".json"), "config")
        .when(F.lower(description).rlike("refactor|extract|rename"), "refactor").otherwise("code")
    )


def fixes(changes: DataFrame, findings: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (plan_id, idx, file_path, description, confidence) x findings of the plan (plan_id, id, confidence) ->
    fix nodes with fixes edges to existing files, and mitigates edges by the lesser confidence."""
    at = F.concat_ws(":", F.lit("fix"), "plan_id", F.col("idx").cast("string"))
    files = changes.select(at.alias("source"), F.concat(F.lit("file:"), "file_path").alias("target"), F.lit("fixes").alias("type"), F.col("confidence").alias("weight"))
    files = files.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type", "weight")
    met = changes.select("plan_id", at.alias("source"), F.col("confidence").alias("c")).join(findings.select("plan_id", F.concat(F.lit("fault:"), "id").alias("target"), F.col("confidence").alias("d")), "plan_id")
    mitigates = met.select("source", "target", F.lit("mitigates").alias("type"), F.least("c", "d").alias("weight"))
    made = changes.select(at.alias("id"), fix_type(F.col("file_path"), F.col("description")).alias("fix_type"), T.truncate(F.col("description")).alias("name"))
    return made, files.union(mitigates)


def learned_from(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """patterns (task_id, kind, id, frequency) x sources of the task (task_id, node) -> learned_from edges."""
    return patterns.join(sources, "task_id").select(F.concat_ws(":", F.lit("pattern"), "kind", "id").alias("source"), F.col("node").alias("target"), F.lit("learned_from").alias("type"), F.least(F.lit(1.0), 0.5 + 0.1 * F.col("frequency")).alias("weight"))


def fault_patterns(findings: DataFrame) -> DataFrame:
    """findings (seq, type, description, ref) -> by fuzzy key: first text and language, and how often."""
    f = findings.where(F.col("type").isin("fault", "style")).withColumn("text", T.normalise_description(F.col("description")))
    ext = P.extension(F.col("ref"))
    language = F.when(ext.isin(".ts", ".tsx"), "typescript").when(ext.isin(".js", ".jsx"), "javascript").when(ext == ".py", "python").otherwise("unknown")
    g = f.groupBy(T.fault_key(F.col("text")).alias("key")).agg(F.min_by("text", "seq").alias("pattern"), F.min_by(language, "seq").alias("language"), F.count("*").alias("frequency"))
    return g.select(T.slug(F.col("key")).alias("id"), "pattern", "language", "frequency")


def naming(symbols: DataFrame, examples: int = 3) -> DataFrame:
    """symbols (seq, kind, name) -> a convention where over 70 % of the names follow it; first names as examples."""
    ok = F.when(F.col("kind") == "function", T.camel_case(F.col("name"))).when(F.col("kind") == "class", T.pascal_case(F.col("name")))
    s = symbols.where(F.col("kind").isin("function", "class")).withColumn("ok", ok)
    # a bounded list of first examples: the least sequence numbers of each kind, by top-k before the collect
    first = s.where("ok").withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("seq"))).where(F.col("r") <= examples)
    first = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("examples"))
    ratio = s.groupBy("kind").agg(F.avg(F.col("ok").cast("double")).alias("confidence")).where(F.col("confidence") > 0.7)
    rule = F.when(F.col("kind") == "function", "Functions use camelCase").otherwise("Classes use PascalCase")
    return ratio.join(first, "kind").select(F.lit("naming").alias("category"), rule.alias("rule"), "examples", F.round("confidence", 6).alias("confidence"))


def testing(files: DataFrame) -> DataFrame:
    """files (seq, path) -> the suffix of test files, by the first one; more files, more confidence."""
    t = files.where(F.col("path").contains(".test.") | F.col("path").contains(".spec."))
    g = t.agg(F.count("*").alias("n"), F.min_by("path", "seq").alias("p")).where("n > 0")
    suffix = F.when(F.col("p").contains(".test."), ".test.").otherwise(".spec.")
    return g.select(F.lit("testing").alias("category"), F.concat(F.lit("Test files use "), suffix, F.lit(" suffix")).alias("rule"), F.least(F.lit(1.0), F.round(F.col("n") * 0.2, 6)).alias("confidence"))


def architecture(exports: DataFrame) -> DataFrame:
    """exports (path, name) -> barrel files, if an index.ts exports more than two names."""
    n = exports.where(F.col("path").endswith("index.ts")).groupBy("path").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return n.where("n > 2").select(F.lit("architecture").alias("category"), F.lit("Modules use barrel exports (index.ts)").alias("rule"), F.lit(0.7).alias("confidence"))


def root_cause(findings: DataFrame) -> DataFrame:
    """findings (task, seq, type, description) -> severity, confidence and joined descriptions of each task."""
    sev = F.when(F.bool_or(F.col("type") == "security"), "critical").when(F.bool_or(F.col("type") == "bug"), "high").otherwise("medium")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"]), "; ")
    return findings.groupBy("task").agg(sev.alias("severity"), F.round(F.least(0.3 + 0.15 * F.count("*"), F.lit(0.9)), 6).alias("confidence"), text.alias("root_cause"))


def solutions(findings: DataFrame, code: DataFrame, problem: str) -> DataFrame:
    """findings (task, description) x code of the task (task, path, code) -> changes; a file without one gets a generic change."""
    met = findings.select("task", "description").join(code, "task")
    low, c = F.lower("description"), F.col("code")
    # fixed values: what each kind of finding asks for, and the generic change
    options = F.array(
        F.struct((low.contains("null") | low.contains("undefined")).alias("on"), F.lit("Add null-safety checks").alias("what"), F.regexp_replace(c, r"(\w+)\.(\w+)\(", "$1?.$2(").alias("after")),
        F.struct(low.contains("console.log").alias("on"), F.lit("Replace console logging with structured logger").alias("what"), F.regexp_replace(c, r"console\.(log|error)\(", "logger.info(").alias("after")),
        F.struct(low.contains("empty catch").alias("on"), F.lit("Add error handling to catch block").alias("what"), F.regexp_replace(c, r"catch\s*\(([^)]*)\)\s*\{\s*\}", "catch ($1) { /* TODO: handle error */ }").alias("after")),
    )
    made = met.select("task", "path", "code", F.explode(options).alias("o")).where("o.on and o.after <> code").select("task", "path", F.col("o.what").alias("description"), F.col("o.after").alias("modified")).distinct()
    bare = code.join(made.select("task", "path").distinct(), ["task", "path"], "left_anti")
    return made.union(bare.select("task", "path", F.lit(f"Review and address: {problem}"), F.lit(None).cast("string")))


def numbered(found: DataFrame, group: str, order: str) -> DataFrame:
    """``found`` with ids ``finding-<group>-llm-<ordinal>``, counted from 0 within each group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return found.withColumn("id", F.concat(F.lit("finding-"), F.col(group).cast("string"), F.lit("-llm-"), at.cast("string")))
