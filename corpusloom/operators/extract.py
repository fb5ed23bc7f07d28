"""Facts from source text by pattern."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verbs of routes, calls that subscribe and publish, receivers of middleware, calls that read and write files.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "all")
SUBSCRIBE = ("on", "once", "addEventListener", "subscribe")
PUBLISH = ("emit", "publish", "dispatch", "next")
SERVERS = ("app", "router", "server", "api")
FS_READ = ("readFile", "readFileSync", "read", "createReadStream")
FS_WRITE = ("writeFile", "writeFileSync", "write", "appendFile", "createWriteStream", "unlink", "rm", "mkdir")

#: One form for every place that a framework is told something: a word (or none) before a dot or an at sign, a word, and
#: an opening bracket; then, if it is there, one literal in quotes of a kind without other quotes in it, or one bare name
#: alone. What such a place means is said by filters on its parts.
PLACE = r"""(?<!\w)(\w*+)([.@])(\w++)\s*+\(\s*+(?:(["'`])([^"'`]*+)\4|([A-Za-z_$][\w$]*+)\s*+\))?"""
#: A member of the file system's module, or of its part for promises.
FILE_MEMBER = r"(?<!\w)fs\.(?:promises\.)?(\w++)"
#: What a file declares of a schema: in Prisma the word model, a name and its block; in SQL the words create and table,
#: perhaps the words if not exists, and a name, perhaps quoted.
DECLARES = {".prisma": r"(?<!\w)model\s++(\w+)\s*+\{", ".sql": r"""(?i)(?<!\w)create\s++table\s++(?:if\s++not\s++exists\s++)?["'`\[]?(\w+)"""}


#: What a text tells frameworks: kind, name, type.
MARKS = "array<struct<kind:string,name:string,type:string>>"


def marks(text: Column) -> Column:
    """What a text tells frameworks, as MARKS in one pass over it, as often as it is told: a route (its path; the verb), an
    event (its name; subscribes or publishes), a use of middleware (its name) and data (filesystem or database; reads_from
    or writes_to). Each place is found once and its parts are read from the match: no part of PLACE looks beyond its end."""
    mark = lambda kind, name, type_: F.struct(F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"))
    parts = lambda m: F.struct(*[F.regexp_extract(m, PLACE, g).alias(c) for g, c in ((1, "receiver"), (2, "mark"), (3, "method"), (5, "literal"), (6, "name"))])

    def meant(p: Column) -> Column:
        dotted, method = p["mark"] == ".", p["method"]
        heard = F.when(method.isin(*SUBSCRIBE), "subscribes").when(method.isin(*PUBLISH), "publishes")
        return F.array(
            F.when(F.lower(method).isin(*VERBS) & p["literal"].startswith("/"), mark("route", p["literal"], F.upper(method))),
            F.when(dotted & (p["literal"] != ""), mark("event", p["literal"], heard)),
            F.when(dotted & p["receiver"].isin(*SERVERS) & (method == "use") & (p["name"] != ""), mark("use", p["name"], F.lit("middleware"))),
            F.when(dotted & (p["receiver"] != "") & (method == "query"), mark("data", F.lit("database"), F.lit("reads_from"))),
        )

    touched = lambda m: mark("data", F.lit("filesystem"), F.when(m.isin(*FS_READ), "reads_from").when(m.isin(*FS_WRITE), "writes_to"))
    said = F.flatten(F.transform(F.transform(F.regexp_extract_all(text, F.lit(PLACE), F.lit(0)), parts), meant))
    every = F.concat(said, F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_MEMBER), F.lit(1))), touched))
    return F.coalesce(F.filter(every, lambda x: x["type"].isNotNull()), F.array()).cast(MARKS)


def _marked(files: DataFrame, kind: str, name: str, type_: str) -> DataFrame:
    """(path, name, type) of one kind, each once: from the column ``marks`` where the files have it, else from their texts."""
    every = files.select("path", F.explode(F.col("marks") if "marks" in files.columns else marks(F.col("content"))).alias("m")).where(F.col("m.kind") == kind)
    return every.select("path", F.col("m.name").alias(name), F.col("m.type").alias(type_)).distinct()


def routes(files: DataFrame) -> DataFrame:
    """(path, method, route): registrations by call and by decorator; the route begins with a slash."""
    return _marked(files, "route", "route", "method").select("path", "method", "route")


def events(files: DataFrame) -> DataFrame:
    """(path, event, type): subscribes and publishes with a literal name."""
    return _marked(files, "event", "event", "type")


def middleware(files: DataFrame) -> DataFrame:
    """(path, name): bare identifiers that a server-like receiver uses."""
    return _marked(files, "use", "name", "type").select("path", "name")


def data_access(files: DataFrame) -> DataFrame:
    """(path, resource, type): reads_from and writes_to the file system, and reads_from databases: what has a query."""
    return _marked(files, "data", "resource", "type")


def schema_tables(files: DataFrame) -> DataFrame:
    """(path, name): models of Prisma files and tables of SQL files."""
    low, none = F.lower("path"), F.array().cast("array<string>")
    found = [F.when(low.endswith(ext), F.regexp_extract_all("content", F.lit(form), F.lit(1))).otherwise(none) for ext, form in DECLARES.items()]
    return files.select("path", F.explode(F.concat(*found)).alias("name")).distinct()


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


#: Line forms of functions, each with the group of its name and parameters.
FUNCTIONS = ((r"^(export\s+)?(async\s+)?function\s+(\w+)\s*\(([^)]*)\)", 3, 4), (r"^(export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", 2, 3), (r"^(export\s+)?const\s+(\w+)\s*=\s*async\s+function\s*\(([^)]*)\)", 2, 3))


def signatures(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, detail, exported): functions, classes, imports and exports of a line, first form wins."""
    t = F.col("text")
    got = lambda form, g: F.regexp_extract(t, form, g)
    row = lambda kind, name, detail, exported: F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"), exported.alias("exported"))
    params = lambda x: F.array_join(F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != ""), ",")
    fn = F.lit(None)
    for form, name, args in reversed(FUNCTIONS):
        fn = F.when(t.rlike(form), row("function", got(form, name), params(got(form, args)), got(form, 1) != "")).otherwise(fn)
    cls = r"^(export\s+)?class\s+(\w+)"
    imp = r"""import\s+(?:(\{[^}]+\})|(\w+))\s+from\s+['"]([^'"]+)['"]"""
    exp, dflt = r"^export\s+(?:default\s+)?(?:(?:async\s+)?function|class|const|let|var|type|interface)\s+(\w+)", r"^export\s+default\s+(\w+)"
    items = params(F.regexp_replace(F.concat(got(imp, 1), got(imp, 2)), "[{}]", ""))
    kind = F.when(t.contains("function"), "function").when(t.contains("class"), "class").otherwise("variable")
    rows = F.array(
        fn, F.when(t.rlike(cls), row("class", got(cls, 2), F.lit(""), got(cls, 1) != "")), F.when(t.rlike(imp), row("import", got(imp, 3), items, got(imp, 2) != "")),
        F.when(t.rlike(exp), row("export", got(exp, 1), kind, F.lit(True))).when(t.rlike(dflt), row("export", got(dflt, 1), F.lit("default"), F.lit(True))),
    )
    return lines(files).select("path", "line", F.explode(rows).alias("x")).where("x is not null").select("path", "line", "x.*")


def python_signatures(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, detail) of Python files by its own parser, in Arrow batches; a file that doesn't parse
    gives one row of kind error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError) as e:
                    rows.append((path, type(e).__name__, "error", 0, ""))
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((path, node.name, "function", node.lineno, ",".join(a.arg for a in node.args.args)))
                    elif isinstance(node, ast.ClassDef):
                        rows.append((path, node.name, "class", node.lineno, ",".join(ast.unparse(b) for b in node.bases)))
                    elif isinstance(node, ast.ImportFrom):
                        rows.append((path, "." * node.level + (node.module or ""), "import", node.lineno, ",".join(a.name for a in node.names)))
                    elif isinstance(node, ast.Import):
                        rows += [(path, a.name, "import", node.lineno, "") for a in node.names]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "detail"])

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(parse, "path string, name string, kind string, line int, detail string")


def repair_json(text: str) -> str:
    """A JSON text that was cut off, made whole: fences go, an open string and open brackets are closed in order."""
    text = text.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[1] if "\n" in text else ""
        text = text.rsplit("```", 1)[0]
    open_, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    out = text + ('"' if quoted else "")
    out = out.rstrip().rstrip(",")
    if out.endswith(":"):
        out += "null"
    return out + "".join(reversed(open_))


def repaired(text: Column) -> Column:
    """Repaired JSON, or null where it still isn't JSON; in Arrow batches."""

    def one(t):
        if t is None:
            return None
        fixed = repair_json(t)
        try:
            json.loads(fixed)
        except ValueError:
            return None
        return fixed

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(batch, "string")(text)
