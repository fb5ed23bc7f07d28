"""Facts of source files across lines: a small scanner keeps strings, comments and brackets apart, Spark reads the rest.

The scanner knows no grammar. It gives the code of a file with each string and each bracket as a number, so a signature
over many lines is one run of text, and nothing within a string, a comment or a body is taken for a declaration. What
counts as a function, a class, an import or an export of a language is said by the patterns below, as Spark expressions.
"""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P

JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Code without a token, then a token if one begins there: a run is passed at once, not tried at each character.
_PLAIN = r"""[^"'`/()\[\]{{}}]*+(//[^\n]*|/\*(?:.*?\*/|.*)|{extra}"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[{{}}()\[\]])?"""
TOKENS = {
    "js": re.compile(_PLAIN.format(extra=r"`|"), re.S),
    "go": re.compile(_PLAIN.format(extra=r"`[^`]*`?|"), re.S),
    "java": re.compile(_PLAIN.format(extra=r'"""(?:(?:\\.|.)*?"""|.*)|'), re.S),
}
#: A slash begins a pattern where a value may begin: after an operator, an opening bracket or a line's beginning, with at
#: most 16 blanks between.
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)
_VALUES = frozenset("(,=:[!&|?{;+-*%~^<>\n")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Before a line's number at the outermost level.
MARK = "\ue000"


class Outline:
    """The code of a text: ``top``, what lies outside all brackets; ``strings`` (text, line); ``groups`` (start, end, own,
    inner) of the brackets on the two outer levels: lines, own text, and all text of the outermost ones. In ``top`` and
    ``own`` a string is ``"n"`` and a bracket ``(n)``, by its place in the lists; deeper brackets are empty. In ``inner`` a
    bracket with brackets in it is spelt out without its number, so names in it stand alone; another is as in ``own``."""

    def __init__(self, text: str, dialect: str):
        self.strings: list[tuple[str, int]] = []
        self.groups: list[list] = []
        self.line, self.flat, self.marks = 1, [], {}
        self.stack: list[tuple[str, int]] = []  # what closes it, number of the group or -1
        self.buffers: list[list[str]] = [[f"{MARK}1\n"]]
        self._scan(text, dialect)
        while self.stack:
            self._pop()
        self.top = "".join(self.buffers[0])

    def _put(self, s: str) -> None:
        self.buffers[-1].append(s)
        if self.stack:
            self.flat.append(s)

    def _text(self, s: str) -> None:
        """Code between tokens, with its line ends."""
        if self.stack:
            self.buffers[-1].append(s)
            self.flat.append(s)
            self.line += s.count("\n")
        elif "\n" in s:
            first, *rest = s.split("\n")
            out = [first]
            for part in rest:
                self.line += 1
                out.append(f"{MARK}{self.line}\n{part}")
            self.buffers[0].append("".join(out))
        else:
            self.buffers[0].append(s)

    def _string(self, body: str) -> None:
        self._put(f'"{len(self.strings)}"')
        self.strings.append((body, self.line))
        self.line += body.count("\n")

    def _push(self, opener: str, closer: str, kept: bool) -> None:
        n = len(self.groups) if kept else -1
        if kept:
            self.groups.append([self.line, self.line, "", ""])
        self._put(opener + (str(n) if kept else ""))
        if kept:
            self.marks[n] = len(self.flat)
        self.stack.append((closer, n))
        self.buffers.append([])

    def _pop(self) -> None:
        closer, n = self.stack.pop()
        own = "".join(self.buffers.pop())
        if n >= 0:
            self.groups[n][1:3] = self.line, own
            if not self.stack:
                self.groups[n][3] = "".join(self.flat)
            elif any("(" in s for s in self.flat[self.marks[n] :]):
                self.flat[self.marks[n] - 1] = self.flat[self.marks[n] - 1][0]
            else:
                del self.flat[self.marks[n] :]
        if not self.stack:
            self.flat = []
        if closer != "`":
            self._put(closer)

    def _scan(self, text: str, dialect: str) -> None:
        at, stack = 0, self.stack
        while at < len(text):
            at = self._template(text, at) if stack and stack[-1][0] == "`" else self._code(text, at, dialect)

    def _template(self, text: str, at: int) -> int:
        """Pass over a template's text, up to its end or to code in it."""
        while m := _TEMPLATE.search(text, at):
            self.line += text.count("\n", at, m.end())
            at = m.end()
            if m[0] == "`":
                self._pop()
                return at
            if m[0] == "${":
                self._push("{", "}", False)
                return at
        self.line += text.count("\n", at)
        return len(text)

    def _code(self, text: str, since: int, dialect: str) -> int:
        """Read code up to its end or to a template's text."""
        at, end, stack, match, js = since, len(text), self.stack, TOKENS[dialect].match, dialect == "js"
        while at < end:
            m = match(text, at)
            token, stop = m[1], m.end()
            if token is None:  # a character that begins no token here, or a pattern
                first, literal = self._pattern(text, since, stop) if js and text.startswith("/", stop) else (stop, "")
                at = first + len(literal) if literal else stop + 1
                if literal:
                    if first > since:
                        self._text(text[since:first])
                    since = at
                    self._string(literal)
                continue
            first = stop - len(token)
            if first > since:
                self._text(text[since:first])
            at = since = stop
            if token in CLOSE:
                self._push(token, CLOSE[token], len(stack) < 2)
            elif token in (")", "]", "}"):
                self._close(token)
                if stack and stack[-1][0] == "`":
                    return at
            elif token.startswith(("//", "/*")):
                self.line += token.count("\n")
                self._put(" ")
            elif token == "`":
                self._string("")
                stack.append(("`", -1))
                self.buffers.append([])
                return at
            else:
                q = 3 if token.startswith('"""') else 1
                self._string(token.strip()[q:-q])
        if end > since:
            self._text(text[since:])
        return end

    def _pattern(self, text: str, since: int, slash: int) -> tuple[int, str]:
        """Where the blanks before a slash begin, and they with the pattern that it begins; nothing if it begins none."""
        first = slash
        while first > since and text[first - 1] in " \t":
            first -= 1
        if slash - first > 16 or not first or text[first - 1] not in _VALUES:
            return first, ""
        m = _REGEX.match(text, slash)
        return first, text[first : m.end()] if m else ""

    def _close(self, token: str) -> None:
        if self.stack and self.stack[-1][0] == token:
            self._pop()
            return
        open_ = [closer for closer, _ in self.stack]
        if token in open_ and "`" not in open_[len(open_) - open_[::-1].index(token) :]:
            while self.stack[-1][0] != token:
                self._pop()
            self._pop()


_OUTLINE = "path string, content_hash string, total_lines int, dialect string, top string, strings array<struct<text:string,line:int>>, groups array<struct<start:int,end:int,own:string,inner:string>>"
_STRINGS = pa.list_(pa.struct([("text", pa.string()), ("line", pa.int32())]))
_GROUPS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("own", pa.string()), ("inner", pa.string())]))


def outlines(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """files (path, content) with a dialect -> their outlines, one row a file, in the files' own partitions; the columns
    ``keep`` pass through."""
    columns = ["path", "content_hash", "total_lines", "dialect", "top", "strings", "groups", *keep]
    ext = P.extension(F.col("path"))
    dialect = F.when(ext == ".go", "go").when(ext == ".java", "java").otherwise("js")

    def arrays(found: list[Outline]) -> list[pa.Array]:
        each = lambda rows, kind: pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind.value_type.field(n).type) for n, c in enumerate(zip(*itertools.chain(*rows)) if any(rows) else [[]] * kind.value_type.num_fields)], fields=list(kind.value_type)))
        return [pa.array([o.top for o in found]), each([o.strings for o in found], _STRINGS), each([o.groups for o in found], _GROUPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of as many files as came, fewer where texts are long."""
        for batch in batches:
            found, size, first = [], 0, 0
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py() or ""
                found.append(Outline(text, batch.column(4)[i].as_py()))
                size += len(text)
                if size > 1 << 22 or i == batch.num_rows - 1:
                    as_it_is = [batch.column(j).slice(first, len(found)) for j in (0, 1, 2, *range(4, batch.num_columns))]
                    yield pa.RecordBatch.from_arrays(as_it_is[:4] + arrays(found) + as_it_is[4:], columns)
                    found, size, first = [], 0, i + 1

    text = F.coalesce("content", F.lit(""))
    rows = files.select("path", F.sha2(text.cast("binary"), 256).alias("content_hash"), F.size(F.split(text, "\n", -1)).alias("total_lines"), "content", dialect.alias("dialect"), *keep)
    return rows.mapInArrow(run, ", ".join([_OUTLINE, *[f"{k} {files.schema[k].dataType.simpleString()}" for k in keep]]))


# ---- what the languages write, over the outline

NAME = r"[A-Za-z_$][\w$]*+"
_AT = r"(?:^|(?<=[;}\n]))[ \t]*+"  # where a statement may begin
_DECOR = r"(?:@[\w.$]+(?:\(\d+\))?\s*+)*+"
_GENERIC = r"(?:<[^(){}]*>\s*+)?"
#: Groups: export, text up to the parameters, name, parameters, result, body.
FUNCTION = rf"{_AT}(export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?(function\b\s*+\*?\s*+({NAME})\s*+{_GENERIC})\((\d+)\)\s*+(?::([^{{}};]*))?\{{(\d+)\}}"
#: Groups: line, export, name, parameters, result, body. Of the lines' numbers only those before variables are kept for it.
NO_VARIABLE = rf"{MARK}\d++(?!\n[ \t]*+(?:export|const|let|var)\b)"
ARROW = rf"(?:{MARK}(\d+)\n[ \t]*+|{_AT})(export\s+)?(?:const|let|var)\s+({NAME})\s*+(?::[^=;{{}}]*)?=\s*+(?:async\b\s*+)?{_GENERIC}(?:\((\d+)\)\s*+(?::([^=;{{}}]*))?|{NAME}\s*+)=>\s*+(?:\{{(\d+)\}})?"
#: Groups: export, text up to the body, name, heritage, body.
CLASS = rf"{_AT}{_DECOR}(export\s+(?:default\s+)?)?(?:declare\s+)?((?:abstract\s+)?class\s+({NAME})([^{{}};]*))\{{(\d+)\}}"
_MODS = r"(?:(?:public|private|protected|static|async|override|readonly|declare|abstract|get|set)\s+|\*\s*+)*+"
METHOD = rf"{_AT}{_DECOR}{_MODS}(#?{NAME})\s*+{_GENERIC}\(\d+\)\s*+(?::[^{{}};]*)?\{{\d+\}}"
FIELD = rf"{_AT}{_DECOR}{_MODS}(#?{NAME})\s*+[?!]?[ \t]*+(?=[:=;\n]|$)"
#: Groups: clause, source; and the source of an import for its effects.
IMPORT = rf"{_AT}import\s+(?:type\s+)?([^;\"'=()]*?)\s*+from\s*+\"(\d+)\""
EFFECT = rf"{_AT}import\s*+\"(\d+)\""
VARIABLE = rf"{MARK}(\d+)\n[^\n{MARK}]*?\bexport\s+(?:const|let|var)\s+({NAME})"
REEXPORT = rf"{_AT}export\s*+\{{(\d+)\}}\s*+from\b"
#: Groups: receiver or name and generics before the parameters, name, parameters, result, body.
GO_FUNCTION = r"(?:^|(?<=\n))(func\s*+(?:\(\d+\)\s*+)?([A-Za-z_]\w*+)\s*+(?:\[\d+\]\s*+)?)\((\d+)\)\s*+([^{}\n]*)\{(\d+)\}"
GO_TYPE = r"(?:^|(?<=\n))(type\s+([A-Za-z_]\w*+)\s*+(?:\[\d+\]\s*+)?(?:struct|interface)?\s*+)\{(\d+)\}"
GO_IMPORT = r"(?:^|(?<=\n))import\s+(?:[\w.]+\s+)?\"(\d+)\""
GO_IMPORTS = r"(?:^|(?<=\n))import\s*+\((\d+)\)"
GO_FIELD = r"(?m)^\s*+([A-Za-z_]\w*+)(?:\s*,\s*\w+)*[ \t]+[^\s,]"
_JMODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp|transient|volatile)\s+)*+"
_JTYPE = r"[\w$.]++(?:<[^(){};]*>)?(?:\[\d*\])*+\s+"
JAVA_CLASS = rf"{_AT}{_DECOR}{_JMODS}((?:class|interface)\s+({NAME})[^{{}};]*)\{{(\d+)\}}"
JAVA_METHOD = rf"{_AT}{_DECOR}{_JMODS}{_GENERIC}{_JTYPE}({NAME})\s*+\(\d+\)"
JAVA_FIELD = rf"{_AT}{_DECOR}{_JMODS}{_JTYPE}({NAME})\s*+(?:\[\d*\])?(?=[=;,])"
JAVA_IMPORT = rf"{MARK}(\d+)\n\s*+import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*+;"
#: A call, with what makes it none: an object made, a function declared.
CALLEE = rf"(?<![\w$])((?:(?:new|function)\b\s*+\*?\s*+)?{NAME}(?:\s*+\??\.\s*+#?{NAME})*+)\s*+(?:<[^<>(){{}};=]{{0,200}}>)?\("
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "new", "await", "typeof", "do", "else", "with", "super", "async", "in", "of", "void", "delete", "throw", "case")

FUNCTIONS = "array<struct<name:string,params:array<string>,return_type:string,is_exported:boolean,start_line:int,end_line:int,calls:array<string>>>"
CLASSES = "array<struct<name:string,methods:array<string>,properties:array<string>,is_exported:boolean,start_line:int,end_line:int,super_class:string,implements:array<string>>>"
IMPORTS = "array<struct<source:string,items:array<string>,is_default:boolean,line:int>>"
EXPORTS = "array<struct<name:string,kind:string,line:int>>"


def _none() -> Column:
    return F.array().cast("array<string>")



def _hits(text: Column, form: str, *groups: int) -> Column:
    """All matches of a form as an array of structs g0, g1, ... of the groups named. The text is searched once; the groups
    are read from each match, where a form holds as well: none looks beyond its end, and it begins where a text may."""
    return F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: F.struct(*[F.regexp_extract(m, form, g).alias(f"g{i}") for i, g in enumerate(groups)]))


def _group(n: Column) -> Column:
    return F.get("groups", n.cast("int"))


def _text(n: Column) -> Column:
    return F.get("strings", n.cast("int"))["text"]


def _begins(group: Column, before: Column) -> Column:
    """The line on which a match begins: that of its bracket, less the line ends before it."""
    return group["start"] - (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def _flat(own: Column) -> Column:
    """Without type arguments, so commas divide what they seem to."""
    bare = own
    for _ in range(3):
        bare = F.regexp_replace(bare, "<[^<>]*>", "")
    return F.when(own.contains("<"), bare).otherwise(own)


def _bare(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def _listed(own: Column) -> Column:
    """The items between commas, trimmed, none empty."""
    return F.filter(F.transform(F.split(_flat(own), ","), _bare), lambda x: x != "")


def _or_null(text: Column) -> Column:
    bare = _bare(text)
    return F.when(bare != "", bare)


def callees(code: Column) -> Column:
    """The distinct last names of what is called, in order."""
    every = F.filter(F.regexp_extract_all(code, F.lit(CALLEE), F.lit(1)), lambda c: ~c.rlike(r"^(?:new|function)\b"))
    names = F.transform(every, lambda c: F.regexp_replace(F.regexp_extract(c, r"([\w$#]+)$", 1), "#", ""))
    return F.array_distinct(F.filter(names, lambda w: ~w.isin(*NO_CALLS)))


def _js_params(n: Column) -> Column:
    return F.filter(F.transform(_listed(F.regexp_replace(_group(n)["own"], r"([\[{(])\d+", "$1")), lambda p: F.regexp_extract(p, rf"^(?:@[\w.$]+(?:\(\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*((?:\.\.\.)?(?:{NAME}|\{{\}}|\[\]))", 1)), lambda p: p != "")


def _js(top: Column, code: Column, fn: Column, cl: Column) -> dict[str, Column]:
    calls = lambda body: F.get(F.filter(F.array(callees(_group(body)["inner"])), lambda x: F.size(x) > 0), F.lit(0))
    declared = F.transform(fn, lambda m: F.struct(m["g2"].alias("name"), _js_params(m["g3"]).alias("params"), _or_null(m["g4"]).alias("return_type"), (m["g0"] != "").alias("is_exported"), _begins(_group(m["g3"]), m["g1"]).alias("start_line"), _group(m["g5"])["end"].alias("end_line"), calls(m["g5"]).alias("calls")))
    number = lambda g: F.when(g != "", g.cast("int"))

    def arrow(m: Column) -> Column:
        p, body = F.get("groups", number(m["g3"])), F.get("groups", number(m["g5"]))
        params = F.when(m["g3"] != "", _js_params(number(m["g3"]))).otherwise(_none())
        start = F.coalesce(number(m["g0"]), p["start"], body["start"], F.lit(1))
        return F.struct(m["g2"].alias("name"), params.alias("params"), _or_null(m["g4"]).alias("return_type"), (m["g1"] != "").alias("is_exported"), start.alias("start_line"), F.coalesce(body["end"], p["end"], start).alias("end_line"), F.lit(None).cast("array<string>").alias("calls"))

    arrows = F.transform(_hits(F.regexp_replace(top, NO_VARIABLE, ""), ARROW, 1, 2, 3, 4, 5, 6), arrow)
    functions = F.array_sort(F.concat(declared.cast(FUNCTIONS), arrows.cast(FUNCTIONS)), lambda a, b: a["start_line"] - b["start_line"])

    def heritage(m: Column) -> tuple[Column, Column]:
        last = lambda x: F.regexp_extract(x, r"([\w$]+)$", 1)
        parent = F.regexp_extract(m["g3"], rf"extends\s+((?:{NAME}\.)*{NAME})", 1)
        names = F.transform(_listed(F.regexp_extract(m["g3"], r"(?s)implements\s+(.+)$", 1)), lambda x: last(F.regexp_extract(x, r"^([\w$.]+)", 1)))
        return F.when(parent != "", last(parent)), F.when(F.size(names) > 0, names)

    def cls(m: Column) -> Column:
        own = _group(m["g4"])["own"]
        parent, interfaces = heritage(m)
        return F.struct(m["g2"].alias("name"), F.regexp_extract_all(own, F.lit(METHOD), F.lit(1)).alias("methods"), F.regexp_extract_all(own, F.lit(FIELD), F.lit(1)).alias("properties"), (m["g0"] != "").alias("is_exported"), _begins(_group(m["g4"]), m["g1"]).alias("start_line"), _group(m["g4"])["end"].alias("end_line"), parent.alias("super_class"), interfaces.alias("implements"))

    classes = F.transform(cl, cls)

    def clause(m: Column) -> Column:
        row = lambda items, default: F.struct(_text(m["g1"]).alias("source"), items.alias("items"), F.lit(default).alias("is_default"), F.get("strings", m["g1"].cast("int"))["line"].alias("line"))
        name = F.regexp_extract(m["g0"], rf"^({NAME})", 1)
        space = F.regexp_extract(m["g0"], rf"\*\s*as\s+({NAME})", 1)
        group = F.regexp_extract(m["g0"], r"\{(\d+)\}", 1)
        items = F.transform(_listed(_group(F.when(group != "", group))["own"]), lambda x: F.regexp_extract(x, rf"^(?:type\s+)?({NAME})", 1))
        every = F.array(F.when(name != "", row(F.array(name), True)), F.when(space != "", row(F.array(F.concat(F.lit("* as "), space)), False)), F.when(group != "", row(items, False)))
        return F.filter(every, lambda x: x.isNotNull()).cast(IMPORTS)

    effects = F.transform(F.regexp_extract_all(code, F.lit(EFFECT), F.lit(1)), lambda n: F.struct(_text(n).alias("source"), _none().alias("items"), F.lit(False).alias("is_default"), F.get("strings", n.cast("int"))["line"].alias("line"))).cast(IMPORTS)
    imports = F.array_sort(F.concat(F.flatten(F.transform(_hits(code, IMPORT, 1, 2), clause)), effects), lambda a, b: a["line"] - b["line"])

    out = lambda name, kind, line: F.struct(name.alias("name"), F.lit(kind).alias("kind"), line.cast("int").alias("line"))
    said = lambda rows, kind, mark, g: F.transform(F.filter(rows, lambda m: m["g0"].rlike(mark)), lambda m: out(m["g2"], kind, _begins(_group(m[g]), m["g1"])))
    variables = F.transform(_hits(top, VARIABLE, 2, 1), lambda m: out(m["g0"], "variable", m["g1"]))
    again = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(REEXPORT), F.lit(1)), lambda n: F.transform(_listed(_group(n)["own"]), lambda x: out(F.regexp_extract(x, rf"^(?:type\s+)?({NAME})", 1), "default", _group(n)["start"]))))
    exports = F.concat(*[x.cast(EXPORTS) for x in (said(fn, "function", "export", "g3"), said(cl, "class", "export", "g4"), variables, said(fn, "default", "default", "g3"), said(cl, "default", "default", "g4"), again)])
    return {"functions": functions, "classes": classes.cast(CLASSES), "imports": imports, "exports": F.array_sort(exports, lambda a, b: a["line"] - b["line"])}


def _go(code: Column) -> dict[str, Column]:
    param = lambda p: F.when(p.rlike(r"^\w+\s+\S"), F.concat(F.regexp_extract(p, r"^(\w+)", 1), F.lit(": "), F.regexp_extract(p, r"^\w+\s+(.*)$", 1))).otherwise(p)
    params = lambda n: F.transform(_listed(_group(n)["own"]), param)
    public = lambda name: F.substring(name, 1, 1) == F.upper(F.substring(name, 1, 1))
    group = lambda r: F.regexp_extract(r, r"^\s*\((\d+)\)\s*$", 1)
    result = lambda r: F.when(group(r) != "", F.array_join(params(F.when(group(r) != "", group(r))), ", ")).otherwise(_or_null(r))
    functions = F.transform(_hits(code, GO_FUNCTION, 1, 2, 3, 4, 5), lambda m: F.struct(m["g1"].alias("name"), params(m["g2"]).alias("params"), result(m["g3"]).alias("return_type"), public(m["g1"]).alias("is_exported"), _begins(_group(m["g2"]), m["g0"]).alias("start_line"), _group(m["g4"])["end"].alias("end_line"), F.lit(None).cast("array<string>").alias("calls"))).cast(FUNCTIONS)
    fields = lambda m: F.when(m["g0"].contains("struct"), F.regexp_extract_all(_group(m["g2"])["own"], F.lit(GO_FIELD), F.lit(1))).otherwise(_none())
    classes = F.transform(_hits(code, GO_TYPE, 1, 2, 3), lambda m: F.struct(m["g1"].alias("name"), _none().alias("methods"), fields(m).alias("properties"), public(m["g1"]).alias("is_exported"), _begins(_group(m["g2"]), m["g0"]).alias("start_line"), _group(m["g2"])["end"].alias("end_line"), F.lit(None).cast("string").alias("super_class"), F.lit(None).cast("array<string>").alias("implements"))).cast(CLASSES)
    listed = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(GO_IMPORTS), F.lit(1)), lambda n: F.regexp_extract_all(_group(n)["own"], F.lit(r'"(\d+)"'), F.lit(1))))
    sources = F.concat(F.regexp_extract_all(code, F.lit(GO_IMPORT), F.lit(1)), listed)
    imports = F.transform(sources, lambda n: F.struct(_text(n).alias("source"), _none().alias("items"), F.lit(False).alias("is_default"), F.get("strings", n.cast("int"))["line"].alias("line"))).cast(IMPORTS)
    return {"functions": functions, "classes": classes, "imports": imports, "exports": F.concat(_exported(functions, "function"), _exported(classes, "class"))}


def _exported(rows: Column, kind: str) -> Column:
    return F.transform(F.filter(rows, lambda x: x["is_exported"]), lambda x: F.struct(x["name"].alias("name"), F.lit(kind).alias("kind"), x["start_line"].alias("line"))).cast(EXPORTS)


def _java(top: Column, code: Column) -> dict[str, Column]:

    def cls(m: Column) -> Column:
        own = _group(m["g2"])["own"]
        return F.struct(m["g1"].alias("name"), F.regexp_extract_all(own, F.lit(JAVA_METHOD), F.lit(1)).alias("methods"), F.regexp_extract_all(own, F.lit(JAVA_FIELD), F.lit(1)).alias("properties"), F.lit(True).alias("is_exported"), _begins(_group(m["g2"]), m["g0"]).alias("start_line"), _group(m["g2"])["end"].alias("end_line"), F.lit(None).cast("string").alias("super_class"), F.lit(None).cast("array<string>").alias("implements"))

    classes = F.transform(_hits(code, JAVA_CLASS, 1, 2, 3), cls).cast(CLASSES)
    imports = F.transform(_hits(top, JAVA_IMPORT, 1, 2, 3), lambda m: F.struct(m["g1"].alias("source"), F.when(m["g2"] != "", F.array(F.lit("*"))).otherwise(_none()).alias("items"), F.lit(False).alias("is_default"), m["g0"].cast("int").alias("line"))).cast(IMPORTS)
    return {"functions": F.array().cast(FUNCTIONS), "classes": classes, "imports": imports, "exports": _exported(classes, "class")}


COLUMNS = ("path", "content_hash", "total_lines", "functions", "classes", "imports", "exports", "has_structure")


def facts(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """files (path, content) -> one row a file of COLUMNS: functions, classes, imports and exports as arrays of structs in
    order of lines; no shuffle.

    Only declarations of the outermost level count, and members of classes. Python is read by its own parser; a file
    that it can't read, and files of languages without patterns (read as JavaScript is), have no structure.
    Null and empty contents have none of them; columns but ``keep`` are left out; repeated paths are rows of their own.
    """
    ext = P.extension(F.col("path"))
    rows = outlines(files.where(F.coalesce(ext != ".py", F.lit(True))), keep)
    # columns of their own, which are used more than once and so made once
    rows = rows.withColumn("code", F.regexp_replace("top", rf"{MARK}\d+", ""))
    braced = F.col("dialect") == "js"
    rows = rows.withColumn("fn", F.when(braced, _hits(F.col("code"), FUNCTION, 1, 2, 3, 4, 5, 6))).withColumn("cl", F.when(braced, _hits(F.col("code"), CLASS, 1, 2, 3, 4, 5)))
    js, go, java = _js(*map(F.col, ("top", "code", "fn", "cl"))), _go(F.col("code")), _java(F.col("top"), F.col("code"))
    pick = lambda k: F.when(F.col("dialect") == "go", go[k]).when(F.col("dialect") == "java", java[k]).otherwise(js[k]).alias(k)
    braces = rows.select("path", "content_hash", "total_lines", *[pick(k) for k in ("functions", "classes", "imports", "exports")], F.coalesce(ext.isin(*JS, ".go", ".java"), F.lit(False)).alias("has_structure"), *keep)
    return braces.unionByName(python_facts(files.where(ext == ".py"), keep))


def python_outline(text: str) -> dict[str, list]:
    """Functions, classes, imports and exports of the outermost level of a Python text."""
    out: dict[str, list] = {"functions": [], "classes": [], "imports": [], "exports": []}
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    for x in ast.parse(text).body:
        if isinstance(x, kinds):
            a = x.args
            params = [p.arg for p in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [p.arg for p in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
            out["functions"].append({"name": x.name, "params": params, "return_type": ast.unparse(x.returns) if x.returns else None, "is_exported": False, "start_line": x.lineno, "end_line": x.end_lineno, "calls": None})
            out["exports"].append({"name": x.name, "kind": "function", "line": x.lineno})
        elif isinstance(x, ast.ClassDef):
            names = [ast.unparse(t) for b in x.body if isinstance(b, (ast.Assign, ast.AnnAssign)) for t in (b.targets if isinstance(b, ast.Assign) else [b.target])]
            parent = ast.unparse(x.bases[0]).split(".")[-1] if x.bases else None
            out["classes"].append({"name": x.name, "methods": [b.name for b in x.body if isinstance(b, kinds)], "properties": names, "is_exported": False, "start_line": x.lineno, "end_line": x.end_lineno, "super_class": parent, "implements": None})
            out["exports"].append({"name": x.name, "kind": "class", "line": x.lineno})
        elif isinstance(x, ast.Import):
            out["imports"] += [{"source": a.name, "items": [], "is_default": False, "line": x.lineno} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out["imports"].append({"source": "." * x.level + (x.module or ""), "items": [a.name for a in x.names], "is_default": False, "line": x.lineno})
    return out


def python_facts(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``facts`` of Python files, in Arrow batches, through which the columns ``keep`` pass as JSON."""
    kinds = {"functions": FUNCTIONS, "classes": CLASSES, "imports": IMPORTS, "exports": EXPORTS}
    schema = "path string, content_hash string, total_lines int, " + ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", has_structure boolean" + "".join(f", {k} string" for k in keep)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            found = []
            for text in pdf.content:
                try:
                    found.append(python_outline(text or "") | {"has_structure": True})
                except (SyntaxError, ValueError, RecursionError):
                    found.append({k: [] for k in kinds} | {"has_structure": False})
            for k in (*kinds, "has_structure"):
                pdf[k] = [x[k] for x in found]
            yield pdf.drop(columns="content")[[*COLUMNS, *keep]]

    text = F.coalesce("content", F.lit(""))
    return files.select("path", F.sha2(text.cast("binary"), 256).alias("content_hash"), F.size(F.split(text, "\n", -1)).alias("total_lines"), "content", *[F.to_json(k).alias(k) for k in keep]).mapInPandas(run, schema).select(*COLUMNS, *[F.from_json(k, files.schema[k].dataType).alias(k) for k in keep])
