"""Extraction across lines, against what the texts say."""

import random

import pytest

from corpusloom.operators.outline import Outline, facts

TS = """/* function ghost() { return 1 } */
// import { nothing } from './nowhere';
import express from 'express';
import {
  make as build, Part,
  type Shape
} from "../src/part.js";
import * as all from './all';
import './side';
import def, { other } from './both';

const text = `import { x } from 'y'; class Fake { ${build(`deep ${inner(1)} }`)} }`;
const pattern = /function odd\\( { "/g;

@Entity('x')
export class PartA extends lib.PartB<Map<string, number>>
  implements Shape, Other<A, B> {
  private size: number = 7;
  label = "function fake() { }";
  readonly list?: string[];
  static #count = 0;
  handler = (e) => { go(e); };
  constructor(
    readonly name: string,
  ) { super(); }
  get total() { return helper(1); }
  async run<T>(a: number,
        b: Map<string, number>): Promise<{ x: number }> {
    return new Thing(a).start();
  }
  declared(a: number): void;
}

export async function makeA<T>(
  a: number,
  b = { x: 1, y: [2, 3] },
  ...rest: string[]
): Promise<void> {
  // skipped(1)
  all.build(a)?.then(done);
  const s = 'quoted(1)';
  new Ignored(s);
  if (a) { local(s); local(s) }
  function inner(z) { return deep(z) }
}

function local(x) { return x; }
export const arrow = async (p, q): Promise<void> => {
  call(p);
};
const bare = x => x + 1;
export const answer = 42;
export default function main({ a, b }, [c]) {}
export { one, two as three } from './again';
"""


@pytest.fixture(scope="module")
def one(spark):
    def run(path, content):
        (r,) = facts(spark.createDataFrame([(path, content)], "path string, content string")).collect()
        return r

    return run


def line(text, part):
    return text[: text.index(part)].count("\n") + 1


def test_typescript(one):
    r = one("src/a.ts", TS)
    assert r.has_structure and r.total_lines == TS.count("\n") + 1
    assert [(f.name, f.params, f.return_type, f.is_exported) for f in r.functions] == [
        ("makeA", ["a", "b", "...rest"], "Promise<void>", True), ("local", ["x"], None, False), ("arrow", ["p", "q"], "Promise<void>", True), ("bare", [], None, False), ("main", ["{}", "[]"], None, True),
    ]
    calls = {f.name: f.calls for f in r.functions}
    assert calls["makeA"] == ["build", "then", "local", "deep"] and calls["local"] is None and calls["arrow"] is None
    make = r.functions[0]
    assert (make.start_line, make.end_line) == (line(TS, "export async function makeA"), line(TS, "function local") - 2)
    (c,) = r.classes
    assert (c.name, c.super_class, c.implements, c.is_exported, c.start_line) == ("PartA", "PartB", ["Shape", "Other"], True, line(TS, "export class"))
    assert c.methods == ["constructor", "total", "run"]
    assert c.properties == ["size", "label", "list", "#count", "handler"] and c.end_line == line(TS, "export async function") - 2
    assert [(i.source, i.items, i.is_default) for i in r.imports] == [
        ("express", ["express"], True), ("../src/part.js", ["make", "Part", "Shape"], False), ("./all", ["* as all"], False), ("./side", [], False), ("./both", ["def"], True), ("./both", ["other"], False),
    ]
    assert [i.line for i in r.imports] == [3, 7, 8, 9, 10, 10]
    assert sorted((e.name, e.kind) for e in r.exports) == sorted([("PartA", "class"), ("makeA", "function"), ("arrow", "variable"), ("answer", "variable"), ("main", "function"), ("main", "default"), ("one", "default"), ("two", "default")])
    assert {e.name: e.line for e in r.exports}["answer"] == line(TS, "export const answer")


def test_go_java_and_heritage(one):
    r = one("src/main.go", 'package main\n\nimport "fmt"\n\nfunc Add(a int, b int) int {\n\treturn a + b\n}\n\ntype User struct {\n\tName string\n\tAge  int\n}\n\nfunc (u User) Greet() string {\n\treturn "Hello, " + u.Name\n}\n')
    assert [(f.name, f.params, f.return_type, f.is_exported, f.start_line, f.end_line) for f in r.functions] == [("Add", ["a: int", "b: int"], "int", True, 5, 7), ("Greet", [], "string", True, 14, 16)]
    assert [(c.name, c.properties, c.start_line, c.end_line) for c in r.classes] == [("User", ["Name", "Age"], 9, 12)] and [i.source for i in r.imports] == ["fmt"]
    assert {(e.name, e.kind) for e in r.exports} == {("Add", "function"), ("Greet", "function"), ("User", "class")}
    java = "package com.example;\n\nimport java.util.List;\nimport java.io.*;\n\npublic class UserService {\n    private String name = \"class Fake { }\";\n\n    public UserService(String name) {\n        this.name = name;\n    }\n\n    public String getName() {\n        return name;\n    }\n\n    public List<String> findAll(\n        int a) {\n        return List.of();\n    }\n}\n"
    r = one("src/UserService.java", java)
    assert [(c.name, c.methods, c.properties, c.start_line, c.end_line) for c in r.classes] == [("UserService", ["getName", "findAll"], ["name"], 6, 21)]
    assert [(i.source, i.items, i.line) for i in r.imports] == [("java.util.List", [], 3), ("java.io", ["*"], 4)] and [(e.name, e.kind) for e in r.exports] == [("UserService", "class")]
    r = one("src/child.ts", "import { Base } from './base';\nexport class Child extends Base {\n  run() {}\n}\n")
    assert r.classes[0].super_class == "Base" and r.classes[0].methods == ["run"]
    r = one("src/worker.ts", "export class Worker extends Base implements Runnable, Closeable {\n  run() {}\n}\n")
    assert r.classes[0].implements == ["Runnable", "Closeable"]
    r = one("src/caller.ts", "import { helper } from './helper';\nexport function caller() {\n  helper();\n  return local();\n}\nfunction local() { return 1; }\n")
    assert r.functions[0].calls == ["helper", "local"] and [f.name for f in r.functions] == ["caller", "local"]


def test_go_forms(one):
    r = one("a.go", 'package a\nimport (\n\t"fmt"\n\tm "math"\n)\n// func ghost() {}\nfunc two(a, b int, f func(x int) bool) (n int, err error) {\n\ts := `func fake() {`\n\tc := \'{\'\n}\ntype I interface {\n\tRun() error\n}\n')
    assert [i.source for i in r.imports] == ["fmt", "math"]
    (f,) = r.functions
    assert (f.name, f.return_type, f.is_exported, f.start_line, f.end_line) == ("two", "n: int, err: error", False, 7, 10) and f.params[:2] == ["a", "b: int"]
    assert [(c.name, c.properties, c.is_exported) for c in r.classes] == [("I", [], True)]


def test_python(one):
    r = one("a.py", 'import os, sys as s\nfrom .x import y, z\n"""def ghost(): pass"""\nclass A(b.B):\n    n = 1\n    t: int = 2\n    def f(self, a):\n        def inner(): pass\nasync def g(\n    a, /, b=1, *c, d, **e) -> int: pass\n')
    assert [(f.name, f.params, f.return_type, f.start_line, f.end_line) for f in r.functions] == [("g", ["a", "b", "*c", "d", "**e"], "int", 9, 10)]
    assert [(c.name, c.methods, c.properties, c.super_class, c.start_line) for c in r.classes] == [("A", ["f"], ["n", "t"], "B", 4)]
    assert [(i.source, i.items) for i in r.imports] == [("os", []), ("sys", []), (".x", ["y", "z"])]
    assert [(e.name, e.kind) for e in r.exports] == [("A", "class"), ("g", "function")]
    bad = one("bad.py", "def (")
    assert not bad.has_structure and bad.functions == [] and bad.total_lines == 1


def test_odd_files(spark):
    odd = ["", None, "}}}", "((({{{", "`${`${`", '"open', "/* open", "class", "function f(", "a" * 50_000, "/" * 20_000, "{" * 20_000, "\n" * 20_000, "`" * 9_999, "'\\", "x = a / b / c; function ok() {}"]
    rows = [(f"p{i}.{e}", t) for i, t in enumerate(odd) for e in ("ts", "go", "java", "py", "rb")] + [(None, "function f() {}"), ("p0.ts", "")]
    got = facts(spark.createDataFrame(rows, "path string, content string")).collect()
    assert len(got) == len(rows)
    assert [f.name for r in got if r.path == "p15.ts" for f in r.functions] == ["ok"]
    assert all(r.has_structure == (r.path is not None and r.path.endswith((".ts", ".go", ".java"))) for r in got if r.path is None or not r.path.endswith(".py"))
    assert facts(spark.createDataFrame([], "path string, content string")).count() == 0


def test_code_in_strings_and_comments_counts_for_nothing(spark):
    """Files put together of real declarations and of decoys in every kind of quote, in any order."""
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        parts, names, classes, sources = [], [], [], []
        for i in range(rng.randint(1, 12)):
            decoy = rng.choice([f"function no{i}(a) {{ }}", f"class No{i} {{ }}", f"import {{ a }} from 'no{i}';", "} ) ] {", "export function x() {"])
            kind = rng.randrange(8)
            if kind == 0:
                parts.append(f"/* {decoy}\n{decoy} */")
            elif kind == 1:
                parts.append(f"// {decoy}")
            elif kind == 2:
                parts.append(f"const s{i} = \"{decoy}\";")
            elif kind == 3:
                parts.append(f"const t{i} = `{decoy}\n${{f({i})}} {decoy}`;")
            elif kind == 4:
                parts.append(f"const r{i} = /[{{(\"'`]/;")
            elif kind == 5:
                parts.append(f"export function fn{i}(\n  a{i},\n  b = '{decoy[:6]}'\n) {{\n  const q = \"{decoy}\";\n  return {{ a: [1, {{}}] }};\n}}")
                names.append((f"fn{i}", [f"a{i}", "b"]))
            elif kind == 6:
                parts.append(f"class C{i}\n  extends B{i} {{\n  m{i}() {{ return '{decoy[:8]}'; }}\n  p{i} = `{decoy}`;\n}}")
                classes.append((f"C{i}", f"B{i}", [f"m{i}"], [f"p{i}"]))
            else:
                parts.append(f"import {{\n  x{i}\n}} from 'm{i}';")
                sources.append(f"m{i}")
        rows.append((f"f{k}.ts", "\n".join(parts)))
        want[f"f{k}.ts"] = (names, classes, sources)
    got = facts(spark.createDataFrame(rows, "path string, content string")).collect()
    for r in got:
        assert ([(f.name, f.params) for f in r.functions], [(c.name, c.super_class, c.methods, c.properties) for c in r.classes], [i.source for i in r.imports]) == want[r.path], dict(rows)[r.path]


def test_numbers_stand_for_brackets_and_strings():
    o = Outline("a('x', [1]) { b(2) }", "js")
    assert o.top.split("\n")[1] == "a(0) {2}" and o.groups[0][2] == '"0", [1]' and o.groups[1][2] == "1" and o.groups[2][2:] == [" b(3) ", " b(3) "]
    assert [s for s, _ in o.strings] == ["x"]
