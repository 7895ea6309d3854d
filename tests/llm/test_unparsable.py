"""Parsing: valid and broken texts of each language, and Python against the standard parser."""

import ast
import inspect
import random

import pytest

from quarry.llm import unparsable as U

VALID = {
    ".py": ["", "# only\n", "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case _:\n        pass\n", "type X[T] = list[T]\nmatch = 1\nmatch[0] = case\n", "async def f(*, a: int = 1, **k) -> None:\n    return [await x async for x in y if (z := x)]\n",
            "with (open(a) as f, b):\n\tpass\n", "x = f'{a!r:>{w}}' 'b'\nS = '''\n<<<<<<< HEAD\n'''\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\n", "@a.b(c)\nclass D[T](E, metaclass=F): x: int; y = lambda *a, k=1: (yield)\n", "if a and \\\n        b:\n    print(a[1:2, ::3], end='')\n"],
    ".js": ["", "// x\n", "export const f = async ({ a, b = 1 }, ...r) => ({ ...a, [b]: r, get x() { return 1 } });\n", "label: for (const [k, v] of Object.entries(x)) { if (!k) continue label\n else break }\n", "class A extends (b, C) { static #p = 1; static { this.x = 2 } async *m() { yield* a?.b?.[0] ?? 1 } }\n",
            "const r = /[{(]a\\/\\d+/.test(s) ? `x ${a ? `y${b}` : '}'} z` : a / b / c;\n", "let x = a\n  .b()\n  .c(function () {})\ndo { x-- } while (x)\n", "import a, { b as c } from 'd';\nexport * from 'e';\nexport default class {}\n", "#!/usr/bin/env node\nswitch (a) { case 1: { } default: }\n"],
    ".jsx": ["const a = <div className={b}>text {c}<br /></div>;\nfunction f() { return (<><A b={1} /></>); }\n"],
    ".ts": ["interface A<T> extends B<T> { x?: number[]; readonly [k: string]: any; f(a: string): void }\n", "export const f = <T,>(a: Map<string, T[]>, b?: { c: number }): Promise<void> => g<T>(a as unknown as T)!;\n", "enum E { A = 1, B }\nexport type X = keyof typeof E | 'a' | (() => void);\nabstract class C implements D { private constructor(public a: number, readonly b = 1) { super() } }\n",
            "export const enum F { A }\nimport type { G } from './g';\ndeclare module 'x' { function y(a: any): asserts a is string; }\nnamespace N { export const z = 1 }\n", "const m = new Map<string, number>();\nfor (const a of m.keys()) { if (a < 'b' && m.size > 2) { } }\n"],
    ".go": ["", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[P any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T) F(a ...int) (n int, err error) {\n\tif v, ok := m[a[0]]; ok && v > 1 {\n\t\treturn\n\t}\n\tfor i := range a {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\tz := []T{{A: 1}, {2, 3}}\n\tdefault:\n\t}\n\treturn map[string]int{\"a\": 1}[\"a\"], nil\n}\n"],
    ".java": ["package a.b;\nimport static c.D.*;\n@A(b = 1)\npublic class X<T extends Y & Z> implements I<T[]> {\n  private final Map<String, List<T>> m = new HashMap<>();\n  X() { super(); }\n  static { int[] a = {1, 2}; }\n  <U> U f(final U... u) throws E { for (int v : a) { if (v > 1 && (String) o == null) m.put(\"a\", x -> { return x; }); }\n    int i = (int) 2L; return switch (i) { case 1 -> null; default -> { yield u[0]; } }; }\n  enum E { A(1) { }, B; int q; }\n}\n"],
    ".json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e4 } ]"}]}', '"x"'],
    ".yaml": ["", "# c\na: 1\nb:\n- x\n- y: {z: [1, 2], w: \"q: r\"}\n  v: |\n    free: text [\n  u: >-\n    more\nc: &d\n  e: *d\n---\nf: 'it''s'\n", "- - 1\n  - 2\n- [a,\n   b]\n", "a: first\n  second\nb: !!str 1\n"],
    ".toml": ["", "a.b = 1\n\"c d\" = [1,\n  2, # x\n]\n[t]\ne = {f = 'g', h = 1979-05-27T07:32:00Z}\n[[u.v]]\nw = \"\"\"\nx [ y\n\"\"\"\n"],
}
BROKEN = {
    ".py": ["print 'x'\n", "def f(:\n    pass\n", "x = (1, 2\n", "if a:\npass\n", "<<<<<<< HEAD\nx = 1\n", "t = 'open\n", "  x = 1\n y = 2\n", "const a = 1;\n", "class A:\n    def f(self):\n        try\n", "x = 0aa1\n", "=======\n"],
    ".js": ["const = ;\n", "function f( {\n", "const a = {\n", "}\n", "import os\nfrom x import y\n", "interface Row {\n  a: string;\n}\n", "let a: number = 1;\n", "<<<<<<< ours\n", "x = 'open\n", "for (const a of b {\n}\n", "<!DOCTYPE html>\n<html>\n", "a b\n"],
    ".jsx": ["const a = <div><b></div>;\n"],
    ".ts": ["const = ;\n", "function f(a: number {\n}\n", "class A {\n  x(): void {\n", ">>>>>>> theirs\n", "const a: = 1;\n", "}\n"],
    ".go": ["package a\nfunc f( {\n}\n", "import re\n", "package a\nfunc f() {\n\treturn \"x\n}\n", "package a\n}\n", "#!/bin/sh\n"],
    ".java": ["class {\n}\n", "package a;\nclass A { int f(int a { return 1; } }\n", "public class A {\n", "import os\n"],
    ".json": ["{'a': 1}", '{"a": 1,}', "key: value\n", '{"a"', "{} {}", "// c\n{}"],
    ".yaml": ["a: [1, 2\nb: 3\n", "a:\n\tb: 1\n", 'a: "open\n', "a: b: c\n", "<<<<<<< HEAD\na: 1\n", "a: 1\n  b: 2\n", "a: ]\n"],
    ".toml": ["a = \n", "a\n", "[t\n", "a = 'open\n", "a = 1 b = 2\n", "a: 1\n"],
}


@pytest.fixture(scope="module")
def checker():
    return U.Checker()


@pytest.mark.parametrize("suffix", sorted(VALID))
def test_valid(checker, suffix):
    assert [t for t in VALID[suffix] if checker.first_error(t, suffix)] == []


@pytest.mark.parametrize("suffix", sorted(BROKEN))
def test_broken(checker, suffix):
    assert [t for t in BROKEN[suffix] if not checker.first_error(t, suffix)] == []


def test_python_agrees_with_the_standard_parser(checker):
    import argparse
    import asyncio.base_events
    import dataclasses
    import decimal
    import typing

    rng = random.Random(9)
    parser = checker.parser("python")
    agree = total = 0
    for module in (argparse, asyncio.base_events, dataclasses, typing, decimal, inspect):
        source = inspect.getsource(module)
        assert parser.parse(U.lexers.python_lines(source)[0]) < 0, module
        lines = source.split("\n")
        for _ in range(25):  # cut short or garbled by one character
            at = rng.randrange(1, min(len(lines), 400))
            broken = "\n".join(lines[:at]) + "\n" + lines[at][: rng.randrange(len(lines[at]) + 1)] if rng.random() < 0.5 else "\n".join(lines[:at] + [lines[at] + rng.choice([")", "(", " =", ":", "'"])] + lines[at + 1 : 400])
            try:
                ast.parse(broken)
                ok = True
            except SyntaxError:
                ok = False
            agree += ok == (parser.parse(U.lexers.python_lines(broken)[0]) < 0)
            total += 1
    assert agree >= 0.96 * total


def test_error_lines(checker):
    assert checker.first_error("a = 1\nb = (\n", ".py") in (2, 3)
    assert checker.first_error("/* one\ntwo */\nlet a = 1;\nconst = ;\n", ".js") == 4


def test_rows_and_rates(spark, make_nodes):
    rows = [{"id": i, "kind": "FILE", "repo": "r", "file_path": p, "full_body": t} for i, (p, t) in enumerate([("a.py", "x = ("), ("b.py", "x = 1"), ("c.JS", "const = ;"), ("d.md", "x = ("), ("e.py", None), ("f", "(")])]
    rows += [rows[0], {"id": 9, "kind": "FILE", "repo": None, "file_path": "a.py", "full_body": "("}]
    files = spark.createDataFrame([("r", p) for p in ("a.py", "a.py", "b.py", "c.JS", "d.md", "e.py", "f", "missing.py")] + [(None, "a.py"), ("r", None)], "repo string, relative_path string")
    assert {tuple(r) for r in U.unparsable(files, make_nodes(rows)).collect()} == {("r", "a.py"), ("r", "c.JS")}
    assert {(r.language, r.files, r.unparsable, r.rate) for r in U.rates(files, make_nodes(rows)).collect()} == {("python", 4, 1, 0.25), ("javascript", 1, 1, 1.0)}
    assert U.unparsable(files.limit(0), make_nodes(rows)).count() == 0
