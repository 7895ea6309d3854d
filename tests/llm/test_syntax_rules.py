"""Valid texts that a narrow grammar would reject, and rules that a grammar leaves open."""

import pytest

from quarry.llm.syntax import lexers
from quarry.llm.unparsable import Checker

VALID = [
    ("let x = y\n++z\n", ".js"), ("if (a) /re['\"]/.test(b)\n", ".js"), ("let q = (a) / b / c;\n", ".js"), ("for (const k of a) {}\nfor (const k in a) {}\nconst z = 1, y = 2;\nconst {m} = q;\n", ".js"), ("const w\n  = 3;\n", ".js"), ("class A { 'x' = 1; }\n", ".js"),
    ("const f = <const T,>(a: T) => a;\n", ".ts"), ("export default interface A { b: string }\n", ".ts"), ("declare const x: number;\n", ".ts"),
    ("sealed interface B permits C {}\n", ".java"), ("class A { int permits = 1; int f(Object o) { return switch (o) { case Integer i when i > 3 -> 1; default -> 2; }; } }\n", ".java"),
    ("a.b[1], (c, *d), [e] = 1\nx: int = 3\nf(a, *b, c=1, **d)\ndef g(a, b=1, *c, d, **e): pass\nh = lambda x=1: x\ni = j = k\nx = yield\nfor a in b: c = 1\nif x: y = 2\nx[f(a=1)] += 2\n's'.x = 2\n", ".py"),
]
INVALID = [
    ("1 = x\n", ".py"), ("f(a=1, 2)\n", ".py"), ("f(**a, 2)\n", ".py"), ("def f(a=1, b): pass\n", ".py"), ("x = yield = 3\n", ".py"), ("f() = 1\n", ".py"), ("a + b = c\n", ".py"), ("if x: 1 = 2\n", ".py"), ("f() += 1\n", ".py"), ("[a, 1] = b\n", ".py"),
    ("1 = 2\n", ".js"), ("const x;\n", ".js"), ("const x\nlet y = 1;\n", ".js"),
]


@pytest.mark.parametrize("text, suffix", VALID)
def test_valid(text, suffix):
    assert Checker().first_error(text, suffix) == 0


@pytest.mark.parametrize("text, suffix", INVALID)
def test_invalid(text, suffix):
    assert Checker().first_error("\n\n" + text, suffix) == 3


def test_rules_accuse_without_the_standard_parser():
    assert all(lexers.broken_rule(line) for line in ("num = n", "n ( n = num , num )", "def n ( n = num , n ) : pass", "n ( ) = num"))
    assert not any(lexers.broken_rule(line) for line in ("n = n = n", "n ( n , * n , n = num , ** n )", "def n ( n , n = num , * , n ) : pass", "n : n = n", "n = lambda n = num : n", ""))


def test_conflicts_of_the_tables_are_listed():
    checker = Checker()
    assert {x: len(checker.parser(x).grammar.conflicts) for x in ("python", "json", "toml", "go", "java", "javascript", "typescript")} == {"python": 0, "json": 0, "toml": 0, "go": 3, "java": 1, "javascript": 12, "typescript": 13}
