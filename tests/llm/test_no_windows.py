"""Constructs of any length: what decides a line's validity may stand far away."""

import pytest

from quarry.llm.unparsable import Checker

LONG = "\n".join(f"  line {i} of a text" for i in range(120))
PARAMETERS = ", ".join(f"p{i}: Map<string, number>" for i in range(90))
FIELDS = "; ".join(f"f{i}: number" for i in range(60))


@pytest.mark.parametrize("text, suffix", [
    (f'a: "first\n{LONG}\n  last" # end\nb: 1\n', ".yaml"),
    (f"a: 'it''s\n{LONG}\n  last'\nb: 1\n", ".yaml"),
    (f'a:\n  - "first\n{LONG}\n    last"\n  - b\n', ".yaml"),
    (f"class A {{\n  m<T>({PARAMETERS}): void {{\n    return;\n  }}\n}}\n", ".ts"),
    (f"const f = (a: number): {{ {FIELDS} }} => g(a);\n", ".ts"),
    (f"const f = g<{{ {FIELDS} }}>(1);\n", ".ts"),
])
def test_valid_however_long(text, suffix):
    assert Checker().first_error(text, suffix) == 0


@pytest.mark.parametrize("text, line", [
    (f'a: 1\nb: "first\n{LONG}\nc: 2\n', 2), ('a: "first\nb: "second"\n', 2), ('a: "first\n  last" more\n', 2), ("a: 'first\n---\nb: 'x'\n", 2),
])
def test_unclosed_is_still_an_error(text, line):
    assert Checker().first_error(text, ".yaml") == line
