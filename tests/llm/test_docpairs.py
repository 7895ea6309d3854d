"""Documentation of functions: where it stands and what counts as trivial."""

import pytest

from quarry.llm import docpairs as D

GOOD = "Sorts the partial rows into the store."


@pytest.mark.parametrize(
    ("path", "name", "body", "doc", "want"),
    [
        ("a.py", "f", f'def f(a="x:", b={{1: 2}}):\n    # note\n    """{GOOD}\n\n    Args:\n        a: thing\n    """\n    return 1', None, GOOD),
        ("a.py", "f", f"async def f():\r\n    # one\r\n    # two\r\n    '{GOOD}'\r\n", None, GOOD),
        ("a.py", "f", 'def f():\n    x = """not a docstring of this function"""\n', None, ""),
        ("a.py", "f", "def f():\n    pass", GOOD, GOOD),
        ("a.py", "f", "def f():\n    # the rows come first in here always\n    pass", None, ""),
        ("a.js", "f", f"/** {GOOD} */\nexport const f = (a) => {{\n  return a;\n}};", None, GOOD),
        ("a.ts", "f", f"async f(a: Map<string, {{ x: number }}>): void {{\n  // {GOOD}\n  // @param a rows\n  const r = /[{{(]x/;\n}}", None, GOOD),
        ("a.js", "f", f"f(a) {{\n  const x = 1;\n  // {GOOD}\n  return x;\n}}", None, ""),
        ("a.js", "f", "f(a) {\n  // const old = fetchRows(limits, 5);\n  return 1;\n}", None, ""),
        ("a.js", "f", "f() {\n  // eslint-disable-next-line\n  return 1;\n}", "/**\n * @param rows\n * @returns\n */", ""),
        ("a.py", "load_rows", 'def load_rows():\n    """This is the function load_rows."""', "TODO: write a proper description for this function later on", ""),
        ("a.py", "f", 'def f():\n    """Documentation for this function will be added in a later release."""', "   ", ""),
        ("a.py", "f", 'def f():\n    """lorem ipsum dolor sit amet consectetur"""', "-----", ""),
        (None, None, None, None, ""),
    ],
)
def test_documentation(path, name, body, doc, want):
    assert D.documentation(path, name, body, doc).split("\n\n")[0] == want


def test_braces_delimit_the_body():
    text = "function f(a = '{') {\n  const s = `}`; // }\n  if (a) { g(); }\n}\nfunction g() {}"
    _, _, opening, end = D.script_comments(text)
    assert text[opening:end] == text[text.index("{\n") : text.index("\nfunction g")]


def test_long_lines_and_many_comments_stay_fast():
    body = "def f():\n" + "    # word word word\r\n" * 5000 + "    pass\n"
    assert D.documentation("a.py", "f", body, "description " + "will be word " * 20_000) != None  # noqa: E711


def test_rows_and_comments_in_the_file(spark, make_nodes):
    file = f"import x;\n\n/**\n * {GOOD}\n */\nfunction one() {{\n  return 1;\n}}\n\n// TODO\nfunction two() {{\n}}\n"
    rows = [
        {"id": 1, "kind": "FILE", "repo": "r", "file_path": "a.js", "full_body": file},
        {"id": 2, "kind": "FUNCTION", "name": "one", "repo": "r", "file_path": "a.js", "start_line": 6, "signature": "function one()", "full_body": "function one() {\n  return 1;\n}"},
        {"id": 3, "kind": "FUNCTION", "name": "two", "repo": "r", "file_path": "a.js", "start_line": 11, "full_body": "function two() {\n}"},
        {"id": 4, "kind": "METHOD", "name": "m", "repo": None, "file_path": "b.py", "full_body": f'def m(self):\n    """{GOOD}"""'},
        {"id": 4, "kind": "METHOD", "name": "m", "repo": None, "file_path": "b.py", "full_body": f'def m(self):\n    """{GOOD}"""'},
        {"id": 5, "kind": "CLASS", "name": "C", "docstring": GOOD}, {"id": 6, "kind": "FUNCTION"}, {"id": None, "kind": "FUNCTION", "docstring": GOOD},
    ]
    got = {r.node_id: r.documentation for r in D.documented(make_nodes(rows)).collect()}
    assert got == {2: GOOD, 4: GOOD}
    assert {r.node_id for r in D.documented_ids(make_nodes(rows)).collect()} == {2, 4}
    assert D.documented_ids(make_nodes([])).count() == 0
