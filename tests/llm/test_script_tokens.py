"""The state machine that reads scripts: templates in templates, regular expressions, long lines."""

from quarry.llm import docpairs as D

DOC = "/** Sorts the rows by weight before they are merged. */"


def test_templates_within_templates_hide_nothing():
    text = "function f(b) {\n  const x = `x ${b ? `y/*` : \"}\"}`;\n  return `a ${ {k: `}`} } /*`;\n}\n\n" + DOC + "\nfunction g() {\n  return 1;\n}\n"
    assert [t.text for t in D.script_tokens(text) if t.kind == "comment"] == [DOC]
    assert [(line, c) for line, c in D.comment_blocks(text)] == [(7, DOC)]
    assert D.documentation("a.js", "g", DOC + "\nfunction g() {\n  return `x ${`y/*`}`;\n}", None) == "Sorts the rows by weight before they are merged."
    assert D.closing(text, text.index("{")) == text.index("\n\n")


def test_regular_expressions_and_divisions():
    text = "function f(a) {\n  if (/['\"]/.test(a)) return /'{/g.test(a);\n  const q = a / 2; const r = (a) / b / c;\n  // kept\n}\n"
    kinds = [(t.kind, t.text) for t in D.script_tokens(text)]
    assert ("comment", "// kept") in kinds and [x for k, x in kinds if k == "regex"] == ["/['\"]/", "/'{/g"] and not any(k == "string" for k, _ in kinds)
    assert list(D.script_tokens("")) == [] and [t.text for t in D.script_tokens("`open ${a")] == []


def test_lines_of_any_length():
    statement = "// const rows = pick(" + "first, " * 200 + "last);"
    assert D.clean(statement) == "" and D.code("a" * 500_000) is False and D.filler("a " * 200_000) is False
    told = "Add the rows of every region that the docs list, " + "and then those of the next region, " * 20 + "before the totals are merged."
    assert D.clean("/** " + told + " */") == told
    assert D.clean("// TODO: write this later") == "" and D.clean("/** Documentation will follow soon. */") == ""
